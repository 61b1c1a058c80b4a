import random

import pytest

from clausespark.llm.sharding import Ends, balanced_cuts, least_capacity, shard

SCHEMA = "doc_id bigint, text string, slot string, other int"


def brute(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, fill = (low + high) // 2, 1, 0
        for s in sizes:
            used, fill = (used + 1, s) if fill + s > mid else (used, fill + s)
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_capacity_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 40, 200 if seed else 4000]) + rng.randrange(30) for _ in range(500)]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    shards, line = rng.choice([3, 7, 40]), Ends(spark.createDataFrame([(e,) for e in ends], "e bigint"), "e", bins=16)
    want = brute(sizes, shards)
    assert least_capacity(line, shards) == want
    cuts = balanced_cuts(line, shards, want)
    assert set(cuts) <= set(ends) and cuts[-1] == ends[-1] and len(cuts) <= shards
    assert max(b - a for a, b in zip([0, *cuts], cuts)) <= want


def test_groups_stay_whole_and_slots_have_no_gap(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["same", None, "", f"text {i} " * rng.randrange(9)]), "x", i) for i in range(300)]
    rows += [(7, "twice", "x", 1), (7, "twice", "x", 1), (None, "no id", "x", 1), (None, None, "x", 2)]
    got = shard(spark.createDataFrame(rows, SCHEMA), 5, bins=8).collect()
    assert len(got) == len(rows)
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and slots
    homes = {}
    for r in got:
        assert homes.setdefault(r["text"], r["shard"]) == r["shard"]
        assert r["size"] == len((r["text"] or "").encode()) + 16 and r["law"] == "bytes" and r["grown_shard"] is None


def test_empty_and_few(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0
    got = shard(spark.createDataFrame([(1, "a", "", 0), (2, "a", "", 0), (3, "b", "", 0)], SCHEMA), 40).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(1, 0, 0), (2, 0, 1), (3, 1, 0)}


def test_very_many_equal_rows(spark, monkeypatch):
    from clausespark.llm import sharding

    monkeypatch.setattr(sharding, "REPEATED", 3)
    rows = [(i % 5, "a" if i % 2 else "b", "x", i) for i in range(100)] + [(None, None, "x", 7)] * 9 + [(50 + i, f"t{i}", "x", i) for i in range(20)]
    got = shard(spark.createDataFrame(rows, SCHEMA).repartition(3), 4).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["other"]) for r in got))) == sorted(map(repr, ((r[0], r[1], r[3]) for r in rows)))
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
