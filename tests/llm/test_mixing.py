import random

from clausespark.llm.mixing import mix, repeat_copies

SCHEMA = "doc_id bigint, text string, source string, target string, extra int"


def targets(sizes):
    """Share 1.5 of all by weights 5, 2, 1, at most twice a source, the excess reshared until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def rows(n=3000):
    rng = random.Random(5)
    out = [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 5)), rng.choice(["a", "a", "a", "b", "c", "dé", None]), "t", i) for i in range(n)]
    return out + [(1, "x y", "a", "t", 1)] * 5 + [(None, "n n n", "b", "t", 1), (4, None, "c", "t", 1), (5, "", None, "t", 1)]


def test_targets_and_taken(spark):
    data = rows()
    got = mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    sizes = {}
    for r in data:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 * want[s] and r["source_size"] == sizes[s] for r in mine)
        assert 0 <= want[s] - sum(r["taken"] for r in mine) <= 0.01 * want[s] + 1
        low = int(want[s] / sizes[s] + 1e-9)
        assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] in (low, low + 1) for r in mine)


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    key = lambda d: sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in d.collect())
    assert key(mix(df)) == key(mix(df.repartition(13)))
    assert key(mix(df)) != key(mix(df, seed=1))


def test_longer_documents_have_better_odds(spark):
    data = [(i, "w " * (4 if i % 2 else 64), "a", "", 0) for i in range(4000)] + [(-i, "w " * 500, "b", "", 0) for i in range(1, 4000)]
    got = [r for r in mix(spark.createDataFrame(data, SCHEMA), share=0.3).collect() if r["source"] == "b" or r["copies"] < 2]
    taken = {n: sum(r["copies"] for r in got if r["source"] == "a" and r["size"] == n) for n in (4, 64)}
    assert taken[64] >= taken[4]


def test_empty_and_wordless(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mix(spark.createDataFrame([(1, None, "a", "", 0), (2, "", None, "", 0)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_copies_are_repeated(spark):
    mixed = mix(spark.createDataFrame(rows(200), SCHEMA))
    assert repeat_copies(mixed).count() == mixed.agg({"copies": "sum"}).first()[0]


def test_a_giant_document_leaves_no_room_unused(spark):
    rng = random.Random(2)
    data = [(i, "w " * max(1, int(rng.lognormvariate(3, 1))), "a", "", 0) for i in range(5000)] + [(-1, "w " * 40000, "a", "", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    for seed in range(3):
        got = mix(df, seed=seed, share=0.3).collect()
        room = got[0]["target"] - sum(r["taken"] for r in got)
        assert 0 <= room < min(r["size"] for r in got if not r["copies"])
