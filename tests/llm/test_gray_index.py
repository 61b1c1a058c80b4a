import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from clausespark.llm import gray_index
from clausespark.llm.gray_index import components, keep_one, links, near_duplicates

SCHEMA = "doc_id bigint, text string, fingerprint string, root int"


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def partition(labels):
    groups = {}
    for i, x in labels:
        groups.setdefault(x, set()).add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("tile", [8, 64, 1 << 15])
def test_links_give_the_components_of_brute_force(spark, tile):
    rng = random.Random(tile)
    values = {rng.getrandbits(64) for _ in range(150)}
    for c in [rng.getrandbits(64) for _ in range(6)]:  # families around a centre, some chained, some only close
        for _ in range(40):
            x = c
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {0, (1 << 64) - 1, 7, 0b1111}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in components(links(fps, 3, tile)).collect()}
    got = partition((v, found.get(v, v)) for v in signed)
    assert got == partition(zip(signed, classes(values)))


def texts():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(900)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            words[rng.randrange(80)] = "X"
        rows.append((i + 5, rng.choice([" ", "\n"]).join(words)))
    rows += [(1, ""), (2, None), (3, "One"), (4, "one"), (200, "a b"), (201, "A\tB"), (7, rows[2][1]), (7, rows[2][1]), (None, rows[3][1]), (None, "only here, no id")]
    return [(*r, "x", 0) for r in rows]


def test_near_duplicates_equal_brute_force(spark):
    data = texts()
    got = near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    prints = [fingerprint(r[1]) for r in data]
    labels = classes(prints)
    least = {}
    for (d, *_), c in zip(data, labels):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = sorted((str(r[0]), f"{p:016x}", str(least.get(c))) for r, p, c in zip(data, prints, labels))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = keep_one(spark.createDataFrame(data, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fingerprint", "root"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(least.get(c)) for c in set(labels))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain_is_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(chain).collect()} == {0}


def test_stars_take_no_round(spark, monkeypatch):
    """Every round writes a table; edges that are stars around their smallest node are their components already."""
    written, cut = [], gray_index.cut_lineage
    monkeypatch.setattr(gray_index, "cut_lineage", lambda df: written.append(1) or cut(df))
    stars = [(1, 5), (5, 1), (7, 1), (2, 9), (3, 3), (None, 4)]
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert sorted(map(tuple, gray_index.components(edges(stars)).collect())) == [(5, 1), (7, 1), (9, 2)]
    assert len(written) == 1
    assert sorted(map(tuple, gray_index.components(edges([(9, 5), (5, 1), (7, 9)])).collect())) == [(5, 1), (7, 1), (9, 1)]
    assert gray_index.components(edges([])).count() == 0
