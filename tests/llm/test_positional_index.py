import hashlib
import random
import re

from clausespark.llm.positional_index import mark_contaminated, near_matches, windows

DOCS = "doc_id bigint, text string, key string, n_hit int"
ITEMS = "item_id bigint, text string, extra int"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    out = []
    for d, text, *_ in docs:
        w, hit, ids = words(text), set(), set()
        for item, phrase, _ in items:
            p = words(phrase)
            n = min(len(p), 10)
            for i in range(len(p) - n + 1 if p else 0):
                for s in range(len(w) - n + 1):
                    if w[s:s + n] == p[i:i + n]:
                        hit |= set(range(s, s + n))
                        ids |= {item} - {None}
        joined = ",".join(sorted(map(str, ids)))
        out.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(25)] + ["É", "the", "The", "x1"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(rng.choice([2, 3, 9, 10, 11, 25])), 0) for i in range(25)]
    items += [(100, None, 0), (101, "--", 0), (102, "Rare", 0), (103, items[0][1], 0), (None, line(12), 0), (104, "the the the", 0)]
    docs = []
    for i in range(80):
        parts = [line(rng.randrange(30)), rng.choice(items)[1] or "", "; ", line(rng.randrange(9))]
        docs.append((i, rng.choice([" ", "\n- "]).join(parts).upper() if i % 7 == 0 else " ".join(parts), "k", 0))
    docs += [(200, None, "", 0), (201, "", "", 0), (5, docs[5][1], "", 0), (None, items[4][1], "", 0), (202, "rare!", "", 0)]
    docs += [(300 + i, items[3][1], "", 0) for i in range(60)]  # a hot passage
    got = mark_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["doc_id", "text", "key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    have = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect())
    assert have == brute(docs, items)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "", 0)], DOCS)
    items = spark.createDataFrame([(1, "a", 0)], ITEMS)
    assert mark_contaminated(none, items).count() == 0
    assert [r["contaminated"] for r in mark_contaminated(some, items.limit(0)).collect()] == [False]


def test_proximity(spark):
    docs = spark.createDataFrame([("d1", "alpha x y beta z z gamma"), ("d2", "gamma beta q alpha"), ("d3", "alpha beta")], "key string, text string")
    win, _ = windows(spark.createDataFrame([(1, "alpha beta gamma", 0)], ITEMS))
    assert {(r["key"], r["pos"]) for r in near_matches(docs, win, 3).collect()} == {("d2", 0)}
    assert {r["key"] for r in near_matches(docs, win, 6).collect()} == {"d1", "d2"}
