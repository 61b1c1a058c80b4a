import hashlib
import random

from clausespark.llm.fingerprints import compare_with_edited, simhash, with_key, within_radius

SCHEMA = "doc_id bigint, text string, key string, n_chars int"
U64 = (1 << 64) - 1


def rows():
    rng = random.Random(2)
    out = [(i * 10, " ".join(rng.choice("àbcdefgh") * rng.randrange(1, 9) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 200)))) for i in range(60)]
    out += [(5, None), (6, ""), (7, "É"), (8, "   "), (9, "one two"), (11, out[3][1]), (20, out[2][1]), (None, "no id here")]
    return [(*r, "x", 0) for r in out]


def test_edited_texts_and_likeness(spark):
    data = rows()
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in compare_with_edited(spark.createDataFrame(data, SCHEMA)).collect()}
    docs = sorted({(r[0], r[1] or "") for r in data}, key=lambda r: (r[0] is not None, r[0]))
    assert sum(1 for _ in got) == len(docs)
    closer = 0
    for (d, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[d, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        closer += r["near_edited"] > r["near_next"]
    assert closer > 0.9 * len(docs)


def test_repeated_rows_come_out_repeated(spark):
    got = compare_with_edited(spark.createDataFrame([(1, "a b c", "", 0)] * 3 + [(2, "d e f", "", 0)], SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2]
    assert compare_with_edited(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = compare_with_edited(spark.createDataFrame([(1, "abcdefgh", "", 0)], SCHEMA)).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1


def test_equal_texts_have_equal_fingerprints_and_votes_are_exact(spark):
    keyed = with_key(spark.createDataFrame(rows(), SCHEMA))
    prints = {}
    for r in keyed.join(simhash(keyed, ["key"], "text"), "key").collect():
        assert prints.setdefault(r["text"], (r["fp0"], r["fp1"])) == (r["fp0"], r["fp1"])
    assert prints[""] == (0, 0) == prints["   "]
    one = simhash(spark.createDataFrame([("k", "x y z")], "key string, text string"), ["key"], "text").first()
    h = [spark.sql(f"select xxhash64('{t}'), xxhash64('{t}', 1)").first() for t in ("x y", "y z")]
    assert (one["fp0"] & U64, one["fp1"] & U64) == tuple(h[0][i] & h[1][i] & U64 for i in (0, 1))


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(128) for _ in range(40)]
    for v in list(values):
        for k in range(1, 6):
            for b in rng.sample(range(128), k):
                v ^= 1 << b
            values.append(v)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    data = [(signed(v & U64), signed(v >> 64)) for v in set(values)]
    fps = spark.createDataFrame(data, "fp0 bigint, fp1 bigint")
    got = [(r["q0"], r["q1"], r["fp0"], r["fp1"]) for r in within_radius(fps.limit(100), fps).collect()]
    far = lambda a, b: ((a[0] ^ b[0]) & U64).bit_count() + ((a[1] ^ b[1]) & U64).bit_count()
    want = {(*a, *b) for a in map(tuple, fps.limit(100).collect()) for b in data if far(a, b) <= 3}
    assert len(got) == len(set(got)) and set(got) == want
