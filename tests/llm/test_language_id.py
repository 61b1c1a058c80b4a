import random
import zlib

import numpy as np
import pytest

from clausespark.llm import language_id as L

SCHEMA = "doc_id bigint, text string, lang string, score string, source int"


def rows(n=500):
    rng = random.Random(1)
    parts = {"aa": ["the", "ing", "er", "on"], "bb": ["ü", "sch", "ich", "keit"], "cc": ["ñ", "ción", "que", "es"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 90))]
        out.append((i, rng.choice([" ", ". "]).join(words), lang, "s", 0))
    out += [(None, "the ing er on", "aa", "s", 0), (n, None, "aa", "s", 0), (n + 1, "", "bb", "s", 0), (n + 2, "123 $$ !!", "cc", "s", 0)]
    return out + [(n + 3, "schich keit " * 3000, None, "s", 0), (7, out[7][1], "aa", "s", 0)]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = L.Network.fresh(["a", "b", "c"], hidden=4, seed=3)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    x, label = rng.choice([32, 97, 98, 99, 195], size=(9, 5)).astype(np.uint8), rng.integers(3, size=5)
    _, grads = L.loss_and_gradients(net, x, label)
    for n in net.NAMES:
        value = getattr(net, n)
        for at in [tuple(rng.integers(s) for s in value.shape) for _ in range(6)] + ([(97, 2), (195, 9)] if n.startswith("table") else []):
            old, eps = value[at], 1e-6
            value[at] = old + eps
            up = L.loss_and_gradients(net, x, label)[0]
            value[at] = old - eps
            down = L.loss_and_gradients(net, x, label)[0]
            value[at] = old
            assert grads[n][at] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_windows_cover_each_text_once():
    sizes = np.array([0, 1, 255, 256, 257, 100_000])
    text, begin, length = L.windows(sizes)
    for k, n in enumerate(sizes):
        spans = sorted(zip(begin[text == k], length[text == k]))
        assert [b for b, _ in spans] == list(np.cumsum([0, *[n for _, n in spans]])[:-1]) and sum(n for _, n in spans) == n
    assert length.max() <= L.CORE


def test_whole_path(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = L.identify(df, L.fit(df))
    assert got.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    got = got.withColumn("held", L.held_out()).collect()
    assert len(got) == len(data)
    right = total = 0
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["text"] in (None, "", "123 $$ !!"):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["held"] and r["lang"]:
            total += 1
            right += r["lang_pred"] == r["lang"]
    assert total > 80 and right > 0.97 * total
    assert {r["lang_pred"] for r in got if r["doc_id"] == 503} == {"bb"}
    assert {r["doc_id"] for r in L.keep_identified(df, L.fit(df)).collect()} == {r[0] for r in data} - {500, 501, 502}


def test_training_never_sees_held_out_documents(spark):
    data = rows()
    pieces, _ = L.training_sample(spark.createDataFrame(data, SCHEMA))
    held = {r[1] for r in data if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[1]}
    assert pieces and not [p for p in pieces if any(p.decode() == h[:len(p.decode())] and p.decode() == h for h in held)]
    assert L.training_sample(spark.createDataFrame(data, SCHEMA).repartition(5)) == L.training_sample(spark.createDataFrame(data, SCHEMA))


def test_every_position_has_a_label(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    text = "theinger oner " * 8 + "schichkeit ich " * 8
    labels = L.label_positions(L.fit(df), text)
    assert len(labels) == len(text) and labels[50] == "aa" and labels[-50] == "bb"


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert L.identify(none, L.fit(none)).count() == 0
    assert [r["lang_pred"] for r in L.identify(spark.createDataFrame(rows(9), SCHEMA), None).collect()][0] == "und"
