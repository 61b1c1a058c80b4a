import random

import numpy as np
import pytest

from clausespark.llm import quality as Q

SCHEMA = "doc_id bigint, text string, selected string, top_probability int"


def rows(n=2500):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        if grade == 0:
            words[rng.randrange(len(words))] = rng.choice(["scum", "Trash", "idiot"])
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "x", 0))
        labels.append((i, int(grade == 2), int(grade == 0)))
    docs += [(None, "w1 w2", "x", 0), (n, None, "x", 0), (n + 1, "", "x", 0), (n + 2, "w3 w4 " * 5000, "x", 0), (7, docs[7][1], "x", 0)]
    return docs, labels + [(None, 1, 0), (3, None, 0), (9, 1, 0), (9, 0, 1)]


def test_gradients_equal_differences():
    score, grade, cuts = np.array([0.3, -1.0, 2.0, 0.1]), np.array([0, 1, 2, 1]), np.array([-0.5, 0.8])
    by_score, by_cut, _ = Q.gradients(score, grade, cuts)
    loss = lambda s, c: Q.gradients(s, grade, c)[2]
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        assert by_score[i] == pytest.approx((loss(score + e, cuts) - loss(score - e, cuts)) / 2e-6, abs=1e-5)
    for k in range(2):
        e = np.eye(2)[k] * 1e-6
        assert by_cut[k] == pytest.approx((loss(score, cuts + e) - loss(score, cuts - e)) / 2e-6, abs=1e-5)


def test_held_out_documents_are_graded_right(spark):
    docs, labels = rows()
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = Q.fit(df, lab)
    assert (np.diff(model.cuts) > 0).all()
    got = Q.rate(df, model)
    assert got.columns == ["doc_id", "text", "expected_grade", "top_probability", "selected"] and got.count() == len(docs)
    held = got.where(Q.held_out() & (got["doc_id"] < 2500)).collect()
    want = {d: 0 if t else 1 + q for d, q, t in labels[:2500]}
    assert sum(r["selected"] == (want[r["doc_id"]] == 2) for r in held) > 0.93 * len(held)
    by = lambda k: np.mean([r["expected_grade"] for r in held if want[r["doc_id"]] == k])
    assert by(0) < by(1) < by(2)
    assert all(0 <= r["top_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.collect())


def test_the_worst_label_counts_and_nothing_to_learn_from(spark):
    lab = spark.createDataFrame(rows()[1], "doc_id bigint, quality int, toxic int")
    assert Q.graded(lab).where("doc_id = 9").first()["grade"] == 0
    df = spark.createDataFrame(rows(20)[0], SCHEMA)
    assert {r["selected"] for r in Q.rate(df, Q.fit(df, lab.limit(0))).collect()} == {False}
    assert Q.rate(df.limit(0), Q.fit(df, lab)).count() == 0
