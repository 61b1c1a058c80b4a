"""Searches inside scopes against searches over the scope's clauses alone."""

import random

import pytest
from pyspark.sql import functions as F

from clausespark.operators import answering as Q
from clausespark.operators import candidates as C
from clausespark.operators import lexical, vector
from clausespark.operators.scope import Scopes

WORDS = "concrete beton mortar brick window panel anchor bracket insulation thickness foundation ventilation".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    # one document holds a third of the clauses, one clause has no code
    code = lambda i: None if i == 7 else "A 1.01-05" if i % 3 == 0 else f"B {i % 5}.02-06"
    rows = [(f"c{i:03d}", code(i), f"{i}", "1-bob", " ".join(rng.choices(WORDS, k=9))) for i in range(120)]
    c = spark.createDataFrame(rows, "clause_id string, code string, clause_number string, chapter_title string, text string")
    q = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 4))) for i in range(6)], "qid bigint, question string")
    return q, c.withColumn("document_id", F.col("code")).cache()


def listed(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scoped_lists_equal_lists_over_the_scope_alone(spark, corpus):
    q, c = corpus
    # 0: all, 1: null scope, 2 and 3 share two documents (other spelling, repeated), 4: nothing, 5: the hot document
    assigned = spark.createDataFrame([(1, None), (2, "two"), (3, "two"), (4, "none"), (5, "hot"), (9, "hot")], "qid bigint, scope string")
    members = spark.createDataFrame(
        [("two", "b1.02-06"), ("two", "B 1.02-06"), ("two", "B 2.02-06"), ("two", None), ("hot", "A 1.01-05"), (None, "B 3.02-06")], "scope string, code string"
    )
    s = Scopes(assigned, members)
    parts = {(0, 1): c, (2, 3): c.where("code IN ('B 1.02-06', 'B 2.02-06')"), (5,): c.where("code = 'A 1.01-05'")}
    lex, dense = lexical.retrieve(q, c, 5, scopes=s), C.dense_list(q, c, 5, s)
    want_lex, want_dense = [], []
    for asking, part in parts.items():
        own = q.where(F.col("qid").isin(*asking))
        want_lex += listed(lexical.retrieve(own, part, 5), "qid", "clause_id", "lexical_score", "lexical_rank")
        want_dense += listed(C.dense_list(own, part, 5), "qid", "clause_id", "dense_score", "dense_rank")
    assert listed(lex, "qid", "clause_id", "lexical_score", "lexical_rank") == sorted(want_lex)
    assert listed(dense, "qid", "clause_id", "dense_score", "dense_rank") == sorted(want_dense)


def test_scopes_of_pairs_share_equal_sets(spark, corpus):
    q, c = corpus
    pairs = spark.createDataFrame([(1, "B 1.02-06"), (1, "B 2.02-06"), (2, "b 2.02-06"), (2, "B 1.02-06"), (2, "B 1.02-06"), (3, "B 3.02-06"), (4, None)], "qid bigint, code string")
    s = Scopes.of_pairs(pairs)
    keys = dict(listed(s.assigned, "qid", "scope"))
    assert keys[1] == keys[2] != keys[3] and set(keys) == {1, 2, 3}
    assert s.members.count() == 3
    found = lexical.retrieve(q, c, 200, scopes=s).join(c, "clause_id").where("qid IN (1, 2, 3)").select("qid", "code").distinct()
    allowed = {(1, "B 1.02-06"), (1, "B 2.02-06"), (2, "B 1.02-06"), (2, "B 2.02-06"), (3, "B 3.02-06")}
    got = set(listed(found, "qid", "code"))
    assert got and got <= allowed


def test_empty_scopes_and_tables(spark, corpus):
    q, c = corpus
    none = Scopes(spark.createDataFrame([], "qid bigint, scope string"), spark.createDataFrame([], "scope string, code string"))
    cols = ("qid", "clause_id", "lexical_score", "lexical_rank")
    assert listed(lexical.retrieve(q, c, 4, scopes=none), *cols) == listed(lexical.retrieve(q, c, 4), *cols)
    assert lexical.retrieve(q, c.limit(0), 4, scopes=none).count() == 0
    assert C.dense_list(q.limit(0), c, 4, none).count() == 0


def test_block_pairs_keep_scopes(spark, corpus):
    q, c = corpus
    v = c.selectExpr("clause_id AS id", "array(double(length(text)), double(crc32(text) % 97)) AS vector", "array_remove(array(nvl(code, '')), '') AS scopes")
    asked = spark.range(40).selectExpr("id AS qid", "array(double(id + 1), 50D) AS vector", "CASE WHEN id % 2 = 0 THEN '' ELSE 'A 1.01-05' END AS within")
    a, b = vector.top_k(asked, v, 3, 2), vector.top_k(asked, v, 3, 2, block_rows=7, slice_rows=30)
    assert listed(a, "qid", "id", "rank") == listed(b, "qid", "id", "rank")
    codes = a.where("qid % 2 = 1").join(c, F.col("id") == F.col("clause_id")).select("code").distinct()
    assert listed(codes, "code") == [("A 1.01-05",)]


def test_explicit_codes_bypass_routing(spark):
    score = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.5), (2, "A", 0.9), (3, "B", 0.4)], "qid bigint, code string, doc_score double")
    named = spark.createDataFrame([(1, "C"), (3, "A")], "qid bigint, code string")
    given = spark.createDataFrame([(1, " z ", 0), (1, "Y", 1), (1, "Z", 2), (2, " ", 0), (4, "Q", 0), (4, None, 1)], "qid bigint, code string, pos int")
    r = Q.route([(score, 1.0)], named, given)
    got = listed(r.where("selected"), "qid", "rank", "code")
    assert got == [(1, 1, "z"), (1, 2, "Y"), (2, 1, "A"), (3, 1, "A"), (3, 2, "B"), (4, 1, "Q")]
    assert r.where("qid IN (1, 4) AND score IS NOT NULL").count() == 0
