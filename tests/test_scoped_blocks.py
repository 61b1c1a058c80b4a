"""Scoped and repeated searches that keep pairs of question and clause, and texts, out of the shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from clausespark.operators import candidates as C
from clausespark.operators import lexical
from clausespark.operators.scope import Scopes

VOCAB = ["kenglik", "masofa", "bino", "yo'lak", "balandlik", "eshik", "qavat", "zinapoya", "eni", "kengliklari"]


@pytest.fixture(scope="module")
def tables(spark):
    """Clauses whose ids repeat, are null or have no code, and questions that share an id."""
    rng = random.Random(5)
    rows = [
        (rng.choice([f"c{i}", f"c{i}", f"c{i // 2}", None]), rng.choice(["A 1", "B 2", "C 3", None]), f"1.{i}", "1-bob",
         "umumiy " + " ".join(rng.choice(VOCAB) for _ in range(4))) for i in range(90)
    ]
    rows += [("twice", "A 1", "2", "1-bob", "eshik masofa"), ("twice", "A 1", "2", "1-bob", "eshik masofa"), ("twice", "B 2", "2", "1-bob", "zzz"), ("c0", "C 3", "2", None, None)]
    qs = [(i, f"umumiy {rng.choice(VOCAB)} {rng.choice(VOCAB)} haqida") for i in range(9)] + [(2, "eshik masofa"), (20, None), (21, "zzz")]
    c = spark.createDataFrame(rows, "clause_id string, code string, clause_number string, chapter_title string, text string")
    assigned = [(1, None), (2, "ab"), (3, "ab"), (3, "c"), (4, "none"), (5, "c"), (21, "ab")]
    members = [("ab", "a1"), ("ab", "A 1"), ("ab", "B 2"), ("ab", None), ("c", "C 3"), (None, "B 2")]
    s = Scopes(spark.createDataFrame(assigned, "qid int, scope string"), spark.createDataFrame(members, "scope string, code string"))
    return spark.createDataFrame(qs, "qid int, question string"), c.withColumn("document_id", F.col("code")), s


@pytest.mark.parametrize("k", [2, 300])
def test_scoped_forms_give_the_same_rows(tables, k, monkeypatch):
    questions, clauses, scopes = tables
    want = lexical.top_clauses(lexical.score_candidates(*lexical.matches(questions, clauses, None, scopes)), k)
    columns = ("qid", "clause_id", "lexical_score", "coverage", "tf", "lexical_rank")
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    expected = rows(want)

    def unread(*_):
        raise AssertionError("tokens of the corpus are written")

    monkeypatch.setattr(lexical, "clause_tokens", unread)
    monkeypatch.setattr(lexical, "CELLS", 50)
    assert rows(lexical.retrieve(questions, clauses, k, scopes=scopes)) == expected and len(expected) > 10


@pytest.mark.parametrize("scoped", [False, True])
def test_a_search_works_clauses_out_once(spark, tables, scoped):
    questions, clauses, scopes = tables
    clauses = clauses.where("clause_id IS NOT NULL")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    seen = clauses.withColumn("text", counted.asNondeterministic()("text"))
    got = C.hybrid(questions, seen, scopes=scopes if scoped else None)
    columns = ("qid", "clause_id", "code", "score")
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, C.hybrid(questions, clauses, scopes=scopes if scoped else None).select(*columns).collect()))
    assert read.value == clauses.count()


@pytest.mark.parametrize("name", ["dual_phrase_merge", "scoped_discovery"])
def test_queries_of_several_searches_work_clauses_out_once(spark, tables, name, monkeypatch):
    from clausespark.plans import load
    from clausespark.sources import adapters

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    questions, clauses, _ = tables
    clauses = clauses.where("clause_id IS NOT NULL").withColumn("chapter_order", F.lit(1))
    documents = spark.createDataFrame([(i, "src", c) for i, c in enumerate(["A 1", "B 2", "C 3"])], "document_id int, category_code string, code string")
    monkeypatch.setattr(adapters, "questions", lambda *_: questions.where("qid < 6"))
    monkeypatch.setattr(adapters, "documents", lambda *_: documents)
    monkeypatch.setattr(adapters, "clauses", lambda *_: clauses.withColumn("text", counted.asNondeterministic()("text")))
    assert load().queries[name](spark, "").count() > 0
    assert read.value == clauses.count()


def test_seeded_forms_give_the_same_rows(tables, monkeypatch):
    questions, clauses, _ = tables
    rows = lambda df: sorted(map(str, df.select("qid", "id", "score", "rank").collect()))
    with monkeypatch.context() as m:
        m.setattr(lexical, "BLOCK_ROWS", 0)
        expected = rows(C.seeded_dense(questions, clauses, 4))
    monkeypatch.setattr(lexical, "CELLS", 50)
    found = C.seeded_dense(questions, clauses, 4)
    assert rows(found) == expected and len(expected) > 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan


def test_keyword_forms_give_the_same_rows(spark, tables, monkeypatch):
    questions, clauses, _ = tables
    # half of the questions ask for a length, which some clauses state
    more = [(30, "eshik kengligi kamida 20 mm"), (31, "masofa kamida 3 m bino qavat"), (31, "bino"), (32, "eshik necha sm"), (None, "eshik kamida 20 mm")]
    questions = questions.unionByName(spark.createDataFrame(more, "qid int, question string"))
    stated = F.when(F.crc32("text") % 3 == 0, F.concat("text", F.lit(" kengligi kamida 20 mm kerak"))).otherwise(F.col("text"))
    clauses = clauses.withColumn("text", stated)
    columns = ("qid", "clause_id", "score", "keyword", "numeric", "rank")
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    with monkeypatch.context() as m:
        m.setattr(lexical, "BLOCK_ROWS", 0)
        expected = rows(C.keyword_fallback(questions, clauses, 3))
    monkeypatch.setattr(lexical, "CELLS", 50)
    found = C.keyword_fallback(questions, clauses, 3)
    assert rows(found) == expected and len(expected) > 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert not [x for x in keys if "qid" in x and "clause_id" in x]
