import random

import pytest
from clausespark.operators import lexical


def tables(spark):
    """Clauses whose ids repeat or are null, questions that share an id, with and without the same text."""
    rng = random.Random(3)
    vocab = ["kenglik", "masofa", "bino", "yo'lak", "balandlik", "eshik", "qavat", "zinapoya", "eni", "kengliklari"]
    rows = [(rng.choice([str(i), str(i), str(i // 2), None]), f"{i % 4}-bob", "umumiy " + " ".join(rng.choice(vocab) for _ in range(4))) for i in range(150)]
    rows += [("x", None, "eshik"), ("y", "bino", None), ("z", None, None), ("c", "1-bob", "masofa eshik"), ("b", "1-bob", "masofa eshik")]
    qs = [(i, f"umumiy {rng.choice(vocab)} {rng.choice(vocab)} haqida") for i in range(12)]
    qs += [(3, "eshik masofa"), qs[4], (None, "bino qavat"), (50, None), (51, "zzz"), (52, "")]
    return spark.createDataFrame(qs, "qid int, question string"), spark.createDataFrame(rows, "clause_id string, chapter_title string, text string")


@pytest.mark.parametrize("k", [1, 7, 400])
def test_both_forms_give_the_same_rows(spark, k):
    questions, clauses = tables(spark)
    terms = lexical.question_terms(questions)
    want = lexical.top_clauses(lexical.score_candidates(terms, lexical.term_hits(lexical.clause_tokens(clauses), terms)), k)
    got = lexical.retrieve(questions, clauses, k)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df.select("qid", "clause_id", "lexical_score", "coverage", "tf", "lexical_rank").collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 10


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 40)
    questions, clauses = tables(spark)
    clauses = clauses.where("clause_id IS NOT NULL")  # the pruned form joins on it
    found = lexical.retrieve(questions, clauses, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert not [x for x in keys if "qid" in x and "clause_id" in x]
    many = lexical.matches(questions, clauses)
    want = lexical.top_clauses(lexical.top_scored(*many, 5), 5)
    assert sorted(map(str, found.select("qid", "clause_id", "lexical_rank").collect())) == sorted(map(str, want.select("qid", "clause_id", "lexical_rank").collect()))
    empty = lexical.retrieve(questions.limit(0), clauses, 5).count(), lexical.retrieve(questions, clauses.limit(0), 5).count()
    assert empty == (0, 0)
