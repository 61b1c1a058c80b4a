from clausespark.operators import candidates


def test_vectors_of_items_are_not_broadcast(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "qid int, row_id int")
    texts = spark.createDataFrame([(1, "ustun eni"), (2, "tom"), (3, None)], "row_id int, text string")
    questions = spark.createDataFrame([(1, "ustun"), (2, "eni")], "qid int, question string")
    scored = candidates.pair_semantic(
        pairs, candidates.with_vector(questions, "question", "qid", "qid"), candidates.with_vector(texts, "text", "row_id", "id"), "row_id"
    )
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [row_id" in plan
    assert {(r["qid"], r["row_id"]): round(r["semantic"], 6) for r in scored.collect()} == {(1, 1): 0.707107, (1, 2): 0.0, (2, 3): 0.0}
