from clausespark.operators import lexical


def test_containing_clauses_without_a_shuffle_of_pairs(spark):
    words = [f"soz{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    clauses = spark.createDataFrame(
        [(f"1:{i}", "bob", f"Xx{w}yy va {w} {words[(i * 7 + 3) % 150]}") for i, w in enumerate(words)] + [("2:1", "bob", None), ("3:1", words[0], "boshqa matn"), ("1:0", "bob", words[9])],
        "clause_id string, chapter_title string, text string",
    )
    asked = [(None if i == 149 else i, w) for i, w in enumerate(words)] + [(0, words[1]), (0, words[0]), (1, "yoq")]
    found = lexical.containing(clauses, spark.createDataFrame(asked, "qid int, term string"))
    want = {(q, c["clause_id"]) for q, t in asked for c in clauses.collect() if t in (c["text"] or "").lower()}
    got = [(r["qid"], r["clause_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "hashpartitioning(qid" not in found._jdf.queryExecution().executedPlan().toString()
