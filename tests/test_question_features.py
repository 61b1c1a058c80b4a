from pyspark.sql import functions as F

from clausespark.functions import intent as I
from clausespark.functions import numeric as N
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.operators import rerank


def test_shared_parts_of_question_features_are_written_once(spark):
    q = spark.createDataFrame([("3-jadval bo'yicha talab",)], "question string")
    count = lambda c, part: str(q.select(c.alias("v"))._jdf.queryExecution().analyzed()).count(part)
    assert count(I.gates("question")["row_priority"], "\\p{Z}") <= 2
    assert count(I.classify("question", R.exact_refs("question"))["intent"], "metr(?:i|a|)?") <= 4


def test_amounts_agree_with_evidence(spark, one):
    for text in ("qalinligi 12,5 mm yoki 3 sm, 40 %", "kengligi 7 metr", "raqamsiz", ""):
        full = [(e["value"], e["unit"], e["metres"]) for e in one(N.evidence(F.lit(text)))]
        assert [tuple(e) for e in one(X.let(N.simple_norm(F.lit(text)), N.amounts))] == full
    assert one(N.amounts(F.lit(None).cast("string"))) is None


def test_stems_after_any_number_of_passes(one):
    for text, want in (("xona", "xona"), ("xonalar", "xona"), ("kitoblarimizdagilardandagi", "kitoblarimiz"), ("binosisisisisisisisisi", "bino")):
        assert one(X.stem_text(F.lit(text))) == want


def test_mixed_scores_with_features_added_before_the_join(spark):
    refs = R.exact_refs("question")
    q = spark.createDataFrame([(1, "kengligi kamida necha mm"), (2, "3-jadval bo'yicha talab"), (3, None)], "qid int, question string")
    q = q.withColumn("refs", refs).withColumn("intent", I.classify("question", F.col("refs"))["intent"])
    rows = [(i % 3 + 1, f"i{i}", k, 0.1 * i, 0.2, 0.3, f"Detal kengligi kamida {i} mm kerak", "1.1", "3", None) for i, k in enumerate(["clause", "table_row", "image"] * 4)]
    items = spark.createDataFrame(rows, "qid int, item_id string, kind string, score double, semantic double, keyword double, snippet string, clause_number string, table_number string, appendix_number string")
    got = [sorted((r["item_id"], r["score"]) for r in rerank.mixed_scores(items.join(d, "qid")).collect()) for d in (q, rerank.with_question_features(q))]
    assert got[0] == got[1] and len(got[0]) == 12


def test_is_numeric_agrees_with_the_profile_and_builds_none(spark, one):
    for text in ("kengligi kamida necha mm", "balandligi qancha", "eni 3,5 m", "aniq talab", "salom haqida", "", None):
        t = F.lit(text).cast("string")
        assert one(N.is_numeric(t)) == one(N.query_profile(t)["is_numeric"])
    q = spark.createDataFrame([("3-jadval bo'yicha talab",)], "question string")
    for c in (I.classify("question", R.exact_refs("question"))["intent"], I.gates("question")["numeric_requirement"]):
        assert "unit_hints" not in str(q.select(c.alias("v"))._jdf.queryExecution().analyzed())


def test_rerank_scores_with_features_added_before_the_join(spark):
    q = spark.createDataFrame([(1, "kengligi kamida necha mm"), (2, "1.1-band nima deydi"), (3, None), (4, "")], "qid int, question string")
    rows = [(i % 4 + 1, f"c{i}", "1.1", f"Detal kengligi kamida {i} mm kerak", 0.1 * i, 0.2, 0.3) for i in range(12)]
    items = spark.createDataFrame(rows, "qid int, clause_id string, clause_number string, snippet string, hybrid_score double, dense_score double, lexical_score double")
    got = [rerank.rerank_scores(items.join(d, "qid")) for d in (q, rerank.with_question_features(q))]
    assert got[0].columns == got[1].columns
    assert sorted(map(tuple, got[0].select("clause_id", "overlap", "rerank_score").collect())) == sorted(map(tuple, got[1].select("clause_id", "overlap", "rerank_score").collect()))
    # the profile of a question is built from the questions alone
    plan = str(rerank.rerank_scores(items.join(rerank.with_question_features(q), "qid"))._jdf.queryExecution().optimizedPlan())
    assert "unit_hints, array_distinct" in plan and "unit_hints, array_distinct" not in plan[:plan.index("Join")]
