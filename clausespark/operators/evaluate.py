"""Retrieval evaluation: per-question hits and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausespark.operators.lexical import match_tokens

FIELDS = {"code": "doc_hit", "clause_number": "clause_hit", "table_number": "table_hit"}


def cases(questions: DataFrame, results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """One row per question: hits by kind and the reciprocal rank of the first row that matches anything.

    results: qid, rank, code, clause_number, table_number. expected: qid, field, value.
    """
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    top = results.where(F.col("rank") <= max(1, k))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), norm(F.col(f)).alias("value")) for f in FIELDS])
    seen = top.select("qid", "rank", F.explode(pairs).alias("p")).select("qid", "rank", "p.field", "p.value")
    want = expected.select("qid", "field", norm(F.col("value")).alias("value")).where("value <> ''").distinct()
    hit = seen.join(want, ["qid", "field", "value"])
    agg = hit.groupBy("qid").agg(
        F.min("rank").alias("first"), *[F.max(F.col("field") == f).alias(n) for f, n in FIELDS.items()]
    )
    j = questions.join(agg, "qid", "left")
    return j.select(
        "qid",
        F.col("first").isNotNull().alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        *[F.coalesce(n, F.lit(False)).alias(n) for n in FIELDS.values()],
    )


def summary(per_case: DataFrame) -> DataFrame:
    """Rates over all cases; zeros where there is none."""
    rate = lambda c, n: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(n)
    return per_case.agg(
        F.count(F.lit(1)).alias("total"), rate("hit", "hit_rate"), rate("reciprocal_rank", "mrr"),
        rate("doc_hit", "doc_hit_rate"), rate("clause_hit", "clause_hit_rate"), rate("table_hit", "table_hit_rate"),
    )


def containing_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, document_id) of the documents that contain a question word for word.

    Candidates come from equi-joins; only they are compared in full. The first and last word of a passage
    may be glued to other characters in the text, so passages of three and more words are found by a run of
    inner words (at most eight), shorter ones by the tokens that contain their longest word.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    q = questions.select("qid", "question", words(F.col("question")).alias("w")).withColumn("n", F.size("w"))
    inner = F.array_join(F.slice("w", 2, F.least(F.lit(8), F.col("n") - 2)), " ")
    long_q = q.where("n >= 3").withColumn("run", inner).withColumn("len", F.least(F.lit(8), F.col("n") - 2))
    lengths = long_q.agg(F.collect_set("len").alias("ls")).scalar()
    d = documents.select("doc_id", words(F.col("text")).alias("w"), lengths.alias("ls"))

    def runs(n):
        last = F.size("w") - n + 1
        at = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(last >= 1, at).otherwise(F.array().cast("array<string>"))

    e = d.select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform("ls", runs)))).alias("run"))
    found = e.join(long_q.select("qid", "run"), "run").select("qid", "doc_id").distinct()

    by_length = F.array_sort(F.transform("w", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    short_q = q.where("n BETWEEN 1 AND 2").withColumn("term", F.get(by_length, F.lit(0))["t"])
    tokens = documents.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("token"))
    matched = match_tokens(short_q.select("term").distinct(), tokens.select("token").distinct())
    near = tokens.join(matched, "token").join(short_q.select("qid", "term"), "term").select("qid", "doc_id").distinct()

    pairs = found.unionByName(near).join(questions.select("qid", "question"), "qid")
    hit = pairs.join(documents.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("question")))
    return hit.select("qid", F.col("doc_id").alias("document_id"))
