"""Feature reranking, greedy suppression of near duplicates and mixed-kind reranking.

All of these work on candidate lists that an earlier top k has bounded per question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import numeric as N
from clausespark.functions import text as X


def similarity(a: Column, b: Column) -> Column:
    """Shared stems over the larger fingerprint."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def suppress(
    items: DataFrame, order: str, scope: Column | None, fingerprint: Column, identity: Column | None = None,
    threshold: float = K.DUPLICATE_SIM, limit: int | None = None,
) -> DataFrame:
    """Walk each question's list in order and drop items like an earlier kept one.

    The walk is a fold over the (bounded) list of a question. ``scope`` restricts comparison to equal
    values, ``identity`` drops exact repeats first, ``limit`` keeps the first so many.
    Adds ``removed``, the number of items dropped before the list was full.
    """
    columns = items.columns
    e = F.struct(
        F.col(order).alias("o"),
        (scope if scope is not None else F.lit("")).alias("g"),
        (identity if identity is not None else F.lit(None).cast("string")).alias("k"),
        fingerprint.alias("fp"),
        F.struct(*[F.col(c) for c in columns]).alias("row"),
        F.lit(0).alias("dropped"),
    )
    lists = items.select("qid", e.alias("e")).groupBy("qid").agg(F.array_sort(F.collect_list("e"), _by_order).alias("es"))

    def step(acc: Column, x: Column) -> Column:
        same = F.exists(
            acc["kept"],
            lambda y: (y["k"] == x["k"])
            | ((y["g"] == x["g"]) & (F.size(x["fp"]) > 0) & (similarity(y["fp"], x["fp"]) >= threshold)),
        )
        full = F.size(acc["kept"]) >= limit if limit else F.lit(False)
        return F.when(full, acc).otherwise(
            F.struct(
                F.when(F.coalesce(same, F.lit(False)), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"),
                (acc["removed"] + F.coalesce(same, F.lit(False)).cast("int")).alias("removed"),
            )
        )

    start = F.struct(F.slice("es", 1, 0).alias("kept"), F.lit(0).alias("removed"))
    folded = lists.select("qid", F.aggregate("es", start, step).alias("f"))
    out = folded.select(F.col("f.removed").alias("removed"), F.posexplode("f.kept").alias("final_pos", "x"))
    return out.select("x.row.*", (F.col("final_pos") + 1).cast("bigint").alias("final_rank"), F.col("removed").cast("bigint").alias("removed"))


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)


def rerank_scores(items: DataFrame) -> DataFrame:
    """Feature score of fused candidates.

    items: qid, question, clause_id, clause_number, snippet, hybrid_score, dense_score, lexical_score;
    the columns of ``with_question_features`` are added where they are missing.
    """
    t = items if "_terms" in items.columns else with_question_features(items)
    t = t.withColumn("_low", F.lower("snippet"))
    t = t.withColumn("overlap", X.term_coverage(F.col("_terms"), F.col("_low")))
    t = t.withColumn("_num", F.when(F.col("_p.is_numeric"), N.match(F.col("_p"), F.col("snippet"))["score"]))
    n = F.size("_terms")
    coverage = F.col("overlap") / F.greatest(n, F.lit(1))
    exact = F.when((F.coalesce(F.col("clause_number"), F.lit("")) != "") & F.contains("question", F.col("clause_number")), 0.12).otherwise(0.0)
    numeric = F.when(
        F.col("_p.is_numeric"), F.col("_num") * 0.22 - F.when(F.col("_num") <= 0.01, 0.03).otherwise(0.0)
    ).otherwise(0.0)
    score = (
        F.col("hybrid_score") * 0.52
        + F.col("dense_score") * 0.24
        + F.col("lexical_score") * 0.12
        + coverage * 0.12
        + exact
        + numeric
        + F.least(F.lit(0.03), F.log1p("overlap") * 0.01)
    )
    t = t.withColumn("rerank_score", F.round(F.when(n > 0, score).otherwise(F.col("hybrid_score")), 9))
    return t.drop("_terms", "_low", "_p", "_num")


def rerank(items: DataFrame, candidates: int | Column = K.RERANK_CANDIDATES, limit: int = K.TOP_K) -> DataFrame:
    """Rerank the first fused candidates, drop near duplicates inside a document, keep ``limit``."""
    s = rerank_scores(items.where(F.col("fused_rank") <= candidates))
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "clause_id")
    s = s.withColumn("rerank_rank", F.row_number().over(w).cast("bigint"))
    kept = suppress(s, "rerank_rank", F.lower(F.trim("code")), X.fingerprint("snippet"))
    return kept.where(F.col("final_rank") <= limit)


def with_question_features(questions: DataFrame) -> DataFrame:
    """Terms and profile of each question, for ``rerank_scores`` and ``mixed_scores``; added before questions meet their items."""
    return questions.withColumn("_terms", F.array_distinct(X.tokenize("question"))).withColumn("_p", N.query_profile("question"))


def mixed_scores(items: DataFrame) -> DataFrame:
    """Scores of clauses, rows and images in one list.

    items: qid, question, intent, refs, kind, score, semantic, keyword, snippet, clause_number,
    table_number, appendix_number; the columns of ``with_question_features`` are added where they are missing.
    """
    t = items if "_terms" in items.columns else with_question_features(items)
    t = t.withColumn("_o", X.term_coverage(F.col("_terms"), X.lower_squeeze("snippet")))
    wants = F.col("_p.is_numeric") & F.col("kind").isin("clause", "table_row")
    t = t.withColumn("_num", F.when(wants, N.match(F.col("_p"), F.col("snippet"))["score"]))
    numeric = F.when(wants, F.col("_num") * 0.2 - F.when(F.col("_num") <= 0.01, 0.03).otherwise(0.0)).otherwise(0.0)
    bonus = (
        F.when((F.col("intent") == "table_lookup") & (F.col("kind") == "table_row"), 0.22)
        .when((F.col("intent") == "image_lookup") & (F.col("kind") == "image"), 0.25)
        .when((F.col("intent") == "exact_band_reference") & (F.col("kind") == "clause"), 0.2)
        .otherwise(0.0)
    )

    def named(values: Column, column: str, gain: float) -> Column:
        mine = X.lower_squeeze(column)
        hit = F.exists(values, lambda v: X.lower_squeeze(v) == mine)
        return F.when(hit, gain).otherwise(0.0)

    score = (
        F.col("score")
        + F.col("_o") / F.greatest(F.size("_terms"), F.lit(1)) * 0.17
        + F.coalesce("semantic", F.lit(0.0)) * 0.06
        + F.coalesce("keyword", F.lit(0.0)) * 0.08
        + numeric
        + bonus
        + named(F.col("refs.clause_numbers"), "clause_number", 0.35)
        + named(F.col("refs.table_numbers"), "table_number", 0.4)
        + named(F.col("refs.appendix_numbers"), "appendix_number", 0.22)
        + F.least(F.lit(0.04), F.log1p("_o") * 0.015)
    )
    return t.withColumn("score", F.round(score, 9)).drop("_terms", "_o", "_p", "_num")


def rerank_mixed(items: DataFrame, limit: int = K.FINAL_K, order: str = "item_id") -> DataFrame:
    """Mixed-kind rerank with identity and near-duplicate suppression over the whole list."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), order)
    s = mixed_scores(items).withColumn("mixed_rank", F.row_number().over(w).cast("bigint"))
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    identity = F.concat_ws(":", part("kind"), part("clause_id"), part("table_id"), part("image_id"), part("title"))
    return suppress(s, "mixed_rank", None, X.fingerprint("snippet"), identity, limit=max(1, limit))
