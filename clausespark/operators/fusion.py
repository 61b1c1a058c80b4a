"""Fusion of ranked lists and weighted merges of candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark import constants as K


def reciprocal_rank(dense: DataFrame, lexical: DataFrame, k: int = K.RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over both lists, with the best score of each: ordered by ``fused_rank``.

    The lists are bounded by their k per question, so the per-question window is small.
    """
    d = dense.select(
        "qid", "clause_id", "dense_rank", "dense_score", F.lit(None).cast("bigint").alias("lexical_rank"), F.lit(0.0).alias("lexical_score")
    )
    x = lexical.select(
        "qid", "clause_id", F.lit(None).cast("bigint").alias("dense_rank"), F.lit(0.0).alias("dense_score"), "lexical_rank", "lexical_score"
    )
    g = d.unionByName(x).groupBy("qid", "clause_id").agg(
        F.max("dense_rank").alias("dense_rank"),
        F.max("dense_score").alias("dense_score"),
        F.max("lexical_rank").alias("lexical_rank"),
        F.max("lexical_score").alias("lexical_score"),
    )
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    g = g.withColumn("hybrid_score", F.round(part("dense_rank") + part("lexical_rank"), 12))
    w = Window.partitionBy("qid").orderBy(F.desc("hybrid_score"), "clause_id")
    return g.withColumn("fused_rank", F.row_number().over(w).cast("bigint"))


def shown_texts(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """(qid, clause_id, snippet, title, code) of every clause of both lists, each (qid, clause_id) once per list.

    What the dense list says stands, but a longer lexical snippet, a lexical title that names a number and a
    lexical code where the dense one is missing take its place. Null counts as empty.
    """
    names = ("snippet", "title", "code")
    own = lambda df, a: df.select("qid", "clause_id", F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in names]).alias(a))
    none = lambda df, a: F.lit(None).cast(own(df, a).schema[a].dataType).alias(a)
    d = own(dense, "d").select("*", none(dense, "x"))
    x = own(lexical, "x").select("qid", "clause_id", none(lexical, "d"), "x")
    g = d.unionByName(x).groupBy("qid", "clause_id").agg(F.first("d", ignorenulls=True).alias("d"), F.first("x", ignorenulls=True).alias("x"))

    def pick(name: str, better: Column) -> Column:
        return F.when(F.col("d").isNull() | (F.col("x").isNotNull() & better), F.col(f"x.{name}")).otherwise(F.col(f"d.{name}")).alias(name)

    return g.select(
        "qid", "clause_id", pick("snippet", F.length("x.snippet") > F.length("d.snippet")),
        pick("title", ~F.col("x.title").isin("", K.UNNUMBERED_TITLE)), pick("code", F.col("d.code") == ""),
    )


def merge_key() -> Column:
    """Identity of a candidate: its kind and the first id it carries, rows going by their table."""
    nb = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.concat(F.col("kind"), F.lit(":"), F.coalesce(nb("clause_id"), nb("table_id"), nb("image_id"), F.col("title"), F.lit("")))


def merge_weighted(primary: DataFrame, secondary: DataFrame, weight: float | Column, order: str = "item_id") -> DataFrame:
    """Best row per (qid, key) of both lists, the second weighted; a tie keeps the first list's row.

    Only the winning row of a key is kept, by a map-side combinable ``max_by``.
    """
    w = weight if isinstance(weight, Column) else F.lit(weight)
    a = primary.withColumn("_src", F.lit(1))
    b = secondary.withColumn("score", F.col("score") * w).withColumn("_src", F.lit(0)).select(a.columns)
    both = a.unionByName(b).withColumn("_key", merge_key())
    row = F.struct(*[F.col(c) for c in a.columns])
    pick = F.max_by(row, F.struct(F.col("score"), F.col("_src"), F.col(order))).alias("r")
    return both.groupBy("qid", "_key").agg(pick).select("r.*").drop("_src")
