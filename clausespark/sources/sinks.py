"""Sinks: partitioned tables replaced per document bucket, keyed vector tables and append logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.session import cut_lineage

#: Table of the documents of each batch, beside the tables of their parts.
INGESTED = "ingested"


def bucket(key: Column, buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def refresh_document_table(fresh: DataFrame, path: str, key: str = "doc_id", buckets: int = 256) -> None:
    """Replace the rows of the documents in ``fresh``; only their buckets are read and rewritten.

    The merged buckets go through the scratch folder first, since a table cannot be overwritten while it
    is read. Running it again gives the same table.
    """
    spark = fresh.sparkSession
    out = fresh.withColumn("doc_bucket", bucket(F.col(key), buckets).cast("int"))
    stored = _stored(spark, path)
    if stored is not None:
        touched = [r[0] for r in out.select("doc_bucket").distinct().collect()]  # at most ``buckets`` numbers
        kept = stored.where(F.col("doc_bucket").isin(touched))  # prunes partitions
        kept = kept.join(out.select(key).distinct(), key, "left_anti")
        out = cut_lineage(kept.select(out.columns).unionByName(out))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none yet; any other failure to read it is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One partition per micro-batch; writing a batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def latest_documents(spark: SparkSession, out: str, name: str, key: str = "doc_id") -> DataFrame:
    """Rows of table ``name`` from the last batch that ingested each document, whether or not it had such rows then."""
    last = spark.read.parquet(f"{out}/{INGESTED}").groupBy(key).agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{out}/{name}").join(last, [key, "batch_id"], "left_semi").drop("batch_id")


def upsert_points(stored: DataFrame, batch: DataFrame, dim: int) -> DataFrame:
    """Points (id, vector, payload) after an upsert by id; vectors of another length are refused.

    Of several points with one id in a batch the last one in the batch's order counts.
    """
    good = batch.where(F.size("vector") == dim).withColumn("_at", F.monotonically_increasing_id())
    row = F.struct(*[F.col(c) for c in stored.columns])
    good = good.groupBy("id").agg(F.max_by(row, "_at").alias("r")).select("r.*")
    return stored.join(good.select("id"), "id", "left_anti").unionByName(good.select(stored.columns))
