"""Continuous jobs: page ingestion, vote upserts, guest usage and stale progress."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausespark import constants as K
from clausespark.operators import feedback as FB
from clausespark.operators import ingest
from clausespark.session import cut_lineage
from clausespark.sources import sinks


def ingest_batch(pages: DataFrame, out: str, batch_id: int) -> None:
    """Chapters, clauses, tables and images of one set of pages, and which pages these were, under the batch number."""
    seg = cut_lineage(ingest.segment(pages))
    for name, df in (("chapters", ingest.chapters(seg)), ("clauses", ingest.clauses(seg)), ("tables", ingest.tables(seg)), ("images", ingest.images(seg))):
        sinks.write_batch(df, f"{out}/{name}", batch_id)
    sinks.write_batch(pages.select("doc_id").distinct(), f"{out}/{sinks.INGESTED}", batch_id)


def ingest_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Ingest files as they arrive; a repeated batch rewrites its own partition."""
    return (
        pages.writeStream.foreachBatch(lambda df, n: ingest_batch(df, out, n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_batch(votes: DataFrame, out: str, batch_id: int) -> None:
    """Merge one batch of votes into the verified and rejected snapshots.

    Each batch writes its own snapshot version from the one before it, so a repeated batch gives the same
    version again and readers never see a half-written one under the number they use.
    """
    parts = (
        ("verified", FB.verified_batch(votes.where("vote = 'up'")), FB.VERIFIED_KEY, "verified_count"),
        ("rejected", FB.rejected_batch(votes.where("vote = 'down'")), FB.REJECTED_KEY, "rejected_count"),
    )
    for name, batch, key, count in parts:
        old = snapshot(votes.sparkSession, out, name, batch_id - 1)
        merged = batch if old is None else FB.upsert(old, batch, key, count)
        merged.write.mode("overwrite").parquet(f"{out}/{name}/v{batch_id}")


def snapshot(spark: SparkSession, out: str, name: str, batch_id: int) -> DataFrame | None:
    """A snapshot version, or None before the first batch. A missing version is an error, not an empty history."""
    return spark.read.parquet(f"{out}/{name}/v{batch_id}") if batch_id >= 0 else None


def vote_stream(votes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        votes.writeStream.foreachBatch(lambda df, n: upsert_batch(df, out, n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def usage_stream(messages: DataFrame, limit: int = K.GUEST_LIMIT) -> DataFrame:
    """Running number of guest questions per room. messages: room, role."""
    q = messages.where((F.col("role") == "user") & F.col("room").isNotNull())
    return q.groupBy("room").agg(F.count(F.lit(1)).alias("questions")).withColumn("limited", F.col("questions") >= limit)


def stale_stream(progress: DataFrame, minutes: int = K.STALE_DOC_MINUTES) -> DataFrame:
    """Documents that stayed in processing without a touch for too long, by event time.

    progress: document_id, ts, status.
    """
    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            touched, _ = state.get
            state.remove()
            yield pd.DataFrame({"document_id": [key[0]], "last_touch": [touched]})
            return
        touched, status = state.get if state.exists else (pd.Timestamp.min, "")
        for frame in frames:
            newest = frame.sort_values("ts").iloc[-1]
            if newest["ts"] >= touched:
                touched, status = newest["ts"], newest["status"]
        if status == "processing":
            state.update((touched, status))
            due = int((touched + timedelta(minutes=minutes)).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return (
        progress.withWatermark("ts", "0 seconds").groupBy("document_id").applyInPandasWithState(
            watch, "document_id bigint, last_touch timestamp", "touched timestamp, status string", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
