import re
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from clausespark.operators import feedback as FB
from clausespark.operators import ingest
from clausespark.plans import chat_queries
from clausespark.sources import html_files, sinks
from clausespark.streaming import jobs
from test_operators import HTML


def test_page_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.html").write_text(HTML.replace("Yo'lak", f"Yo'lak {i}"), encoding="utf-8")
    jobs.ingest_stream(html_files.read_page_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sinks.latest_documents(spark, str(tmp_path / "out"), "clauses")
    want = ingest.clauses(ingest.segment(html_files.read_pages(spark, str(src))))
    assert sorted(r["text"] for r in got.collect()) == sorted(r["text"] for r in want.collect())
    assert got.count() == 3
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in want.collect()}


def test_a_document_without_images_any_more_keeps_none(spark, tmp_path):
    out = str(tmp_path)
    for n, html in enumerate((HTML, re.sub("<img[^>]*>", "", HTML))):
        jobs.ingest_batch(spark.createDataFrame([("d", html)], "doc_id string, html string"), out, n)
    assert "<img" in HTML and spark.read.parquet(f"{out}/images").count() > 0
    assert sinks.latest_documents(spark, out, "images").count() == 0


def test_a_missing_snapshot_is_an_error(spark, small, tmp_path):
    with pytest.raises(AnalysisException):
        jobs.upsert_batch(chat_queries.votes(spark, small).limit(1), str(tmp_path), 3)


def test_vote_stream_replays(spark, small, tmp_path):
    votes = chat_queries.votes(spark, small)
    for n, part in enumerate((votes.where("event_id < 500"), votes.where("event_id >= 500"))):
        part.write.mode("append").parquet(str(tmp_path / "in" / f"p={n}"))
    stream = spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    jobs.vote_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    versions = len(list((tmp_path / "out" / "verified").glob("v*")))
    last = jobs.snapshot(spark, str(tmp_path / "out"), "verified", versions - 1)
    once = FB.verified_batch(votes.where("vote = 'up'"))
    key = lambda df: sorted((r["normalized_question"], r["source_hash"], r["answer"], r["verified_count"]) for r in df.collect())
    before = key(last)
    assert before == key(once)
    jobs.upsert_batch(votes.limit(0), str(tmp_path / "out"), versions)
    assert key(jobs.snapshot(spark, str(tmp_path / "out"), "verified", versions)) == before


def test_usage_stream(spark, tmp_path):
    m = spark.createDataFrame([("r1", "user")] * 4 + [("r2", "user"), ("r2", "assistant"), (None, "user")], "room string, role string")
    m.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    q = jobs.usage_stream(s).writeStream.outputMode("complete").format("memory").queryName("usage_t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["room"], r["questions"], r["limited"]) for r in spark.table("usage_t").collect()} == {("r1", 4, True), ("r2", 1, False)}


def test_stale_stream(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    schema = "document_id bigint, ts timestamp, status string"
    first = spark.createDataFrame([(1, at(10, 0), "processing"), (2, at(10, 0), "processing"), (2, at(10, 1), "done")], schema)
    second = spark.createDataFrame([(3, at(11, 0), "processing")], schema)
    for n, df in enumerate((first, second)):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stale_stream(s).writeStream.outputMode("append").format("memory").queryName("stale_t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["document_id"] for r in spark.table("stale_t").select("document_id").where(F.col("document_id").isNotNull()).collect()] == [1]
