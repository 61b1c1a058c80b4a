"""Reviewed drafts in the verified and rejected tables, beside the votes of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausespark.operators import curate as U
from clausespark.operators import feedback as FB
from clausespark.plans import sql as S
from clausespark.plans.catalog_queries import _DRAFT, HASH_SQL, draft_source_ids, reviewed
from clausespark.plans.chat_queries import _V, votes
from clausespark.plans.registry import query
from clausespark.sources import adapters as A


def _as_votes(spark, sf, drafts):
    """Reviewed drafts with their sources and a review time after all votes."""
    kind = votes(spark, sf).schema["ts"].dataType
    return drafts.select(
        "draft_id", F.lit("2031-01-01 00:00:00").cast(kind).alias("reviewed_at"), "question", "answer", draft_source_ids().alias("source_ids"),
        A.code_of(F.col("document_id")).alias("code"), "clause_number", "short_answer", "job_id",
        *[c for c in ("reason",) if c in drafts.columns],
    )


def _liked(drafts, vote_time):
    """Every fourth draft's answer, as users had voted on it before the review."""
    d = drafts.where("draft_id % 4 = 0").withColumnsRenamed({"draft_id": "event_id", "reviewed_at": "ts"})
    return d.withColumn("ts", F.col("ts") - F.expr(vote_time))


@query(
    "publish_drafts",
    f"""WITH {_DRAFT}, {_V}, ok AS (SELECT *, {S.norm('question')} AS nq, {HASH_SQL} AS hash, regexp_extract(answer, 'kamida (\\d+) mm', 1) || ' mm' AS short FROM valid WHERE k % 11 <> 0 AND k % 3 = 0)
    SELECT normalized_question, source_hash, answer, verified_count, short_answer, code, 'feedback' AS origin_type, NULL::BIGINT AS job_id FROM ver
    UNION ALL SELECT nq, hash, answer, count(*) + count(*) FILTER (k % 4 = 0), max(short), {S.code('max(document_id)')}, 'ai_generated', arg_max(job_id, k) FROM ok GROUP BY nq, hash, answer""",
)
def publish_drafts(spark, sf):
    _, ok, _ = reviewed(spark, sf)
    drafts = _as_votes(spark, sf, ok)
    own = votes(spark, sf).where("vote = 'up'")
    names = ["event_id", "ts", "question", "answer", "source_ids", "code", "clause_number"]
    seen = FB.verified_batch(own.select(names).unionByName(_liked(drafts, "INTERVAL 1 DAY").select(names)))
    table = U.publish(seen, drafts)
    return table.select("normalized_question", "source_hash", "answer", "verified_count", "short_answer", "code", "origin_type", "job_id")


@query(
    "withhold_drafts",
    f"""WITH {_DRAFT}, {_V}, no AS (SELECT *, {S.norm('question')} AS nq, CASE WHEN k % 2 = 0 THEN 'izoh' ELSE 'qa_generator_reject_delete' END AS reason FROM valid WHERE k % 11 <> 0 AND k % 3 = 1)
    SELECT normalized_question, answer, rejected_count, reason, code FROM rej
    UNION ALL SELECT nq, answer, count(*) + count(*) FILTER (k % 4 = 0), arg_max(reason, k), {S.code('arg_max(document_id, k)')} FROM no GROUP BY nq, answer""",
)
def withhold_drafts(spark, sf):
    _, _, no = reviewed(spark, sf)
    refused = _as_votes(spark, sf, no)
    own = votes(spark, sf).where("vote = 'down'")
    names = ["event_id", "ts", "question", "answer", "source_ids", "code", "reason"]
    earlier = _liked(refused, "INTERVAL 1 DAY").withColumn("reason", F.lit(None).cast("string"))
    table = U.withhold(FB.rejected_batch(own.select(names).unionByName(earlier.select(names))), refused)
    return table.select("normalized_question", "answer", "rejected_count", "reason", "code")
