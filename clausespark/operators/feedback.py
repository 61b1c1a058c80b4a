"""Votes to verified and rejected answers, the answer cache and penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.operators import vector
from clausespark.session import cut_lineage

VERIFIED_KEY = ["normalized_question", "source_hash", "answer"]
REJECTED_KEY = ["normalized_question", "answer"]


EVENT = ("ts", "event_id")


def _stamps(first: str, last: tuple[str, ...]) -> Column:
    """When each value was given: its first event for ``first``, the last one with a value for the others."""
    fields = [F.min(F.struct(*EVENT)).alias(first)]
    return F.struct(*fields, *[F.max(F.when(F.col(c).isNotNull(), F.struct(*EVENT))).alias(c) for c in last]).alias("stamps")


def _latest(column: str) -> Column:
    """Last supplied value by time; a null never overwrites."""
    at = F.when(F.col(column).isNotNull(), F.struct("ts", "event_id"))
    return F.max_by(F.col(column), at).alias(column)


def verified_batch(votes: DataFrame) -> DataFrame:
    """Up-votes collapsed to one row per key with map-side combinable aggregates.

    votes: event_id, ts, question, answer, source_ids, code, clause_number.
    """
    v = votes.withColumn("normalized_question", X.normalize_text("question")).withColumn("source_hash", R.source_hash(F.col("source_ids")))
    return v.groupBy(*VERIFIED_KEY).agg(
        F.count(F.lit(1)).alias("verified_count"), F.max("ts").alias("updated_at"), F.min_by("question", F.struct("ts", "event_id")).alias("original_question"),
        _latest("code"), _latest("clause_number"), _latest("source_ids"),
        X.short_answer(F.max("answer")).alias("short_answer"), _stamps("original_question", ("code", "clause_number", "source_ids")),
    )


def rejected_batch(votes: DataFrame) -> DataFrame:
    """Down-votes collapsed per key: sources and document of the latest vote, the latest given reason."""
    v = votes.withColumn("normalized_question", X.normalize_text("question"))
    last = _latest
    return v.groupBy(*REJECTED_KEY).agg(
        F.count(F.lit(1)).alias("rejected_count"), F.max("ts").alias("rejected_at"), F.min_by("question", F.struct("ts", "event_id")).alias("original_question"),
        last("code"), last("source_ids"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.struct("ts", "event_id"))).alias("reason"),
        _stamps("original_question", ("code", "source_ids", "reason")),
    )


def upsert(snapshot: DataFrame, batch: DataFrame, key: list[str], count: str) -> DataFrame:
    """Merge a batch into a snapshot, whatever the order in which the events of the two arrived.

    Counts add, times take the later one, and a stamped value goes by its event: the earliest for the first
    question, else the latest that gave a value. Other columns follow from the key.
    """
    s = snapshot.select(*[F.col(c).alias(f"_o_{c}") if c not in key else F.col(c) for c in snapshot.columns])
    j = s.join(batch, key, "full_outer")
    stamped = snapshot.schema["stamps"].dataType.names
    first = stamped[0]

    def pick(c: str) -> Column:
        old, new = F.col(f"_o_stamps.{c}"), F.col(f"stamps.{c}")
        better = new < old if c == first else new > old
        return F.when(old.isNull() | better, F.col(c)).otherwise(F.col(f"_o_{c}"))

    def merged(c: str) -> Column:
        if c in key:
            return F.col(c)
        if c == count:
            return F.coalesce(f"_o_{c}", F.lit(0)) + F.coalesce(c, F.lit(0))
        if c.endswith("_at"):
            return F.greatest(f"_o_{c}", c)
        if c == "stamps":
            both = lambda f, n: f(F.col(f"_o_stamps.{n}"), F.col(f"stamps.{n}")).alias(n)
            return F.struct(*[both(F.least if n == first else F.greatest, n) for n in stamped])
        return pick(c) if c in stamped else F.coalesce(f"_o_{c}", c)

    return j.select(*[merged(c).alias(c) for c in snapshot.columns])


def active(verified: DataFrame) -> DataFrame:
    """Rows that are not switched off; without an ``is_active`` column all are."""
    return verified.where(F.coalesce("is_active", F.lit(True))) if "is_active" in verified.columns else verified


def cache_exact(questions: DataFrame, verified: DataFrame) -> DataFrame:
    """Exact cache: (qid, blocked, answer). Rows of another document block the semantic step.

    questions: qid, normalized_question, doc_key (or empty). Inactive rows neither answer nor block.
    The best row per question text, and per text and document, is known before questions are joined, so a question
    meets at most one row however many answers its text has.
    """
    order = F.struct("verified_count", "updated_at", "answer", "source_hash")
    v = active(verified).withColumn("doc_key", F.explode(F.array_distinct(F.array_compact(F.array(F.lit(""), R.code_key("code"))))))
    best = v.groupBy("normalized_question", "doc_key").agg(F.max_by(F.struct("answer", "code"), order).alias("hit"), F.max(order).alias("order"))
    best = cut_lineage(best)  # read twice
    known = questions.join(best.where("doc_key = ''").select("normalized_question"), "normalized_question", "left_semi")
    j = known.select("qid", "normalized_question", "doc_key").join(best, ["normalized_question", "doc_key"], "left")
    g = j.groupBy("qid").agg(F.max_by("hit", "order").alias("hit"))
    return g.select("qid", F.col("hit.answer").alias("answer"), F.col("hit.code").alias("code"), F.col("hit").isNull().alias("blocked"))


def cache_semantic(questions: DataFrame, verified: DataFrame, dim: int, floor: float = K.CACHE_MIN_SCORE) -> DataFrame:
    """Nearest verified row at or above the floor, inside the requested document where one is given.

    questions: qid, vector/(idx, w), scope. verified: id, vector/(idx, w), key. Inactive rows are not asked.
    """
    return vector.top_k(questions, active(verified), 1, dim).where(F.col("score") >= floor).select("qid", "id", "score")


def doc_penalties(rejected: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Capped penalty per document: (group..., code_key, penalty). Terms are positive, so capping the sum is exact."""
    term = F.lit(0.12) + F.least(F.lit(0.28), (F.greatest(F.coalesce("rejected_count", F.lit(1)), F.lit(1)) - 1) * 0.05)
    r = rejected.withColumn("code_key", R.code_key("code")).where("code_key <> ''")
    return r.groupBy(*group, "code_key").agg(F.least(F.lit(0.58), F.sum(term)).alias("penalty"))


def negative_signal(questions: DataFrame, rejected: DataFrame, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Document penalties and rejected sources per question.

    questions: qid, normalized_question. rejected rows carry ``reject_id``. ``near`` (qid, id) lists the
    similar rejections used for questions without an exact one.
    """
    j = questions.join(rejected, "normalized_question")
    used = j.select("qid", "code", "rejected_count", "source_ids")
    if near is not None:
        rest = near.join(j.select("qid").distinct(), "qid", "left_anti").join(rejected, F.col("id") == F.col("reject_id"))
        used = used.unionByName(rest.select("qid", "code", "rejected_count", "source_ids"))
    sources = used.select("qid", F.explode("source_ids").alias("source_id")).where(F.trim("source_id") != "").distinct()
    return doc_penalties(used, ("qid",)), sources


def near_rejections(questions: DataFrame, rejected: DataFrame, dim: int, floor: float = K.REJECTED_NEAR_FLOOR) -> DataFrame:
    """(qid, id) of every rejection whose question is as near as ``floor``.

    questions: qid, vector/(idx, w). rejected: id, vector/(idx, w).
    """
    return vector.above(questions, rejected, floor, dim).select("qid", "id")


def apply_penalties(items: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Scores after feedback: document penalty plus 0.16 for a rejected source, at most 0.55.

    items: qid, code, source_id, score. docs: qid, code_key, penalty. sources: qid, source_id.
    """
    t = items.withColumn("code_key", R.code_key("code"))
    t = t.join(docs, ["qid", "code_key"], "left").join(sources.withColumn("_hit", F.lit(0.16)), ["qid", "source_id"], "left")
    p = F.least(F.lit(0.55), F.coalesce("penalty", F.lit(0.0)) + F.coalesce("_hit", F.lit(0.0)))
    new = F.when(p > 0, F.greatest(F.lit(0.0), F.col("score") * (1.0 - p))).otherwise(F.col("score"))
    return t.withColumn("score", F.round(new, 9)).drop("penalty", "_hit", "code_key")


def feedback_events(votes: DataFrame, messages: DataFrame) -> DataFrame:
    """Valid votes joined to their answer and the question asked at or before it.

    votes: message (struct session_id, ord), vote, reason. messages: as from ``asof_questions``.
    """
    v = votes.withColumn("vote", F.lower(F.trim("vote"))).where(F.col("vote").isin("up", "down"))
    j = v.join(messages, ["session_id", "ord"])
    ok = (F.trim(F.coalesce("question", F.lit(""))) != "") & (F.trim(F.coalesce("answer", F.lit(""))) != "")
    return j.where(ok).withColumn("reason", F.nullif(F.trim(F.coalesce("reason", F.lit(""))), F.lit("")))
