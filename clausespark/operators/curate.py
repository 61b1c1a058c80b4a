"""Curation of question-answer drafts: contexts, validation, dedupe, review and the job ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.operators import feedback as FB
from clausespark.operators.ordered import dense_positions
from clausespark.session import cut_lineage


def contexts(clauses: DataFrame, tables: DataFrame) -> DataFrame:
    """Useful clauses and tables with their usefulness and a cut excerpt.

    clauses: document_id, clause_id, text. tables: document_id, table_id, haystack, content.
    """
    c = clauses.withColumn("t", X.squeeze("text")).where(F.length("t") >= 40)
    c = c.select("document_id", F.lit("clause").alias("kind"), F.col("clause_id").alias("item"), X.clause_quality(F.col("t")).alias("score"), F.left("t", F.lit(K.CLAUSE_EXCERPT)).alias("excerpt"))
    t = tables.withColumn("t", X.squeeze("content")).where(F.length("t") >= 40)
    t = t.select("document_id", F.lit("table").alias("kind"), F.col("table_id").alias("item"), X.table_quality(X.squeeze("haystack")).alias("score"), F.left("t", F.lit(K.TABLE_EXCERPT)).alias("excerpt"))
    return c.unionByName(t).withColumn("score", F.round("score", 9))


def context_window(items: DataFrame, offset: int, batch: int, with_tables: bool = True) -> DataFrame:
    """Slice of the ranked contexts of each document, clauses and tables interleaved.

    Only the slice is ranked past the shuffle: the window keeps the first ``offset + size`` rows per kind.
    """
    size = max(K.CONTEXT_ITEMS, batch * 2)
    tsize = max(3, -(-size // 3))
    w = Window.partitionBy("document_id", "kind").orderBy(F.desc("score"), "item")
    r = items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= offset + size)
    i = F.col("_r") - 1 - offset
    cl = (F.col("kind") == "clause") & (i >= 0) & (i < size)
    tb = (F.col("kind") == "table") & (i >= 0) & (i < tsize) & F.lit(with_tables)
    s = r.where(cl | tb).withColumn("_k", i * 2 + (F.col("kind") == "table").cast("int"))
    out = Window.partitionBy("document_id").orderBy("_k")
    return s.withColumn("position", F.row_number().over(out).cast("bigint")).where(F.col("position") <= size).drop("_r", "_k")


def validate(drafts: DataFrame, tables: DataFrame, clauses: DataFrame) -> DataFrame:
    """Drafts that meet the length minima and whose table, where claimed, exists in their document.

    drafts: document_id, question, answer, short_answer, source_excerpt, source_kind, has_table,
    table_number, clause_number, source_anchor. tables: document_id, table_id, table_number, html_anchor.
    clauses: document_id, clause_number, html_anchor.
    """
    cols = ("question", "answer", "short_answer", "source_excerpt", "source_kind", "table_number", "clause_number", "source_anchor")
    d = drafts.withColumns({c: X.squeeze(c) for c in cols})
    kind = F.lower(F.when(F.col("source_kind") == "", "clause").otherwise(F.col("source_kind")))
    d = d.withColumn("source_kind", F.when(kind.isin("clause", "table", "mixed"), kind).otherwise("clause"))
    d = d.where((F.length("question") >= 10) & (F.length("answer") >= 15) & (F.length("short_answer") >= 2) & (F.length("source_excerpt") >= 20))
    hinted = F.nullif(F.regexp_extract("source_excerpt", r"(?iU)\b(\d+(?:\.\d+)*[a-z]?)\b", 1), F.lit(""))
    stated = F.nullif(F.col("table_number"), F.lit(""))
    number = F.when(F.col("has_table") & stated.isNull(), hinted).otherwise(stated)
    d = d.withColumn("_key", R.loose_table_key(number))
    t = tables.withColumn("_key", R.loose_table_key("table_number")).where("_key <> ''").groupBy("document_id", "_key").agg(
        F.min(F.struct("table_id", F.col("table_number").alias("found_number"), F.col("html_anchor").alias("_ta"))).alias("_t")
    )
    c = clauses.where("clause_number IS NOT NULL").groupBy("document_id", "clause_number").agg(F.min("html_anchor").alias("_ca"))
    j = d.join(t, ["document_id", "_key"], "left").join(c, ["document_id", "clause_number"], "left")
    j = j.where(~F.col("has_table") | F.col("_t").isNotNull())
    nb = lambda x: F.nullif(x, F.lit(""))
    matched = F.col("_t").isNotNull()
    kind = F.when(matched, F.col("source_kind")).otherwise(F.when(F.col("source_kind") == "mixed", "mixed").otherwise("clause"))
    return j.select(
        *[F.col(x) for x in drafts.columns if x not in ("short_answer", "source_excerpt", "source_kind", "has_table", "table_number", "source_anchor")],
        F.left("short_answer", F.lit(300)).alias("short_answer"), F.left("source_excerpt", F.lit(900)).alias("source_excerpt"), kind.alias("source_kind"),
        matched.alias("has_table"), F.col("_t.table_id").alias("table_id"), F.col("_t.found_number").alias("table_number"),
        F.coalesce(nb(F.col("source_anchor")), nb(F.col("_ca")), nb(F.col("_t._ta")), F.lit("")).alias("source_anchor"),
    )


def used_questions(*sources: DataFrame) -> DataFrame:
    """Distinct normalised questions already in use: (document_id, question_key)."""
    u = None
    for s in sources:
        k = s.select("document_id", X.normalize_text("question").alias("question_key")).where("question_key <> ''")
        u = k if u is None else u.unionByName(k)
    return u.distinct()


def dedupe(drafts: DataFrame, used: DataFrame, stored: DataFrame, order: str = "draft_id") -> DataFrame:
    """First draft per normalised question that is neither used nor stored in the same words."""
    d = drafts.withColumn("question_key", X.normalize_text("question"))
    d = d.groupBy("document_id", "question_key").agg(F.min_by(F.struct(*[F.col(c) for c in drafts.columns]), order).alias("r"))
    d = d.join(used, ["document_id", "question_key"], "left_anti").select("r.*")
    return d.join(stored.select("document_id", "question"), ["document_id", "question"], "left_anti")


def review(drafts: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drafts after review, newly approved, newly rejected). Approved drafts stay approved.

    decisions: draft_id, decision approve or reject, note.
    """
    j = drafts.join(decisions, "draft_id", "left")
    open_ = F.col("status") != "approved"
    approve, reject = open_ & (F.col("decision") == "approve"), open_ & (F.col("decision") == "reject")
    no = F.lit(False)
    after = j.where(~F.coalesce(reject, no)).withColumn("status", F.when(F.coalesce(approve, no), "approved").otherwise(F.col("status")))
    rejected = j.where(F.coalesce(reject, no)).withColumn("reason", F.coalesce("note", F.lit("qa_generator_reject_delete")))
    return after.select(drafts.columns), j.where(F.coalesce(approve, no)), rejected


SHORT_ANSWER_MOST = 400


def publish(verified: DataFrame, approved: DataFrame) -> DataFrame:
    """The verified table after approvals: each counts as one vote and gives its short answer, origin and job.

    approved: draft_id, reviewed_at, question, answer, source_ids, code, clause_number, short_answer, job_id.
    verified: as feedback.verified_batch gives it, with origin_type and job_id once drafts were published. Of several
    drafts with one key the latest review gives the values; a blank short answer keeps the stored one.
    """
    missing = {"origin_type": F.lit("feedback"), "job_id": F.lit(None).cast(approved.schema["job_id"].dataType)}
    old = verified.withColumns({c: v for c, v in missing.items() if c not in verified.columns})
    votes = approved.withColumnsRenamed({"draft_id": "event_id", "reviewed_at": "ts"})
    batch = FB.verified_batch(votes).withColumns({c: F.lit(None).cast(old.schema[c].dataType) for c in missing})
    keyed = votes.withColumn("normalized_question", X.normalize_text("question")).withColumn("source_hash", R.source_hash(F.col("source_ids")))
    at, short = F.struct("ts", "event_id"), F.nullif(F.btrim("short_answer"), F.lit(""))
    given = keyed.groupBy(*FB.VERIFIED_KEY).agg(
        F.max_by(short, F.when(short.isNotNull(), at)).alias("_short"), F.max_by("job_id", F.when(F.col("job_id").isNotNull(), at)).alias("_job"), F.lit(True).alias("_given")
    )
    j = FB.upsert(old, batch, FB.VERIFIED_KEY, "verified_count").join(given, FB.VERIFIED_KEY, "left")
    return j.withColumns(
        {
            "short_answer": F.left(F.coalesce("_short", "short_answer"), F.lit(SHORT_ANSWER_MOST)),
            "origin_type": F.when(F.col("_given"), "ai_generated").otherwise(F.coalesce("origin_type", F.lit("feedback"))),
            "job_id": F.coalesce("_job", "job_id"),
        }
    ).select(old.columns)


def withhold(rejected: DataFrame, refused: DataFrame) -> DataFrame:
    """The rejected table after refusals: each counts as one rejection of its question and answer.

    refused: draft_id, reviewed_at, question, answer, source_ids, code, reason.
    """
    batch = FB.rejected_batch(refused.withColumnsRenamed({"draft_id": "event_id", "reviewed_at": "ts"}))
    return FB.upsert(rejected, batch, FB.REJECTED_KEY, "rejected_count")


def draft_sources(kind: Column, has_table: Column, code: Column, clause_number: Column, anchor: Column, excerpt: Column, table_number: Column) -> Column:
    """Source structs of a draft: its clause, its table, or both."""
    none = F.lit(None).cast("string")
    fields = ("type", "shnq_code", "clause_number", "html_anchor", "table_number", "snippet")
    make = lambda *v: F.struct(*[x.alias(n) for n, x in zip(fields, v)])
    clause = F.when(kind.isin("clause", "mixed") | ~has_table, make(F.lit("clause"), code, clause_number, anchor, none, excerpt))
    table = F.when(table_number.isNotNull(), make(F.lit("table"), code, none, anchor, table_number, none))
    return F.array_compact(F.array(clause, table))


def job_counters(jobs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Recounted totals per job: generated, approved and remaining."""
    n = drafts.groupBy("job_id").agg(F.count(F.lit(1)).alias("generated"), F.count(F.when(F.col("status") == "approved", 1)).alias("approved"))
    j = jobs.join(n, "job_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("generated", "approved")})
    return j.withColumn("remaining", F.greatest(F.lit(0), F.greatest(F.lit(0), F.col("requested")) - F.col("generated")))


def timed_out(status: Column, touched: Column, at: Column, stale_minutes: int = K.STALE_JOB_MINUTES) -> Column:
    """Whether a queued or running job has not been touched for ``stale_minutes`` before ``at``; false if never touched."""
    return F.coalesce(status.isin(list(K.ACTIVE_JOB_STATUSES)) & (touched < at - F.make_interval(mins=F.lit(stale_minutes))), F.lit(False))


def list_jobs(jobs: DataFrame, now: Column, limit: int = K.JOB_PAGE, stale_minutes: int = K.STALE_JOB_MINUTES) -> DataFrame:
    """The newest ``limit`` jobs of every document, with their place; stale ones are shown as failed.

    jobs: job_id, document_id, status, created_at, updated_at. Newest first, those without a time last, ties by the
    larger job_id; jobs without a document are one list. Each task cuts its own rows to ``limit`` per document before
    they are shuffled, so a document may hold any share of the jobs. To list one document, filter ``jobs`` first.
    """
    status = F.when(timed_out(F.col("status"), F.col("updated_at"), now, stale_minutes), "failed").otherwise(F.col("status"))
    newest = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("created_at"), F.desc("job_id"))
    return jobs.withColumn("status", status).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)


def job_ledger(commands: DataFrame, now: Column, stale_minutes: int = K.STALE_JOB_MINUTES, block: int = 4096) -> DataFrame:
    """Current state of every job from its commands, replayed in order.

    commands: job_id, seq, ts, command (create, start, progress, finish, cancel, restart, extend, delete),
    amount. A command that its state does not allow is counted as refused. Each command depends on the
    state before it, so jobs are replayed in rounds of at most ``block`` commands; the state table is carried
    from round to round. Most logs need one round, a very long job more, and none is gathered whole.
    """
    ordered = dense_positions(commands, "job_id", ["seq"]).withColumn("_round", F.floor(F.col("pos") / block))
    rounds = ordered.agg(F.max("_round")).first()[0] or 0
    c = F.struct("seq", "ts", "command", F.coalesce("amount", F.lit(0)).alias("amount"))
    start = F.struct(
        F.lit("none").alias("status"), F.lit(0).cast("bigint").alias("requested"), F.lit(0).cast("bigint").alias("generated"),
        F.lit(None).cast("timestamp").alias("touched"), F.lit(0).alias("refused"),
    )

    def step(acc: Column, x: Column) -> Column:
        status = F.when(timed_out(acc["status"], acc["touched"], x["ts"], stale_minutes), "failed").otherwise(acc["status"])
        active, gone = status.isin(list(K.ACTIVE_JOB_STATUSES)), status.isin("none", "deleted")
        left = F.greatest(F.lit(0), acc["requested"] - acc["generated"])
        cmd, n = x["command"], x["amount"]
        ok = (
            F.when(cmd == "create", status == "none").when(cmd == "start", status == "queued").when(cmd == "progress", active)
            .when(cmd == "finish", active).when(cmd == "cancel", active).when(cmd == "restart", ~active & ~gone & (left > 0))
            .when(cmd == "extend", ~active & ~gone).when(cmd == "delete", ~active & ~gone).otherwise(F.lit(False))
        )
        new = (
            F.when(cmd.isin("create", "restart", "extend"), "queued").when(cmd.isin("start", "progress"), "running")
            .when(cmd == "finish", F.when(left <= 0, "completed").otherwise("failed")).when(cmd == "cancel", "cancelled").otherwise("deleted")
        )
        more = F.when(cmd.isin("create", "extend"), F.greatest(F.lit(1).cast("bigint"), n)).otherwise(F.lit(0).cast("bigint"))
        return F.struct(
            F.when(ok, new).otherwise(status).alias("status"),
            (acc["requested"] + F.when(ok, more).otherwise(F.lit(0).cast("bigint"))).alias("requested"),
            (acc["generated"] + F.when(ok & (cmd == "progress"), n).otherwise(F.lit(0).cast("bigint"))).alias("generated"),
            F.when(ok, x["ts"]).otherwise(acc["touched"]).alias("touched"),
            (acc["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"),
        )

    state = None
    for n in range(rounds + 1):
        part = ordered.where(F.col("_round") == n).groupBy("job_id").agg(F.array_sort(F.collect_list(c)).alias("cs"))
        if state is None:
            state = part.select("job_id", F.aggregate("cs", start, step).alias("s"))
            continue
        j = cut_lineage(state).join(part, "job_id", "left")
        state = j.select("job_id", F.when(F.col("cs").isNull(), F.col("s")).otherwise(F.aggregate("cs", F.col("s"), step)).alias("s"))
    f = state.select("job_id", "s.*")
    final = F.when(timed_out(F.col("status"), F.col("touched"), now, stale_minutes), "failed").otherwise(F.col("status"))
    f = f.withColumn("status", final)
    message = (
        F.when((F.col("status") == "failed") & (F.col("generated") > 0), "partial").when(F.col("status") == "failed", "empty")
    )
    return f.withColumn("outcome", message).withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), F.col("requested") - F.col("generated")))
