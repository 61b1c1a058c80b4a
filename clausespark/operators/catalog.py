"""Taxonomy, pipeline status, dashboards and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.operators.ordered import dense_positions

STAGES = ("doc_html", "chunking", "row_embedding", "img_embedding")


def effective_status(status: str = "status") -> Column:
    """Processing with every stage at 100 counts as done; a missing row as queued."""
    full = F.lit(True)
    for s in STAGES:
        full = full & (F.col(s) == 100)
    st = F.coalesce(F.col(status), F.lit("queued"))
    return F.when((st == "processing") & full, "done").otherwise(st)


def filter_tree(sections: DataFrame, categories: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per leaf of section, category and document, empty levels kept, with counts per level.

    Rows instead of nested lists: a level may hold any number of children. Sorted by the level codes.
    """
    n_docs = documents.groupBy("category_id").agg(F.count(F.lit(1)).alias("category_documents"))
    cats = categories.join(n_docs, "category_id", "left")
    per_section = cats.groupBy("section_id").agg(
        F.count(F.lit(1)).alias("section_categories"), F.coalesce(F.sum("category_documents"), F.lit(0)).alias("section_documents")
    )
    t = sections.join(per_section, "section_id", "left").join(cats, "section_id", "left").join(documents, "category_id", "left")
    zero = ("section_categories", "section_documents", "category_documents")
    return t.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def status_snapshot(events: DataFrame) -> DataFrame:
    """Latest status and stage per document, best progress per stage clamped to 0..100.

    events: document_id, seq, status, stage and the four progress columns.
    """
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), F.max(c))).alias(c)
    return events.groupBy("document_id").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("stage", "seq").alias("stage"), *[clamp(s) for s in STAGES]
    )


def changed(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of ``new`` that differ from ``old`` or are not in it."""
    o = old.select(key, F.struct(*[c for c in new.columns if c != key]).alias("_old"))
    j = new.join(o, key, "left")
    return j.where(~F.col("_old").eqNullSafe(F.struct(*[F.col(c) for c in new.columns if c != key]))).drop("_old")


def stale(processes: DataFrame, now: Column, minutes: int = K.STALE_DOC_MINUTES) -> DataFrame:
    """Rows still processing whose last touch is older than the limit."""
    return processes.where((F.col("status") == "processing") & (F.col("updated_at") < now - F.make_interval(mins=F.lit(minutes))))


def dashboard(documents: DataFrame, processes: DataFrame, totals: dict[str, DataFrame]) -> DataFrame:
    """One row of global counts; coverage is rounded half to even and clamped."""
    p = processes.select(effective_status().alias("s"))
    is_ = lambda v, n: F.count(F.when(F.col("s") == v, 1)).alias(n)
    row = p.agg(is_("queued", "queued"), is_("processing", "processing"), is_("done", "done"), is_("failed", "failed"), F.count(F.lit(1)).alias("n_processes"))
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    row = row.withColumns({"documents": n(documents)} | {k: n(v) for k, v in totals.items()})
    row = row.withColumn("queued", F.col("queued") + F.greatest(F.col("documents") - F.col("n_processes"), F.lit(0))).drop("n_processes")
    share = F.bround(F.col("row_embeddings") / F.col("table_rows") * 100)
    cover = F.when(F.col("table_rows") > 0, F.greatest(F.lit(0), F.least(F.lit(100), share))).otherwise(0)
    return row.withColumn("coverage", cover.cast("bigint"))


def status_sorted(documents: DataFrame, order: dict[str, int]) -> DataFrame:
    """Documents with their 1-based ``position`` in a custom status order, unknown status last, then by code."""
    place = F.lit(99)
    for name, n in order.items():
        place = F.when(F.col("status") == name, n).otherwise(place)
    t = documents.withColumns({"_all": F.lit(0), "_place": place})
    t = dense_positions(t, "_all", ["_place", "code", "document_id"], "position")
    return t.select(*documents.columns, (F.col("position") + 1).alias("position"))


def erase_users(sessions: DataFrame, users: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions with erased users unlinked, and the users left."""
    mark = gone.select("user_id").distinct().withColumn("_gone", F.lit(True))
    s = sessions.join(mark, "user_id", "left").withColumn("user_id", F.when(F.col("_gone").isNull(), F.col("user_id"))).drop("_gone")
    return s, users.join(gone, "user_id", "left_anti")


def import_taxonomy(rows: DataFrame, existing: DataFrame, default: str = "UMUMIY") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected category rows of a batch import.

    Codes are trimmed and upper-cased, a missing section becomes the default one, and a code that repeats in
    the batch or already exists in its section is a conflict.
    """
    code = F.upper(F.trim(F.coalesce("code", F.lit(""))))
    section = F.coalesce(F.nullif(F.upper(F.trim("section_code")), F.lit("")), F.lit(default))
    r = rows.withColumn("code", code).withColumn("section_code", section)
    n = r.groupBy("section_code", "code").agg(F.count(F.lit(1)).alias("_n"))
    known = existing.select("section_code", "code").distinct().withColumn("_known", F.lit(True))
    j = r.join(n, ["section_code", "code"]).join(known, ["section_code", "code"], "left")
    problem = F.when(F.col("code") == "", "empty_code").when(F.col("_n") > 1, "duplicate_in_batch").when(F.col("_known"), "already_exists")
    j = j.withColumn("problem", problem).drop("_n", "_known")
    return j.where("problem IS NULL").drop("problem"), j.where("problem IS NOT NULL")


def page(inventory: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of the merged inventory in (kind, sequence) order."""
    return inventory.orderBy("kind_order", "seq", "id").offset(offset).limit(limit)


def listing(df: DataFrame, group: list[str], order: list[str], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``size`` of every group, with their 1-based ``position``.

    A group is cut into slices that each keep their first rows, so no task ranks a whole large group.
    """
    last = offset + size
    t = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(64)))
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))).where(F.col("_r") <= last).drop("_r", "_slice")
    t = t.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return t.where((F.col("position") > offset) & (F.col("position") <= last))
