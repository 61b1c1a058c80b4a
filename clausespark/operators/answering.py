"""From candidate lists to answers: filters, routing, ordering, confidence and disposition.

Lists are bounded per question by the searches before, so per-question windows stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import numeric as N
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.operators.fusion import merge_key


def ranked(items: DataFrame, order: str = "item_id", name: str = "rank") -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), order)
    return items.withColumn(name, F.row_number().over(w).cast("bigint"))


def _field_test(value: Column, how: str):
    return (lambda v: F.contains(value, v)) if how == "contains" else (lambda v: value == v)


def matches_filters(filters: dict[str, tuple[Column, str]]) -> Column:
    """AND across fields, OR within one; ``how`` is equal or contains; a missing value fails a set filter.

    filters maps a value column name to (list column, how).
    """
    out = F.lit(True)
    for name, (wanted, how) in filters.items():
        value = F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))
        keys = F.filter(F.transform(wanted, lambda v: F.lower(F.trim(v))), lambda v: v != "")
        hit = F.exists(keys, _field_test(value, how))
        out = out & ((F.size(keys) == 0) | ((value != "") & hit))
    return out


def anchor_filter(items: DataFrame, anchors: Column) -> DataFrame:
    """Keep items near the question's anchors; a question that would lose everything keeps all."""
    hay = X.normalize_text(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "chapter", "snippet")]))
    hit = X.keyword_score(anchors, hay)
    keep = (
        (F.size(anchors) == 0)
        | (hit > 0)
        | (F.coalesce("semantic", F.lit(0.0)) >= 0.82)
        | ((F.coalesce("numeric", F.lit(0.0)) >= 0.45) & (F.coalesce("keyword", F.lit(0.0)) >= 0.6))
    )
    t = items.withColumn("_keep", keep)
    t = t.withColumn("_any", F.max("_keep").over(Window.partitionBy("qid")))
    return t.where(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")


# -------------------------------------------------------------------- routing
def doc_scores(items: DataFrame, score: str) -> DataFrame:
    """Per document 0.72 * best + 0.28 * mean of the best three positive scores."""
    w = Window.partitionBy("qid", "code").orderBy(F.desc(score), "item_id")
    top = items.where(F.col(score) > 0).withColumn("_r", F.row_number().over(w)).where("_r <= 3")
    return top.groupBy("qid", "code").agg((F.max(score) * 0.72 + F.avg(score) * 0.28).alias("doc_score"))


def route(parts: list[tuple[DataFrame, float]], named: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Weighted document scores: (qid, code, score, rank, selected).

    parts: (qid, code, doc_score) lists with weights. named: (qid, code) codes found in the question text; they compete.
    explicit: (qid, code, pos) codes that the caller asks for. They bypass routing: such a question gets these
    codes alone, in their order, all selected and without a score. Blank codes and repeats that differ in case are dropped.
    """
    if explicit is not None:
        c = explicit.select("qid", F.btrim("code").alias("code"), "pos").where("code <> ''").withColumn("_k", F.lower("code"))
        c = c.groupBy("qid", "_k").agg(F.min_by("code", F.struct("pos", "code")).alias("code"), F.min("pos").alias("pos"))
        order = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "code")).cast("bigint")
        given = c.select("qid", "code", F.lit(None).cast("double").alias("score"), order.alias("rank"), F.lit(True).alias("selected"))
        free = lambda df: df.join(explicit.where("btrim(code) <> ''").select("qid").distinct(), "qid", "left_anti")
        return route([(free(df), weight) for df, weight in parts], free(named)).unionByName(given)
    rows = None
    for df, weight in parts:
        d = df.select("qid", "code", (F.col("doc_score") * weight).alias("s"))
        rows = d if rows is None else rows.unionByName(d)
    rows = rows.unionByName(named.select("qid", "code", F.lit(1.6).alias("s")))
    s = rows.groupBy("qid", "code").agg(F.round(F.sum("s"), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "code")
    r = s.withColumn("rank", F.row_number().over(w).cast("bigint"))
    r = r.withColumn("top", F.max("score").over(Window.partitionBy("qid")))
    near = F.greatest(F.lit(K.ROUTE_MIN_SCORE * 0.92), F.col("top") - 0.08)
    ok = (F.col("score") >= K.ROUTE_MIN_SCORE) | (F.col("score") >= near)
    none = F.col("top") < K.ROUTE_MIN_SCORE * 0.92
    return r.select("qid", "code", "score", "rank", ((ok | none) & (F.col("rank") <= K.ROUTE_TOP_K)).alias("selected"))


def route_ambiguous(scores: DataFrame) -> DataFrame:
    """Whether the two best documents of a question are too close or too weak."""
    top = scores.where("rank <= 2").groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.round("score", 5))).alias("a"), F.max(F.when(F.col("rank") == 2, F.round("score", 5))).alias("b")
    )
    close = (
        (F.col("a") - F.col("b") <= K.AMBIGUITY_GAP)
        | (F.col("b") / F.greatest(F.col("a"), F.lit(1e-6)) >= K.ROUTE_CLOSE_RATIO)
        | (F.col("a") < K.ROUTE_LOW_CONFIDENCE)
    )
    return top.select("qid", F.when(F.col("b").isNull(), False).otherwise(close).alias("ambiguous"))


def reprioritize(scores: DataFrame, penalties: DataFrame, keep: int = K.ROUTE_TOP_K) -> DataFrame:
    """Routes re-ranked after feedback: score * (1 - min(0.75, penalty)); selected documents fill up."""
    head = scores.where(F.col("rank") <= 10).join(penalties, R.code_key("code") == F.col("code_key"), "left")
    adj = F.round("score", 5) * (1.0 - F.least(F.lit(0.75), F.coalesce("penalty", F.lit(0.0))))
    a = head.select("qid", "code", F.round(adj, 9).alias("score"), "rank")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    return a.withColumn("new_rank", F.row_number().over(w).cast("bigint")).where(F.col("new_rank") <= keep)


# ------------------------------------------------------------------- ordering
def search_plan(questions: DataFrame) -> DataFrame:
    """Which searches a question gets. Needs gates, intent and the best clause score."""
    table_intent = (F.col("intent") == "table_lookup") | F.col("table_intent")
    allowed = (table_intent | F.col("row_priority")) & ~F.col("clause_lookup")
    image = (F.col("intent") == "image_lookup") | X.contains_any(X.normalize_text("question"), K.IMAGE_TERMS)
    probe = ~allowed & F.col("numeric_requirement") & ~F.col("clause_lookup") & (F.col("best") < K.RICH_CLAUSE_THRESHOLD)
    k = F.when(table_intent, K.ROW_INTENT_TOP_K).otherwise(K.ROW_TOP_K)
    return questions.select(
        "qid", allowed.alias("table_search"), probe.alias("soft_probe"), k.cast("bigint").alias("row_k"),
        image.alias("image_intent"), (image | (F.col("best") < K.MIN_SCORE)).alias("image_search"),
    )


def final_order(items: DataFrame, limit: int = K.FINAL_K) -> DataFrame:
    """One list per question, kinds ordered by intent, one item per identity, at most ``limit``.

    items: table_first and image_first flags per question besides the candidate columns.
    """
    w_kind = Window.partitionBy("qid", "kind").orderBy(F.desc("score"), "item_id")
    t = items.withColumn("_kr", F.row_number().over(w_kind))
    w_q = Window.partitionBy("qid")
    t = t.withColumn("_top", F.max(F.when(F.col("kind") == "clause", F.col("score"))).over(w_q))
    support = F.col("score") >= F.greatest(F.lit(K.MIN_SCORE), F.col("_top") - 0.12)
    row, img, cl = F.col("kind") == "table_row", F.col("kind") == "image", F.col("kind") == "clause"
    place = (
        F.when(F.col("table_first"), F.when(row, 0).when(cl, 1).otherwise(2))
        .when(F.col("image_first"), F.when(img, 0).when(cl, 1).otherwise(2))
        .when(F.col("_top").isNotNull(), F.when(cl, 0).when(row & support & (F.col("_kr") <= 2), 1).when(img & support & (F.col("_kr") <= 1), 2))
        .otherwise(F.when(row, 0).otherwise(1))
    )
    t = t.withColumn("_p", place).where(F.col("_p").isNotNull()).withColumn("_key", merge_key())
    first = Window.partitionBy("qid", "_key").orderBy("_p", "_kr")
    t = t.withColumn("_f", F.row_number().over(first)).where("_f = 1")
    out = Window.partitionBy("qid").orderBy("_p", "_kr")
    t = t.withColumn("position", F.row_number().over(out).cast("bigint")).where(F.col("position") <= limit)
    return t.drop("_kr", "_top", "_p", "_key", "_f")


def context_select(items: DataFrame) -> DataFrame:
    """Quotas of the items that become context. items carry ``position`` (list order) and question flags."""
    by = lambda *o: Window.partitionBy("qid").orderBy(*o)
    row, cl, img = F.col("kind") == "table_row", F.col("kind") == "clause", F.col("kind") == "image"
    w_kind = lambda o: Window.partitionBy("qid", "kind").orderBy(*o)
    t = items.withColumn("_has_row", F.max(row).over(Window.partitionBy("qid")))
    t = t.withColumn("_has_clause", F.max(cl).over(Window.partitionBy("qid")))
    t = t.withColumn("_kp", F.row_number().over(w_kind([F.col("position")])))
    t = t.withColumn("_other", F.row_number().over(Window.partitionBy("qid", row).orderBy("position")))
    boosted = F.when(F.col("is_numeric"), F.col("score") + F.coalesce("numeric", F.lit(0.0)) * 0.35)
    t = t.withColumn("_cr", F.row_number().over(w_kind([F.desc_nulls_last(boosted), F.col("position")])))
    with_rows = F.col("_has_row") & (F.col("table_intent") | F.col("row_priority"))
    others = F.when(F.col("table_intent"), 2).otherwise(3)
    mixed = with_rows & F.when(row, F.col("_kp") <= 4).otherwise(F.col("_other") <= others)
    table_any = F.col("table_intent") & ~F.col("_has_row") & (F.col("position") <= 6)
    plain = ~F.col("table_intent") & ~F.col("row_priority") & F.when(
        F.col("_has_clause"), cl & (F.col("_cr") <= 6)
    ).otherwise(img & (F.col("_kp") <= 3))
    rowless = F.col("row_priority") & ~F.col("table_intent") & ~F.col("_has_row") & F.when(
        F.col("_has_clause"), cl & (F.col("_kp") <= 6)
    ).otherwise(F.col("position") <= 6)
    t = t.where(mixed | table_any | plain | rowless)
    order = F.when(with_rows, -F.col("score")).when(plain & F.col("is_numeric") & cl, F.col("_cr") * 1.0).otherwise(F.col("position") * 1.0)
    t = t.withColumn("context_rank", F.row_number().over(by(order, F.col("position"))).cast("bigint"))
    return t.where("context_rank <= 6").drop("_has_row", "_has_clause", "_kp", "_other", "_cr")


# ----------------------------------------------------------------- confidence
def confidence(lists: DataFrame, questions: DataFrame, strict: float = K.STRICT_MIN_SCORE, low: float = K.MIN_SCORE) -> DataFrame:
    """Confidence of every question from its ordered list.

    lists: qid, position, score, semantic, keyword, numeric, code, clause_number.
    questions: qid, intent, clause_numbers (array).
    """
    at = lambda n, c: F.max(F.when(F.col("position") == n, c))
    doc = F.lower(F.coalesce("code", F.lit("")))
    num = F.lower(F.trim(F.coalesce("clause_number", F.lit(""))))
    q = questions.withColumn("_targets", F.transform("clause_numbers", lambda v: F.lower(F.trim(v))))
    j = q.join(lists, "qid", "left")
    g = j.groupBy("qid").agg(
        at(1, F.col("score")).alias("s1"), at(2, F.col("score")).alias("s2"), at(1, doc).alias("d1"), at(2, doc).alias("d2"),
        at(1, F.coalesce("semantic", F.lit(0.0))).alias("sem"), at(1, F.coalesce("keyword", F.lit(0.0))).alias("kw"),
        F.max(F.coalesce("numeric", F.lit(0.0))).alias("num"),
        F.max((F.col("position") <= 5) & F.array_contains("_targets", num)).alias("exact"),
        F.first("intent").alias("intent"), F.first("_targets").alias("targets"),
    )
    conflict = F.coalesce(
        (F.col("d1") != "") & (F.col("d2") != "") & (F.col("d1") != F.col("d2")) & (F.abs(F.col("s1") - F.col("s2")) <= 0.03) & (F.col("s2") >= low),
        F.lit(False),
    )
    g = g.withColumn("signal", F.greatest("s1", "sem", "kw", "num")).withColumn("conflict", conflict)
    reason = (
        F.when(F.col("s1").isNull(), "no_retrieval_items")
        .when(F.col("conflict") & (F.col("sem") < 0.15) & (F.col("num") < 0.05), "conflicting_low_semantic_evidence")
        .when((F.col("intent") == "exact_band_reference") & (F.size("targets") > 0) & ~F.coalesce("exact", F.lit(False)), "exact_clause_not_found")
        .when(F.col("signal") >= strict, "signal_above_strict_threshold")
        .when(F.col("signal") >= low, "signal_above_min_threshold")
        .otherwise("signal_below_min_threshold")
    )
    g = g.withColumn("reason", reason)
    label = F.when(F.col("reason") == "signal_above_strict_threshold", "high").when(F.col("reason") == "signal_above_min_threshold", "medium").otherwise("low")
    return g.select(
        "qid", F.when(F.col("s1").isNull(), 0.0).otherwise(F.col("signal")).alias("score"), label.alias("label"),
        (label == "low").alias("no_answer"), "reason", "conflict",
    )


def answerability(lists: DataFrame) -> DataFrame:
    """Clarification and relaxed-threshold decisions over the ordered clause list of each question."""
    w = Window.partitionBy("qid")
    t = lists.withColumn("best", F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w))
    t = t.withColumn("thr", F.greatest(F.lit(K.LOW_CONFIDENCE_FLOOR), F.col("best") - K.AMBIGUITY_GAP))
    signal = F.greatest(F.coalesce("semantic", F.lit(0.0)), F.coalesce("keyword", F.lit(0.0)))
    code = F.trim(F.coalesce("code", F.lit("")))
    at = lambda n, c: F.max(F.when(F.col("rank") == n, c))
    window = F.col("rank") <= max(2, K.DOMINANCE_WINDOW)
    above = F.col("score") >= F.col("thr")
    strong = window & above & (code != "") & (signal >= max(0.24, K.STRONG_KEYWORD * 0.8))
    g = t.withColumn("_code1", F.max(F.when(F.col("rank") == 1, code)).over(w)).groupBy("qid").agg(
        F.max("best").alias("best"), F.count(F.lit(1)).alias("n"), at(2, F.col("score")).alias("second"),
        at(1, signal).alias("sig1"), at(2, signal).alias("sig2"), at(1, F.coalesce("keyword", F.lit(0.0))).alias("kw1"),
        F.size(F.collect_set(F.when(above & (code != ""), F.lower(code)))).alias("docs"),
        F.size(F.collect_set(F.when(strong, F.lower(code)))).alias("strong_docs"),
        F.max("_code1").alias("top_code"),
        (F.sum((window & (code == F.col("_code1"))).cast("int")) / F.sum(window.cast("int"))).alias("ratio"),
        at(1, F.coalesce("semantic", F.lit(0.0))).alias("sem1"), at(1, F.coalesce("numeric", F.lit(0.0))).alias("num1"),
    )
    docs = F.least("docs", F.lit(K.AMBIGUITY_MAX_DOCS))
    ask = (
        (F.col("n") >= 2) & (docs > 1) & (F.col("best") - F.col("second") <= K.AMBIGUITY_GAP)
        & (F.col("sig1") >= 0.22) & (F.col("sig2") >= 0.22)
        & ((F.col("best") >= K.STRICT_MIN_SCORE) | (F.col("strong_docs") >= 2))
    )
    floor = max(K.MIN_SCORE, K.STRICT_MIN_SCORE - K.NEAR_STRICT_MARGIN)
    relaxed = (F.col("best") >= K.STRICT_MIN_SCORE) | (
        (F.col("best") >= floor) & (F.col("top_code") != "") & (F.col("ratio") >= K.DOMINANCE_RATIO) & (F.col("kw1") >= K.STRONG_KEYWORD)
    )
    weak = (F.col("sem1") < 0.02) & (F.col("kw1") < 0.22) & (F.col("num1") < 0.14)
    return g.select("qid", F.coalesce(ask, F.lit(False)).alias("ask_document"), docs.cast("bigint").alias("n_docs"), relaxed.alias("relaxed"), weak.alias("weak_clause"))


def numeric_rescue(items: DataFrame, order: str = "item_id") -> DataFrame:
    """Best clause or row by score + 0.35 * numeric match, for numeric questions. items carry ``profile``."""
    t = items.where(F.col("kind").isin("clause", "table_row") & F.col("profile.is_numeric"))
    t = t.withColumn("_m", N.match(F.col("profile"), F.col("snippet"))).where(F.col("_m.score") > K.NUMERIC_RESCUE_MIN)
    t = t.withColumn("signal", F.round(F.col("score") + F.col("_m.score") * 0.35, 9)).where("signal > 0")
    t = t.withColumn("evidence", N.format_value(F.col("_m.value"), F.col("_m.unit")))
    w = Window.partitionBy("qid").orderBy(F.desc("signal"), order)
    return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", order, "signal", "evidence")


def exact_pick(items: DataFrame, order: str = "item_id") -> DataFrame:
    """Best clause whose canonical number is named, inside the named documents. items carry ``refs``."""
    targets = F.filter(F.transform("refs.clause_numbers", lambda v: X.canonical_clause_number(v)), lambda v: v != "")
    hints = F.transform("refs.document_codes", lambda v: R.code_key(v))
    t = items.where(F.col("kind") == "clause").withColumn("_t", targets).withColumn("_h", hints)
    mine = X.canonical_clause_number("clause_number")
    t = t.where((mine != "") & F.array_contains("_t", mine) & ((F.size("_h") == 0) | F.array_contains("_h", R.code_key("code"))))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), order)
    return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", order, "code", "clause_number", "score")


def disposition(q: DataFrame) -> DataFrame:
    """The first decision that applies to each question, from its joined signals (all boolean columns)."""
    c = F.col
    table_lookup = c("explicit_table") & (c("table_request") | (c("intent") == "table_lookup"))
    open_scope = ~c("filters_active")
    rescue = c("has_rescue")
    weak_end = F.when(rescue, "rag_rescue").when(c("missing_table_number"), "clarification")
    value = (
        F.when(c("greeting"), "greeting")
        .when(c("out_of_scope") & ~c("in_domain"), "out_of_scope")
        .when(c("filter_empty"), "no_match")
        .when(table_lookup & c("table_found"), "table_lookup")
        .when(table_lookup & c("table_ambiguous"), "clarification")
        .when(table_lookup, "no_match")
        .when(open_scope & ~c("has_explicit") & c("cache_hit"), "verified_cache")
        .when(c("doc_requested") & ~c("has_clause") & ~c("has_row") & ~c("has_image"), "no_match")
        .when((c("clause_lookup") | (c("intent") == "exact_band_reference")) & (c("n_clause_refs") == 1) & c("exact_found"), "rag_direct")
        .when(c("has_clause") & ~c("has_row") & ~c("has_image") & c("weak_clause"), F.coalesce(weak_end, F.lit("no_match")))
        .when(
            (c("best") < K.STRICT_MIN_SCORE) & ~(c("relaxed") | c("has_row") | c("has_image")),
            F.coalesce(weak_end, F.when(c("missing_case").isNotNull(), "clarification"), F.lit("no_match")),
        )
        .when(c("no_answer") & ~(c("has_row") | c("has_image")) & ~c("relaxed"), F.coalesce(weak_end, F.lit("no_match")))
        .otherwise("rag")
    )
    return q.select("qid", value.alias("disposition"))


# -------------------------------------------------------------------- sources
def source_record(item: dict[str, Column] | None = None) -> Column:
    """Answer source of an item: rounded scores and a snippet cut by kind."""
    cut = F.when(F.col("kind") == "table_row", F.left("snippet", F.lit(320))).otherwise(F.left("snippet", F.lit(280)))
    r4 = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)), 4)
    return F.struct(
        F.col("kind").alias("type"), F.col("code").alias("shnq_code"), "chapter", "clause_number", "table_number", "row_index",
        "appendix_number", F.when(F.col("kind") != "clause", F.col("title")).alias("title"), cut.alias("snippet"),
        r4("score").alias("score"), r4("semantic").alias("semantic_score"), r4("keyword").alias("keyword_score"), r4("numeric").alias("numeric_score"),
    )


def prompt_context(items: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """One prompt context per question: numbered blocks in context order, then the style examples.

    examples: qid, examples (array of question/answer structs).
    """
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))
    chapter = F.coalesce(F.nullif(F.col("chapter"), F.lit("")), F.lit("Nomalum bob"))
    body = F.left(F.coalesce("snippet", F.lit("")), F.lit(1200))
    n = F.col("context_rank").cast("string")
    lines = lambda *parts: F.concat_ws("\n", *[F.concat(F.lit(a), b) for a, b in parts])
    clause = lines(("Manba ", n), ("Hujjat: ", F.col("code")), ("Bob: ", chapter), ("Band: ", dash("clause_number")), ("Numeric dalil: ", dash("numeric_evidence")), ("Matn: ", body))
    image = lines(
        ("Manba ", F.concat(n, F.lit(" (Rasm)"))), ("Hujjat: ", F.col("code")), ("Bob: ", chapter), ("Ilova: ", dash("appendix_number")),
        ("Rasm URL: ", dash("image_url")), ("Matn: ", body),
    )
    row = lines(
        ("Manba ", F.concat(n, F.lit(" (Jadval satri)"))), ("Hujjat: ", F.col("code")), ("Bo'lim: ", chapter), ("Jadval: ", dash("table_number")),
        ("Satr: ", dash("row_index")), ("Numeric dalil: ", dash("numeric_evidence")), ("Matn: ", body),
    )
    block = F.when(F.col("kind") == "clause", clause).when(F.col("kind") == "image", image).otherwise(row)
    g = items.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("context_rank").alias("r"), block.alias("b")))).alias("bs"))
    context = F.array_join(F.transform("bs", lambda s: s["b"]), "\n\n")
    if examples is None:
        return g.select("qid", context.alias("context"))
    none = F.array().cast("array<struct<question: string, answer: string>>")
    shown = F.coalesce("examples", none)
    return g.join(examples, "qid", "left").select("qid", F.concat(context, example_block(shown)).alias("context"))


def example_block(examples: Column) -> Column:
    """Style examples (array of question/answer structs) as one numbered block; empty without any."""
    parts = F.transform(
        examples,
        lambda e, i: F.concat(F.lit("Namuna "), (i + 1).cast("string"), F.lit("\nSavol: "), e["question"], F.lit("\nJavob: "), e["answer"]),
    )
    return F.when(F.size(examples) > 0, F.concat(F.lit("\n\nJavob uslubi namunalari:\n"), F.array_join(parts, "\n\n"))).otherwise("")


# ------------------------------------------------------------------ tables
def table_pick(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """The table a question refers to, or none where several fit.

    questions: qid, question, number, terms (search terms without table words), context (array of context
    words), doc_key (or empty). tables: table_id, code, table_number, title, section_title, body, table_order.
    """
    j = questions.withColumn("_n", R.table_key("number")).join(tables.withColumn("_n", R.table_key("table_number")), "_n")
    j = j.where((F.col("doc_key") == "") | F.contains(R.code_key("code"), F.col("doc_key")))
    section = X.normalize_text("section_title")
    core = F.trim(F.regexp_replace(section, r"^\d+\s*[-.]?\s*(?:§|bob)?\.?\s*", ""))
    msg = X.normalize_text("question")
    hit = (F.length(section) >= 8) & (F.contains(msg, section) | ((F.length(core) >= 8) & F.contains(msg, core)))
    head = F.concat_ws(" | ", "title", "section_title", "table_number")
    combined = F.concat_ws(" | ", head, "body")
    context_hay = X.normalize_text(F.concat_ws(" ", "code", "section_title", "title", "body"))
    score = (
        F.lit(0.55)
        + F.when(R.table_mentioned(X.normalize_text(combined), F.col("number")), 0.15).otherwise(0.0)
        + X.keyword_score(F.col("terms"), X.normalize_text(head)) * 0.6
        + X.keyword_score(F.col("terms"), X.normalize_text(combined)) * 0.35
    )
    j = j.withColumn("exact", hit).withColumn("cand", F.round(score, 9)).withColumn("ctx", X.term_coverage(F.col("context"), context_hay))
    j = j.withColumn("section_key", section)
    order = [F.desc(F.col("exact").cast("int")), F.desc("cand"), F.desc("ctx"), F.col("table_order"), F.col("table_id")]
    # only the two best tables of a question are ranked; the rest is counted with partial aggregates
    two = j.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where("r <= 2")
    at = lambda n, c: F.max(F.when(F.col("r") == n, F.col(c)))
    two = two.groupBy("qid").agg(
        at(1, "table_id").alias("best"), at(1, "exact").alias("e1"), at(1, "cand").alias("c1"), at(1, "ctx").alias("x1"),
        at(2, "exact").alias("e2"), at(2, "cand").alias("c2"), at(2, "ctx").alias("x2"),
    )
    g = j.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.when(F.col("exact"), F.col("table_id")), F.when(F.col("exact"), F.struct("table_order", "table_id"))).alias("exact_id"),
        F.min(F.when(F.col("exact"), F.col("section_key"))).alias("_s0"), F.max(F.when(F.col("exact"), F.col("section_key"))).alias("_s1"),
        F.max(F.size("context")).alias("nctx"),
    ).join(two, "qid")
    win = (
        (F.col("e1") & ~F.coalesce("e2", F.lit(False)))
        | ((F.col("x1") > 0) & (F.col("x1") > F.coalesce("x2", F.lit(-1))))
        | ((F.col("c1") >= 0.75) & (F.col("c1") >= F.coalesce("c2", F.lit(-1.0)) + 0.08))
        | (F.col("n") == 1)
    )
    picked = F.when(F.col("nctx") > 0, F.when(F.col("_s0") == F.col("_s1"), F.col("exact_id")).when(win, F.col("best"))).when(F.col("n") == 1, F.col("best"))
    return g.select("qid", F.col("n").alias("n_candidates"), picked.alias("table_id"))


def table_choices(tables: DataFrame) -> DataFrame:
    """What to offer where a table number is not unique: (number_key, kind, label, position).

    The first seven documents and the first six chapters that hold a table of that number, each once whatever
    its case. tables: table_id, code, table_number, section_title, table_order. Blank codes are left out, a
    missing chapter counts as an unknown one. Each list is cut by a per-group limit before the shuffle.
    """
    t = tables.withColumn("number_key", R.table_key("table_number")).where("number_key <> ''")
    order = ["table_order", "table_id"]
    chapter = F.coalesce(F.nullif("section_title", F.lit("")), F.lit(K.UNKNOWN_CHAPTER))
    parts = (("document", F.coalesce("code", F.lit("")), K.CHOICE_DOCUMENTS), ("chapter", chapter, K.CHOICE_CHAPTERS))
    out = None
    for kind, label, limit in parts:
        named = t.withColumn("label", label).where(F.trim("label") != "")
        d = first_distinct(named, "number_key", F.lower(F.trim("label")), order, limit)
        d = d.select("number_key", F.lit(kind).alias("kind"), "label", "position")
        out = d if out is None else out.unionByName(d)
    return out


def context_words(message: Column, doc_code: Column) -> Column:
    """Words of a message that may describe a table."""
    rx = F.lit(r"(?U)[\p{L}]+(?:'[\p{L}]+)?")
    doc = F.regexp_extract_all(X.normalize_text(doc_code), rx, F.lit(0))
    words = F.regexp_extract_all(X.normalize_text(message), rx, F.lit(0))
    kept = F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(list(K.TABLE_CONTEXT_STOPWORDS)))
    return F.array_except(F.array_distinct(kept), doc)


def first_distinct(df: DataFrame, group: str, key: Column, order: list[str], limit: int) -> DataFrame:
    """First row per key within each group, in order, at most ``limit`` per group."""
    t = df.withColumn("_k", key).where(F.col("_k") != "")
    t = t.groupBy(group, "_k").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("r"))
    t = t.select("r.*", F.struct(*[F.col(f"r.{o}") for o in order]).alias("_o"))
    w = Window.partitionBy(group).orderBy("_o")
    return t.withColumn("position", F.row_number().over(w).cast("bigint")).where(F.col("position") <= limit).drop("_o")
