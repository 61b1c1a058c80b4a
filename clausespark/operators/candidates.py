"""Candidate tables: hybrid clause search, table rows, images, exact lookups and discovery passes."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausespark import constants as K
from clausespark.functions import numeric as N
from clausespark.functions import text as X
from clausespark.functions import vectors as V
from clausespark.operators import fusion, lexical, rerank, vector
from clausespark.operators import scope as SC
from clausespark.session import cut_lineage


def with_vector(df: DataFrame, text: str, key: str, as_key: str, *more: str) -> DataFrame:
    """(key, idx, w) hashing-trick vectors of a text column, and ``more`` columns; blank texts have none."""
    d = df.select(F.col(key).alias(as_key), V.hash_vectors(text).alias("v"), *more)
    return d.select(as_key, "v.idx", "v.w", *more).where(F.size("idx") > 0)


def question_features(questions: DataFrame) -> DataFrame:
    """Search terms and numeric profile of each question."""
    q = questions.withColumn("normalized", X.normalize_text("question", compat=True))
    q = q.withColumn("terms", X.query_terms("normalized"))
    q = q.withColumn("specific", X.specific_terms(F.col("terms")))
    return q.withColumn("anchors", X.anchor_terms(F.col("specific"))).withColumn("profile", N.query_profile("question"))


def indexed(clauses: DataFrame) -> DataFrame:
    """The clauses with their vectors (idx, w), written once for all steps that read them."""
    if "idx" in clauses.columns:
        return clauses
    return cut_lineage(clauses.withColumn("_v", V.hash_vectors("text")).select(*clauses.columns, "_v.idx", "_v.w"))


def hybrid(
    questions: DataFrame, clauses: DataFrame, postings: Callable[[], DataFrame] | None = None,
    dense_k: int = K.DENSE_K, lexical_k: int = K.LEXICAL_K, rerank_n: int = K.RERANK_CANDIDATES, top_k: int = K.TOP_K,
    numeric_profile: str | None = None, scopes: SC.Scopes | None = None,
) -> DataFrame:
    """Dense and lexical lists, fused, reranked and calibrated: the clause candidates of each question.

    With scopes both lists hold the best clauses of the documents a question may use.
    """
    clauses = indexed(clauses)
    fused = fused_lists(questions, clauses, postings, dense_k, lexical_k, scopes)
    # only the fused head of each question picks up its texts; it is written, so that the planner knows how small it is and need not shuffle the texts
    best = cut_lineage(fused.where(F.col("fused_rank") <= rerank_n))
    items = best.join(clauses.drop("idx", "w").withColumn("snippet", F.col("text")), "clause_id").join(rerank.with_question_features(questions), "qid")
    return calibrate(rerank.rerank(items, rerank_n, top_k), numeric_profile)


def fused_lists(questions, clauses, postings=None, dense_k=K.DENSE_K, lexical_k=K.LEXICAL_K, scopes=None) -> DataFrame:
    dense = dense_list(questions, clauses, dense_k, scopes)
    return fusion.reciprocal_rank(dense, lexical.retrieve(questions, clauses, lexical_k, postings, scopes))


def dense_list(questions: DataFrame, clauses: DataFrame, k: int = K.DENSE_K, scopes: SC.Scopes | None = None) -> DataFrame:
    """Dense list of each question, inside its scope if it has one."""
    q = with_vector(questions, "question", "qid", "qid")
    if scopes is None:
        return vector.dense_candidates(q, stored_vectors(clauses), k)
    return vector.dense_candidates(scopes.keyed(q), stored_vectors(SC.allow(clauses, scopes), "scopes"), k)


def stored_vectors(clauses: DataFrame, *more: str) -> DataFrame:
    """(id, idx, w) of the clauses, and ``more`` columns, from the vectors they carry if they are ``indexed``."""
    if "idx" not in clauses.columns:
        return with_vector(clauses, "text", "clause_id", "id", *more)
    return clauses.select(F.col("clause_id").alias("id"), "idx", "w", *more).where(F.size("idx") > 0)


def calibrate(items: DataFrame, profile: str | None = None) -> DataFrame:
    """Gates and confidence weighting of reranked clauses."""
    t = question_features(items)
    hay = X.normalize_text("snippet", compat=True)
    t = t.withColumn("_h", hay)
    prof = F.col(profile) if profile else F.col("profile")
    t = (
        t.withColumn("_kw", X.keyword_score(F.col("terms"), F.col("_h")))
        .withColumn("_sp", X.keyword_score(F.col("specific"), F.col("_h")))
        .withColumn("_an", X.keyword_score(F.col("anchors"), F.col("_h")))
        .withColumn("_nm", N.match(prof, F.col("snippet")))
    )
    sem = F.col("dense_score")
    kw = F.greatest("_kw", "_sp", "_an")
    nz = lambda c: F.nullif(F.col(c), F.lit(0.0))
    base = F.coalesce(nz("rerank_score"), nz("hybrid_score"), nz("dense_score"), nz("lexical_score"), F.lit(0.0))
    has_sp, has_an = F.size("specific") > 0, F.size("anchors") > 0
    drop = (
        (has_sp & (F.col("_sp") <= 0) & (sem < 0.18))
        | (has_an & (F.col("_an") <= 0) & (sem < 0.14))
        | ((sem < 0.02) & (kw < 0.16))
        | (base <= 0)
    )
    weight = 0.35 + 0.65 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(sem, kw)))
    score = base * weight + F.col("_an") * 0.18
    score = F.when(has_an & (F.col("_an") <= 0) & (sem < 0.2), score * 0.82).otherwise(score)
    num = F.col("_nm.score")
    score = F.when(
        prof["is_numeric"], score + num * K.NUMERIC_WEIGHT - F.when(num <= 0.01, 0.02).otherwise(0.0)
    ).otherwise(score)
    nothing = F.lit(None).cast("string")
    return t.where(~drop).select(
        "qid", "question", F.lit("clause").alias("kind"), "clause_id", nothing.alias("table_id"), nothing.alias("image_id"),
        F.concat(F.lit("Band "), F.coalesce("clause_number", F.lit("-"))).alias("title"),
        "snippet", "code", "document_id", "clause_number", F.col("chapter_title").alias("chapter"),
        F.round(score, 9).alias("score"), F.round(sem, 9).alias("semantic"), F.round(kw, 9).alias("keyword"),
        F.round(num, 9).alias("numeric"),
        F.when(F.col("_nm.value").isNotNull(), N.format_value(F.col("_nm.value"), F.col("_nm.unit"))).alias("numeric_evidence"),
    )


def seeded_dense(questions: DataFrame, clauses: DataFrame, k: int, postings: DataFrame | None = None) -> DataFrame:
    """Dense top k among all clauses that a question's terms touch.

    For at most ``lexical.BLOCK_ROWS`` questions a clause's counts travel beside its vector, once, to join rows of one
    clause_id, and what touches a clause is found where it is scored. For more the questions that touch a clause
    travel as one list beside its text, in the place of a scope. Vectors are built and scored per clause and not per pair.
    """
    asked = questions.where("qid IS NOT NULL")
    head = asked.select("qid", X.unique_terms("question").alias("u"), X.priority_terms("question").alias("p")).limit(lexical.BLOCK_ROWS + 1).collect()
    if len(head) <= lexical.BLOCK_ROWS:
        return vector.rank(_nearest_touched(with_vector(asked, "question", "qid", "qid"), lexical.Asked.of(head), clauses, k), k)
    terms, hits = lexical.matches(asked, clauses, postings)
    # hits are dealt by clause once; the pairs of a clause are then summed and listed where they are
    touched = lexical.score_candidates(terms, hits.repartition("clause_id"))
    key = F.concat(F.lit("="), F.col("qid").cast("string"))
    seeds = touched.groupBy("clause_id").agg(F.collect_list(key).alias("scopes"))
    stored = with_vector(clauses.select("clause_id", "text").join(seeds, "clause_id"), "text", "clause_id", "id", "scopes")
    return vector.top_k(with_vector(asked, "question", "qid", "qid").withColumn("within", key), stored, k, K.HASH_DIM)


def _nearest_touched(questions: DataFrame, asked: lexical.Asked, clauses: DataFrame, k: int) -> DataFrame:
    """(qid, id, score) that can be among the ``k`` nearest clauses a question touches."""
    vectors = questions.toPandas()
    number = {qid: i for i, qid in enumerate(asked.qids)}
    of = [number[qid] for qid in vectors["qid"]]
    tokens = F.concat(lexical.long_tokens("chapter_title"), lexical.long_tokens("text")).alias("tokens")
    read = clauses.where("clause_id IS NOT NULL").select("clause_id", tokens, V.hash_vectors("text").alias("v"))
    found = lexical.found_terms(read.select("clause_id", "tokens", "v.idx", "v.w"), asked.terms, every=True)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = vector.TopK(vectors, K.HASH_DIM, k)
        for block in lexical.blocks(batches, asked.together(), "idx", "w"):
            touched = lexical.counted(*asked.sums(block))[:, of]
            full = [i for i, row in enumerate(block.rows) if len(row[0])]
            if full:
                owner = block.owner[full]
                stored = pd.DataFrame({"id": [block.ids[i] for i in owner], "idx": [block.rows[i][0] for i in full], "w": [block.rows[i][1] for i in full]})
                best.add(stored, touched[owner])
        yield best.frame().astype({"score": "float64"})

    out = T.StructType([T.StructField("qid", questions.schema["qid"].dataType), T.StructField("id", clauses.schema["clause_id"].dataType), T.StructField("score", T.DoubleType())])
    return lexical.dealt(found).mapInPandas(score, out)


def term_table(features: DataFrame) -> DataFrame:
    """(qid, term, pos) of the search terms."""
    return features.select("qid", F.posexplode("terms").alias("pos", "term"))


def text_hits(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term, tf) of distinct terms over a text column."""
    toks = F.filter(X.extract_tokens(X.lexical_fold(text)), lambda t: F.length(t) > 2)
    e = texts.select(F.col(key).alias("clause_id"), F.explode(toks).alias("token"))
    postings = e.withColumns({"n": F.lit(1), "n_text": F.lit(1)})
    return lexical.term_hits(postings, terms).select(F.col("clause_id").alias(key), "term", "tf")


def pair_semantic(pairs: DataFrame, qv: DataFrame, iv: DataFrame, key: str) -> DataFrame:
    """Cosine of (qid, key) pairs from sparse vectors; a missing vector scores zero.

    Items meet their pairs by a sort-merge join: a small compressed file may hold many of them, and the planner,
    which goes by its size, would collect their vectors in the driver.
    """
    a = qv.select("qid", F.struct("idx", "w").alias("_q"))
    b = iv.select(F.col("id").alias(key), F.struct("idx", "w").alias("_i"))
    j = pairs.join(a, "qid", "left").join(b.hint("merge"), key, "left")
    s = F.when(F.col("_q").isNotNull() & F.col("_i").isNotNull(), V.sparse_dot(F.col("_q"), F.col("_i"))).otherwise(0.0)
    return j.withColumn("semantic", F.round(s, 9)).drop("_q", "_i")


def measure_index(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, value, bucket): the values that each item states, one row per distinct value."""
    e = items.select(key, F.explode(N.measures(text)).alias("m"))
    return e.select(key, "m.unit", "m.value", "m.bucket")


def stating(questions: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Items that state a value a question asks for: distinct (qid, key).

    An interval join as an equi-join on unit and bucket: an asked length looks into its own bucket and the two
    beside it, so work follows the values that lie near, not questions times items.
    """
    asked = measure_index(questions, "qid", "question").withColumnRenamed("value", "asked")
    around = F.when(F.col("unit") == "length", F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).otherwise(F.array("bucket"))
    asked = asked.select("qid", "unit", "asked", F.explode(around).alias("bucket"))
    j = asked.join(index, ["unit", "bucket"]).where(N.same_measure(F.col("asked"), F.col("value"), F.col("unit")))
    return j.select("qid", key).distinct()


def row_candidates(questions: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Scored table rows per question.

    rows: row_id, table_id, table_number, row_index, code, search_text, combined. Scored are all rows that a
    term hits, all that state a value the question asks for, and the ``k`` nearest. A row that is none of these
    is no candidate; without numbers it could not enter, as it scores its cosine alone.
    questions: qid, question, row_priority (boolean).
    """
    f = question_features(questions)
    qv = with_vector(questions, "question", "qid", "qid")
    iv = with_vector(rows, "search_text", "row_id", "id")
    terms = term_table(f)
    hit = terms.join(text_hits(rows, "row_id", "search_text", terms), "term").select("qid", "row_id").distinct()
    asked = qv.join(f.where((F.size("terms") > 0) | F.col("row_priority")).select("qid"), "qid", "left_semi")
    near = vector.top_k(asked, iv, k, K.HASH_DIM).select("qid", F.col("id").alias("row_id"))
    valued = stating(questions, measure_index(rows, "row_id", "combined"), "row_id")
    valued = valued.join(f.where((F.size("terms") > 0) | F.col("row_priority")).select("qid"), "qid", "left_semi")
    pairs = pair_semantic(cut_lineage(hit.union(near).union(valued).distinct()), qv, iv, "row_id")
    # sort-merge as in ``pair_semantic``: the texts of all rows are too many for the driver
    texts = rows.withColumn("_h", X.normalize_text("combined"))
    t = pairs.join(f, "qid").join(texts.hint("merge"), "row_id")
    t = (
        t.withColumn("coverage", X.term_coverage(F.col("terms"), F.col("_h")))
        .withColumn("_tf", X.term_frequency(F.col("terms"), F.col("_h")))
        .withColumn("_sc", X.term_coverage(F.col("specific"), F.col("_h")))
        .withColumn("_nm", N.match(F.col("profile"), F.col("combined")))
    )
    share = lambda n, ts: F.when(F.size(ts) > 0, F.col(n) / F.size(ts)).otherwise(0.0)
    kw = F.greatest(share("coverage", "terms"), share("_sc", "specific"))
    phrase = F.when((F.col("normalized") != "") & F.contains("_h", F.col("normalized")), 0.35).otherwise(0.0)
    focus = F.when(F.col("row_priority") & (F.col("coverage") >= 2), 0.12).otherwise(0.0)
    score = (
        F.col("semantic") * 0.85 + kw * 0.6 + F.least(F.lit(0.35), F.col("_tf") * 0.06) + phrase + focus
        + F.when(F.col("profile.is_numeric"), F.col("_nm.score") * max(0.12, K.NUMERIC_WEIGHT * 0.85)).otherwise(0.0)
    )
    t = t.withColumn("keyword", F.round(kw, 9)).withColumn("score", F.round(score, 9))
    pri = F.col("row_priority")
    drop = (
        ((F.size("specific") > 0) & (F.col("_sc") == 0) & (F.col("semantic") < 0.2) & ~pri)
        | (~pri & (F.col("score") < K.ROW_MIN_SCORE) & (F.col("keyword") <= 0))
        | (pri & (F.col("coverage") == 0) & (F.col("semantic") < K.ROW_MIN_SCORE))
    )
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "row_id")
    r = t.where(~drop).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return r.select(
        "qid", "row_id", "table_id", "table_number", "row_index", "code", "score", "semantic", "keyword",
        F.round(F.col("_nm.score"), 9).alias("numeric"), "rank",
    )


def row_fallback(questions: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Rows by the keywords in their cells. cells: row_id, col_index, text.

    A row is a candidate when one of its cells holds a term; it is scored on all of its cells. Cell terms are counted per cell and summed per row, no row is re-read.
    """
    f = question_features(questions)
    terms = term_table(f)
    hits = text_hits(cells.withColumn("cell", F.struct("row_id", "col_index")), "cell", "text", terms)
    per_row = hits.groupBy(F.col("cell.row_id").alias("row_id"), "term").agg(F.sum("tf").alias("tf"))
    g = terms.join(per_row, "term").groupBy("qid", "row_id").agg(
        F.count(F.lit(1)).alias("coverage"), F.sum("tf").alias("tf")
    )
    g = g.join(f.select("qid", F.size("terms").alias("n")), "qid")
    score = F.col("coverage") * 0.55 + F.least(F.lit(0.55), F.col("tf") * 0.07)
    g = g.withColumn("score", F.round(score, 9)).withColumn("keyword", F.round(F.col("coverage") / F.col("n"), 9))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "row_id")
    r = g.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return r.select("qid", "row_id", "score", "keyword", "rank")


def image_candidates(questions: DataFrame, images: DataFrame, k: int = K.IMAGE_TOP_K) -> DataFrame:
    """Best images per question. images: image_id, context.

    An image without any term scores its cosine alone, so those come from the nearest neighbours;
    all images with a term are scored. Together the two cover the exact top k.
    """
    f = question_features(questions)
    qv = with_vector(questions, "question", "qid", "qid")
    iv = with_vector(images, "context", "image_id", "id")
    terms = term_table(f)
    hit = terms.join(text_hits(images, "image_id", "context", terms), "term").groupBy("qid", "image_id").agg(
        F.count(F.lit(1)).alias("coverage")
    )
    near = vector.top_k(qv, iv, k, K.HASH_DIM).select("qid", F.col("id").alias("image_id"), F.lit(0).cast("bigint").alias("coverage"))
    both = hit.unionByName(near).groupBy("qid", "image_id").agg(F.max("coverage").alias("coverage"))
    t = pair_semantic(both, qv, iv, "image_id").join(f.select("qid", F.size("terms").alias("n")), "qid")
    kw = F.when(F.col("n") > 0, F.col("coverage") / F.col("n")).otherwise(0.0)
    t = t.withColumn("keyword", F.round(kw, 9)).withColumn("score", F.round(F.col("semantic") + K.KEYWORD_WEIGHT * kw, 9))
    t = t.where((F.col("score") >= K.IMAGE_MIN_SCORE) | (F.col("keyword") > 0))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "image_id")
    r = t.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return r.select("qid", "image_id", "score", "semantic", "keyword", "rank")


def admitted_images(found: DataFrame, signals: DataFrame, clause_floor: float = K.MIN_SCORE, image_floor: float = K.OTHER_IMAGE_FLOOR) -> DataFrame:
    """The image candidates a question may show. signals: qid, asks_image, clause_score (of its best clause, null for none).

    A question that asks for an image keeps them all; any other only those of ``image_floor`` or more, and only
    if its best clause stays below ``clause_floor``. Questions without signals ask for no image and have no clause.
    """
    one = signals.groupBy("qid").agg(F.max("asks_image").alias("_asks"), F.max("clause_score").alias("_clause"))
    t = found.join(one, "qid", "left")
    weak = F.coalesce("_clause", F.lit(0.0)) < clause_floor
    return t.where(F.coalesce("_asks", F.lit(False)) | (weak & (F.col("score") >= image_floor))).drop("_asks", "_clause")


def exact_clauses(references: DataFrame, clauses: DataFrame, k: int = 6) -> DataFrame:
    """Clauses whose stored number a question names, within the named documents if any.

    references: qid, clause_numbers, document_codes. A named document joins on number and code. Without one,
    only the first ``k`` clauses of a number can enter a list, so the others are cut before the join: each
    slice of a number keeps its first ``k``, and these are ranked.
    """
    r = references.select("qid", "document_codes", F.explode("clause_numbers").alias("clause_number")).distinct()
    named = r.select("qid", "clause_number", F.explode("document_codes").alias("code")).distinct().join(clauses, ["clause_number", "code"])
    sliced = Window.partitionBy("clause_number", "_slice").orderBy("clause_id")
    first = Window.partitionBy("clause_number").orderBy("clause_id")
    heads = clauses.withColumn("_slice", F.pmod(F.xxhash64("clause_id"), F.lit(256)))
    heads = heads.withColumn("_r", F.row_number().over(sliced)).where(F.col("_r") <= k)
    heads = heads.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_slice", "_r")
    loose = r.where(F.size("document_codes") == 0).select("qid", "clause_number").join(heads, "clause_number")
    j = named.select("qid", "clause_id", "code", "clause_number").unionByName(loose.select("qid", "clause_id", "code", "clause_number"))
    w = Window.partitionBy("qid").orderBy("clause_id")
    t = j.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return t.select("qid", "clause_id", "code", "clause_number", F.lit(1.35).alias("score"), "rank")


def keyword_fallback(questions: DataFrame, clauses: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """Clauses by plain keyword share, for questions the hybrid search left empty.

    For at most ``lexical.BLOCK_ROWS`` questions the pairs of question and clause are counted where the clause is.
    """
    f = question_features(questions)
    head = f.select("qid", "terms", "profile").limit(lexical.BLOCK_ROWS + 1).collect()
    if len(head) <= lexical.BLOCK_ROWS:
        pairs = _keyword_pairs(f, head, clauses, k)
        return _best_keywords(pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1]), k)
    terms = term_table(f)
    hits = text_hits(clauses, "clause_id", "text", terms)
    g = terms.join(hits, "term").groupBy("qid", "clause_id").agg(F.count(F.lit(1)).alias("coverage"), F.sum("tf").alias("tf"))
    g = g.join(f.select("qid", "profile", F.size("terms").alias("n")), "qid")
    g = g.where(~((F.col("coverage") == 1) & (F.col("n") >= 4) & (F.col("tf") < 2)))
    # only numeric questions need the clause text for their score
    numeric = g.where("profile.is_numeric").join(clauses.select("clause_id", "text"), "clause_id")
    numeric = numeric.withColumn("numeric", N.match(F.col("profile"), F.col("text"))["score"]).drop("text")
    plain = g.where("NOT profile.is_numeric").withColumn("numeric", F.lit(0.0))
    return _best_keywords(numeric.select(plain.columns).unionByName(plain), k)


def _best_keywords(t: DataFrame, k: int) -> DataFrame:
    ratio = F.col("coverage") / F.col("n")
    score = ratio * 0.75 + F.least(F.lit(0.25), F.col("tf") * 0.04) + F.col("numeric") * 0.2
    t = t.withColumn("score", F.round(score, 9)).withColumn("keyword", F.round(ratio, 9))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "clause_id")
    r = t.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return r.select("qid", "clause_id", "score", "keyword", F.round("numeric", 9).alias("numeric"), "rank")


class _Keywords(lexical.Best):
    """Running top k by keyword share alone; a list is a pair (number of the question, how many terms it has)."""

    sums = ("tf", "coverage")

    def __init__(self, asked: lexical.Asked, k: int, lists: list[tuple[int, int]]):
        super().__init__(asked, k, len(lists))
        self.lists = lists

    def add(self, block: lexical.Block) -> None:
        every = self.asked.sums(block)
        for j, (no, n) in enumerate(self.lists):
            tf, coverage = every[0][:, no], every[1][:, no]
            score = np.round(coverage / max(1, n) * 0.75 + np.minimum(0.25, tf * 0.04), 9)
            score[~_enough(tf, coverage, n)] = -1.0
            if (score >= 0).any():
                self.merge(j, block.ids, score, [tf, coverage])


def _enough(tf: np.ndarray, coverage: np.ndarray, n: int) -> np.ndarray:
    return (tf > 0) & ~((coverage == 1) & (n >= 4) & (tf < 2))


def _keyword_pairs(features: DataFrame, head: list, clauses: DataFrame, k: int) -> list[DataFrame]:
    """(qid, clause_id, coverage, tf, n, numeric): pairs that can be among the best ``k`` of plain questions, and all of numeric ones.

    A clause travels with its text only for numeric questions, once, and meets them where it arrives.
    """
    spark, kind = clauses.sparkSession, clauses.schema["clause_id"].dataType.simpleString()
    kinds = {c: features.schema[c].dataType for c in ("qid", "profile")}

    def lists_of(rows: list) -> tuple[lexical.Asked, list[tuple[int, int]], DataFrame]:
        # rows of one qid add up, and each of them has a list
        qids = {r["qid"] for r in rows}
        asked = lexical.Asked.of([{"qid": r["qid"], "u": r["terms"], "p": []} for r in head if r["qid"] in qids])
        number = {qid: i for i, qid in enumerate(asked.qids)}
        schema = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("qid", kinds["qid"]), T.StructField("n", T.IntegerType()), T.StructField("profile", kinds["profile"])])
        table = spark.createDataFrame([(i, r["qid"], len(r["terms"]), r["profile"]) for i, r in enumerate(rows)], schema)
        return asked, [(number[r["qid"]], len(r["terms"])) for r in rows], table

    tokens = lexical.long_tokens("text").alias("tokens")
    known = [r for r in head if r["qid"] is not None]
    asked, lists, table = lists_of([r for r in known if not r["profile"]["is_numeric"]])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Keywords(asked, k, lists)
        for block in lexical.blocks(batches, asked.together()):
            best.add(block)
        yield best.frame()

    found = lexical.found_terms(clauses.select("clause_id", tokens), asked.terms)
    plain = lexical.dealt(found).mapInPandas(score, f"no int, clause_id {kind}, tf bigint, coverage bigint").join(table.drop("profile"), "no")
    columns = ("qid", "clause_id", "coverage", "tf", "n", "numeric")
    pairs = [plain.withColumn("numeric", F.lit(0.0)).select(*columns)]
    if numeric := [r for r in known if r["profile"]["is_numeric"]]:
        block_of, views, profiles = lists_of(numeric)

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for block in lexical.blocks(batches, block_of.together(), "text"):
                tf, coverage, *_ = block_of.sums(block)
                at = np.array([no for no, _ in views])
                tf, coverage = tf[:, at].astype(np.int64), coverage[:, at].astype(np.int64)
                hit = _enough(tf, coverage, np.array([n for _, n in views]))
                nos = [np.flatnonzero(hit[i]).astype(np.int32) for i in block.owner]
                some = [x for x in range(len(nos)) if len(nos[x])]
                yield pd.DataFrame({
                    "clause_id": pd.Series([block.ids[block.owner[x]] for x in some], dtype=object), "text": pd.Series([block.rows[x][0] for x in some], dtype=object),
                    "no": pd.Series([nos[x] for x in some], dtype=object), "tf": pd.Series([tf[block.owner[x], nos[x]] for x in some], dtype=object),
                    "coverage": pd.Series([coverage[block.owner[x], nos[x]] for x in some], dtype=object),
                })

        read = clauses.where("clause_id IS NOT NULL").select("clause_id", "text", tokens)
        met = lexical.dealt(lexical.found_terms(read, block_of.terms, every=True)).mapInPandas(meet, f"clause_id {kind}, text string, no array<int>, tf array<bigint>, coverage array<bigint>")
        met = met.select("clause_id", "text", F.explode(F.arrays_zip("no", "tf", "coverage")).alias("z")).select("clause_id", "text", "z.*").join(profiles, "no")
        pairs.append(met.withColumn("numeric", N.match(F.col("profile"), F.col("text"))["score"]).select(*columns))
    return pairs


# ------------------------------------------------------------------ discovery
def low_quality_top(features: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, best, n_items, low_quality) of the current clause lists; questions without items included."""
    top = items.groupBy("qid").agg(
        F.max_by(F.struct("score", "snippet", "semantic", "keyword"), F.struct(F.col("score"), F.col("clause_id"))).alias("t"),
        F.count(F.lit(1)).alias("n_items"),
    )
    j = features.select("qid", "anchors").join(top, "qid", "left")
    hit = X.keyword_score(F.col("anchors"), X.normalize_text(F.coalesce("t.snippet", F.lit("")), compat=True))
    weak = (hit <= 0) & ((F.col("t.semantic") < 0.7) | (F.col("t.keyword") < 0.82))
    low = F.when(F.col("t").isNull(), True).when(F.size("anchors") == 0, False).otherwise(weak)
    return j.select(
        "qid", F.coalesce("t.score", F.lit(0.0)).alias("best"), F.coalesce("n_items", F.lit(0)).alias("n_items"), low.alias("low_quality")
    )


def discover(
    questions: DataFrame, clauses: DataFrame, base: DataFrame, scopes: SC.Scopes | None = None, fixed: DataFrame | None = None
) -> DataFrame:
    """Second look for weak questions: deep passes over their phrasings in their scopes, then unscoped passes.

    Questions that name a document themselves are not widened, nor are those in ``fixed`` (qid), whose scope
    is a filter the caller set.

    questions: qid, question, refs (reference struct), phrasings (array). All phrasings of all weak
    questions are searched in one pass each, as extra question rows, and merged with their weights.
    Lists that later steps read several times are written to the checkpoint folder.
    """
    f = question_features(questions)
    clauses = indexed(clauses)
    postings = functools.cache(lambda: cut_lineage(lexical.clause_tokens(clauses)))
    base = cut_lineage(base)
    state = low_quality_top(f, base)
    threshold = max(K.STRICT_MIN_SCORE, K.MIN_SCORE + 0.06)
    weak = (F.col("n_items") == 0) | (F.col("best") < threshold) | (F.col("n_items") < 3)
    deep_q = state.where(weak).select("qid").join(f.where(F.size("refs.clause_numbers") == 0), "qid")
    deep = phrasing_pass(deep_q, clauses, postings, 4, 48, 48, 80, 16, scopes)
    merged = cut_lineage(fusion.merge_weighted(base, deep, 0.98 * 1.03, "clause_id"))

    state = low_quality_top(f, merged)
    glob = (F.col("n_items") == 0) | (F.col("best") < K.STRICT_MIN_SCORE) | F.col("low_quality")
    open_q = f.where(F.size("refs.document_codes") == 0)
    if fixed is not None:
        open_q = open_q.join(fixed.select("qid"), "qid", "left_anti")
    chosen = state.where(glob).select("qid", F.when(F.col("low_quality"), 1.06).otherwise(0.96).alias("w"))
    wide = phrasing_pass(chosen.select("qid").join(open_q, "qid"), clauses, postings, 3, 50, 50, 80, 16)
    wide = wide.join(chosen, "qid").withColumn("score", F.col("score") * F.col("w") * F.col("w")).drop("w")
    out = fusion.merge_weighted(merged, wide, 1.0, "clause_id")
    return out.withColumn("score", F.round("score", 9))


def phrasing_pass(questions, clauses, postings, passes, dense_k, lexical_k, rerank_n, top_k, scopes=None) -> DataFrame:
    """Hybrid search of the first phrasings of each question, the best score per clause kept.

    Numeric scoring goes by the profile of the original question.
    """
    e = questions.select("qid", F.col("profile").alias("asked"), F.posexplode(F.slice("phrasings", 1, passes)).alias("pos", "question"))
    e = cut_lineage(e.select(F.struct("qid", "pos").alias("qid"), "asked", "question"))
    inside = None if scopes is None else scopes.rekeyed(e, F.col("qid.qid"))
    found = hybrid(e, clauses, postings, dense_k, lexical_k, rerank_n, top_k, numeric_profile="asked", scopes=inside)
    found = found.withColumn("pos", F.col("qid.pos")).withColumn("qid", F.col("qid.qid"))
    row = F.struct(*[F.col(c) for c in found.columns])
    best = found.groupBy("qid", "clause_id").agg(F.max_by(row, F.struct(F.col("score"), -F.col("pos"))).alias("r"))
    return best.select("r.*").drop("pos")
