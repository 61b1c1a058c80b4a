"""Queries over vectors, lexical retrieval, fusion, reranking and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import intent as I
from clausespark.functions import numeric as N
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.functions import vectors as V
from clausespark.operators import candidates as C
from clausespark.operators import evaluate as E
from clausespark.operators import fusion, lexical, rerank, vector
from clausespark.plans import retrieval_sql as P
from clausespark.plans import sql as S
from clausespark.plans.registry import query
from clausespark.plans.text_queries import REFS
from clausespark.session import cut_lineage
from clausespark.sources import adapters as A

big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)

_VEC = "vec AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@query(
    "cosine",
    f"""WITH {_VEC} SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1""",
)
def cosine(spark, sf):
    v = A.vectors(spark, sf)
    a = v.select("vec_id", F.col("vector").alias("a"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("b"))
    return a.join(b, "vec_id").select("vec_id", r6(V.cosine("a", "b")).alias("score"))


@query(
    "knn_topk",
    f"""WITH {_VEC}, p AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM vec a, vec b)
    SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 5""",
)
def knn_topk(spark, sf):
    v = A.vectors(spark, sf)
    q = v.select(F.col("vec_id").alias("qid"), "vector")
    hits = vector.top_k(q, v.select(F.col("vec_id").alias("id"), "vector"), 5, 64)
    return hits.select("qid", "id", r6(F.col("score")).alias("score"), "rank")


@query(
    "knn_filtered",
    f"""WITH {_VEC}, p AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM vec a, vec b
      WHERE a.label = 0 OR b.label IN (a.label, (a.label + 1) % 10))
    SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 5""",
)
def knn_filtered(spark, sf):
    v = A.vectors(spark, sf)
    scope = F.when(F.col("label") == 0, F.array().cast("array<bigint>")).otherwise(F.array("label", (F.col("label") + 1) % 10))
    q = v.select(F.col("vec_id").alias("qid"), "vector", scope.alias("scope"))
    stored = v.select(F.col("vec_id").alias("id"), "vector", F.col("label").alias("key"))
    hits = vector.top_k(q, stored, 5, 64)
    return hits.select("qid", "id", r6(F.col("score")).alias("score"), "rank")


@query(
    "hash_embed",
    f"""WITH {P.sparse_cte('e', 'benchmark', 'item_id', 'text')} SELECT item_id, idx, round(w, 6) AS w FROM e""",
)
def hash_embed(spark, sf):
    q = A.table(spark, sf, "benchmark").select("item_id", V.hash_vector("text").alias("v"))
    e = q.select("item_id", F.explode(F.arrays_zip("v.idx", "v.w")).alias("z"))
    return e.select("item_id", big(F.col("z.idx")).alias("idx"), r6(F.col("z.w")).alias("w"))


@query(
    "mean_pool",
    f"""WITH {_VEC}, c AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM vec),
    m AS (SELECT label, pos, avg(x) AS m FROM c GROUP BY label, pos)
    SELECT label::BIGINT AS label, pos - 1 AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""",
)
def mean_pool(spark, sf):
    v = A.vectors(spark, sf).select(F.col("label").alias("key"), "vector", F.col("vec_id").alias("ord"))
    e = vector.mean_pool(v).select(F.col("key").alias("label"), F.posexplode("vector").alias("pos", "value"))
    return e.select("label", big(F.col("pos")).alias("pos"), r6(F.col("value")).alias("value"))


@query(
    "dense_retrieve",
    f"""WITH {P.BASE}, {P.dense_cte('a', 'question', 24)}
    SELECT qid, clause_id, round(score, 6) AS score, rk AS rank, c.code, 'Band ' || c.clause_number AS title, c.chapter_title, md5(left(c.text, 900)) AS snippet_md5
    FROM adense JOIN clause c USING (clause_id)""",
)
def dense_retrieve(spark, sf):
    c = A.clauses(spark, sf)
    q = C.with_vector(A.questions(spark, sf), "question", "qid", "qid")
    hits = vector.dense_candidates(q, C.with_vector(c, "text", "clause_id", "id"))
    j = hits.join(c, "clause_id")
    return j.select(
        "qid", "clause_id", r6(F.col("dense_score")).alias("score"), F.col("dense_rank").alias("rank"), "code",
        F.concat(F.lit("Band "), "clause_number").alias("title"), "chapter_title", F.md5(F.left("text", F.lit(900))).alias("snippet_md5"),
    )


@query(
    "lexical_retrieve",
    f"""WITH {P.BASE}, {P.terms_cte('a', 'question')}, {P.lexical_cte('a', 24)}
    SELECT qid, clause_id, round(score, 6) AS score, coverage::BIGINT AS coverage, tf::BIGINT AS tf, rk AS rank FROM alex""",
)
def lexical_retrieve(spark, sf):
    hits = lexical.retrieve(A.questions(spark, sf), A.clauses(spark, sf))
    return hits.select(
        "qid", "clause_id", r6(F.col("lexical_score")).alias("score"), big(F.col("coverage")).alias("coverage"),
        big(F.col("tf")).alias("tf"), F.col("lexical_rank").alias("rank"),
    )


@query(
    "seeded_knn",
    f"""WITH {P.BASE}, {P.terms_cte('a', 'question')}, {P.lexical_cte('a', None)}, {P.dense_cte('a', 'question', 24)},
    s AS (SELECT d.* FROM add d JOIN alex l USING (qid, clause_id))
    SELECT qid, clause_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, clause_id) AS rank FROM s) WHERE rank <= 24""",
)
def seeded_knn(spark, sf):
    hits = C.seeded_dense(A.questions(spark, sf), A.clauses(spark, sf), K.DENSE_K)
    return hits.select("qid", F.col("id").alias("clause_id"), r6(F.col("score")).alias("score"), "rank")


@query(
    "rrf",
    f"""WITH {P.BASE}, {P.terms_cte('a', 'question')}, {P.lexical_cte('a', 24)}, {P.dense_cte('a', 'question', 24)}, {P.fused_cte('a')}
    SELECT qid, clause_id, round(hybrid, 9) AS hybrid, round(dense_score, 6) AS dense, round(lexical_score, 6) AS lexical, fr AS rank FROM afused""",
)
def rrf(spark, sf):
    f = C.fused_lists(A.questions(spark, sf), A.clauses(spark, sf))
    return f.select(
        "qid", "clause_id", F.round("hybrid_score", 9).alias("hybrid"), r6(F.col("dense_score")).alias("dense"),
        r6(F.col("lexical_score")).alias("lexical"), F.col("fused_rank").alias("rank"),
    )


@query(
    "fused_texts",
    """WITH p AS (SELECT p_partkey % 50 AS qid, p_partkey AS k, p_name, p_brand, p_type FROM part),
    d AS (SELECT qid, k, p_name AS snippet, 'Band ' || k AS title, CASE WHEN k % 2 = 0 THEN '' ELSE p_brand END AS code FROM p WHERE k % 3 <> 0),
    x AS (SELECT qid, k, p_type AS snippet, CASE WHEN k % 5 = 0 THEN 'Band -' WHEN k % 7 = 0 THEN '' ELSE 'Band L' || k END AS title, p_brand || '-x' AS code FROM p WHERE k % 4 <> 1)
    SELECT coalesce(d.qid, x.qid) AS qid, coalesce(d.k, x.k) AS clause_id, CASE WHEN d.k IS NULL OR length(x.snippet) > length(d.snippet) THEN x.snippet ELSE d.snippet END AS snippet,
      CASE WHEN d.k IS NULL OR x.title NOT IN ('', 'Band -') THEN x.title ELSE d.title END AS title, CASE WHEN d.k IS NULL OR (d.code = '' AND x.k IS NOT NULL) THEN x.code ELSE d.code END AS code
    FROM d FULL JOIN x ON d.qid = x.qid AND d.k = x.k""",
)
def fused_texts(spark, sf):
    k = F.col("p_partkey")
    p = A.table(spark, sf, "part").select((k % 50).alias("qid"), k.alias("clause_id"), "p_name", "p_brand", "p_type")
    k, nr = F.col("clause_id"), F.col("clause_id").cast("string")
    dense = p.where(k % 3 != 0).select("qid", "clause_id", F.col("p_name").alias("snippet"), F.concat(F.lit("Band "), nr).alias("title"), F.when(k % 2 == 0, "").otherwise(F.col("p_brand")).alias("code"))
    title = F.when(k % 5 == 0, "Band -").when(k % 7 == 0, "").otherwise(F.concat(F.lit("Band L"), nr))
    found = p.where(k % 4 != 1).select("qid", "clause_id", F.col("p_type").alias("snippet"), title.alias("title"), F.concat("p_brand", F.lit("-x")).alias("code"))
    return fusion.shown_texts(dense, found)


def fused_items(spark, sf):
    """Fused head of every library question with clause texts."""
    c = A.clauses(spark, sf)
    q = A.questions(spark, sf)
    best = C.fused_lists(q, c).where(F.col("fused_rank") <= K.RERANK_CANDIDATES)
    return best.join(rerank.with_question_features(q), "qid").join(c.withColumn("snippet", F.col("text")), "clause_id")


@query(
    "rerank",
    f"""WITH {P.BASE}, {P.terms_cte('a', 'question')}, {P.lexical_cte('a', 24)}, {P.dense_cte('a', 'question', 24)}, {P.fused_cte('a')},
    {P.rerank_cte('a', 'question', 40)} SELECT qid, clause_id, round(rerank, 6) AS score, overlap, rk AS rank FROM arr""",
)
def rerank_q(spark, sf):
    w = F.row_number().over(vector.Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "clause_id"))
    s = rerank.rerank_scores(fused_items(spark, sf))
    return s.select("qid", "clause_id", r6(F.col("rerank_score")).alias("score"), big(F.col("overlap")).alias("overlap"), big(w).alias("rank"))


@query(
    "near_dup",
    f"""WITH RECURSIVE {P.BASE}, {P.terms_cte('a', 'question')}, {P.lexical_cte('a', 24)}, {P.dense_cte('a', 'question', 24)}, {P.fused_cte('a')},
    {P.rerank_cte('a', 'question', 40)}, {P.suppress_cte('a', 8)} SELECT qid, clause_id, final_rank FROM abest""",
)
def near_dup(spark, sf):
    kept = rerank.rerank(fused_items(spark, sf))
    return kept.select("qid", "clause_id", "final_rank")


@query(
    "clause_candidates",
    f"""WITH RECURSIVE {P.BASE}, {P.hybrid_cte('a', 'question')}
    SELECT qid, clause_id, code, round(score, 6) AS score, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(numeric, 6) AS numeric FROM acand""",
)
def clause_candidates(spark, sf):
    h = C.hybrid(A.questions(spark, sf), A.clauses(spark, sf))
    return h.select("qid", "clause_id", "code", *[r6(F.col(c)).alias(c) for c in ("score", "semantic", "keyword", "numeric")])


@query(
    "exact_clause",
    f"""WITH {S.CLAUSE}, t AS (SELECT p_partkey AS qid, (p_size % 9 + 1) || '.' || (p_partkey % 40 + 1) AS clause_number,
      CASE WHEN p_partkey % 2 = 0 THEN {S.code('(p_partkey % 1000)')} END AS code FROM part),
    j AS (SELECT t.qid, c.clause_id, c.code, c.clause_number FROM t JOIN clause c USING (clause_number) WHERE t.code IS NULL OR t.code = c.code)
    SELECT qid, clause_id, code, clause_number, 1.35::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY clause_id) AS rank FROM j) WHERE rank <= 6""",
)
def exact_clause(spark, sf):
    k = F.col("p_partkey")
    number = F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("."), (k % 40 + 1).cast("string"))
    text = F.concat(F.when(k % 2 == 0, F.concat(A.code_of(k % 1000), F.lit(" "))).otherwise(""), number, F.lit("-band nima deydi"))
    q = A.table(spark, sf, "part").select(k.alias("qid"), text.alias("question")).withColumn("r", R.exact_refs("question"))
    r = q.select("qid", "r.clause_numbers", "r.document_codes")
    return C.exact_clauses(r, A.clauses(spark, sf)).withColumn("score", F.col("score").cast("double"))


@query(
    "keyword_fallback",
    f"""WITH {P.BASE}, {P.features_cte('a', 'question')}, pq AS (SELECT qid, question AS text FROM question), {S.profile_cte('pq', 'prof')},
    tt AS (SELECT qid, len(terms) AS n, unnest(terms) AS term FROM afeat),
    hit {P.MAT} (SELECT term, clause_id, (length(b) - length(replace(b, term, ''))) // length(term) AS tf FROM (SELECT DISTINCT term FROM tt), hay WHERE contains(b, term)),
    g {P.MAT} (SELECT qid, clause_id, max(n) AS n, count(*) AS cov, sum(tf) AS tf FROM tt JOIN hit USING (term) GROUP BY qid, clause_id),
    g2 AS (SELECT g.*, p.is_numeric FROM g JOIN prof p USING (qid) WHERE NOT (cov = 1 AND g.n >= 4 AND tf < 2)),
    pp AS (SELECT g2.qid, clause_id AS tid, text FROM g2 JOIN clause USING (clause_id) WHERE is_numeric), {S.match_cte('prof', 'pp')},
    sc AS (SELECT g2.qid, clause_id, round(cov / n * 0.75 + least(0.25, tf * 0.04) + coalesce(m.score, 0) * 0.2, 9) AS score, cov / n AS kw, coalesce(m.score, 0) AS num
           FROM g2 LEFT JOIN nm m ON m.pair = g2.qid || '#' || clause_id)
    SELECT qid, clause_id, round(score, 6) AS score, round(kw, 6) AS keyword, round(num, 6) AS numeric, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, clause_id) AS rank FROM sc) WHERE rank <= 8""",
)
def keyword_fallback(spark, sf):
    k = C.keyword_fallback(A.questions(spark, sf), A.clauses(spark, sf))
    return k.select("qid", "clause_id", r6(F.col("score")).alias("score"), r6(F.col("keyword")).alias("keyword"), r6(F.col("numeric")).alias("numeric"), "rank")


# --------------------------------------------------------------------- rows
def row_search(spark, sf, rows=None):
    """Rows with their search text and the combined haystack."""
    # the tables are written, so that the planner knows how few they are and never broadcasts the rows
    r, t = A.rows(spark, sf) if rows is None else rows, cut_lineage(A.tables(spark, sf).select("table_id", "code", "title", "section_title"))
    j = r.join(t, "table_id")
    vals = F.array_join("texts", " | ")
    search = F.concat_ws(
        "\n", F.concat(F.lit("Hujjat: "), "code"), F.concat(F.lit("Jadval: "), "table_number"),
        F.concat(F.lit("Sarlavha: "), "title"), F.concat(F.lit("Qiymatlar: "), vals),
    )
    s = j.withColumn("search_text", search)
    combined = F.concat_ws(" | ", "search_text", F.concat(F.lit("Row: "), vals), "title", "section_title")
    return s.withColumn("combined", combined)


def row_questions(spark, sf):
    """One question per part name, asked about table rows."""
    p = A.table(spark, sf, "part")
    g = p.groupBy("p_name").agg(F.min("p_partkey").alias("qid"), F.min("p_type").alias("t"))
    k = F.col("qid") % 3
    text = (
        F.when(k == 0, F.concat("p_name", F.lit(" jadval satr: qaysi material talab "), F.col("t"), F.lit("?")))
        .when(k == 1, F.concat(F.col("p_name"), F.lit(" ustun")))
        .otherwise(F.concat(F.lit("zzz jadval "), F.md5("p_name")))
    )
    return g.select("qid", text.alias("question")).withColumn("row_priority", I.gates("question")["row_priority"])


def _row_sql(norm_row: str, rowq: str) -> str:
    return f"""{S.NORM_TABLE}, {norm_row},
rowtext AS (SELECT r.row_id, r.table_id, r.table_number, r.row_index, t.code, 'Hujjat: ' || t.code || chr(10) || 'Jadval: ' || r.table_number || chr(10)
   || 'Sarlavha: ' || t.title || chr(10) || 'Qiymatlar: ' || array_to_string(texts, ' | ') AS search_text, t.title, t.section_title, texts
   FROM norm_row r JOIN norm_table t USING (table_id)),
rowfull AS (SELECT *, search_text || ' | Row: ' || array_to_string(texts, ' | ') || ' | ' || title || ' | ' || section_title AS combined FROM rowtext),
rowq AS ({rowq})"""


ROW_SQL = _row_sql(
    S.NORM_ROW,
    """SELECT min(p_partkey) AS qid, CASE min(p_partkey) % 3 WHEN 0 THEN p_name || ' jadval satr: qaysi material talab ' || min(p_type) || '?'
   WHEN 1 THEN p_name || ' ustun' ELSE 'zzz jadval ' || md5(p_name) END AS question FROM part GROUP BY p_name""",
)


def _row_candidates_sql(source: str, numeric: bool = False) -> str:
    valued = scored = met = extra = shown = ""
    num = "0"
    if numeric:
        near = "CASE WHEN a.metres IS NOT NULL THEN abs(a.metres - b.metres) <= 0.02 ELSE a.unit = b.unit AND a.value = b.value END"
        valued = f" UNION SELECT a.qid, b.qid FROM prof_ev a JOIN rowev b ON {near} JOIN ft ON ft.qid = a.qid AND (len(ft.terms) > 0 OR ft.pri)"
        scored = f"pp {P.MAT} (SELECT qid, row_id AS tid, combined AS text FROM cnd JOIN rowfull USING (row_id)), {S.match_cte('prof', 'pp', 'nm')},"
        num, met = "coalesce(m.score, 0)", " LEFT JOIN nm m ON m.pair = c.qid || '#' || c.row_id"
        extra, shown = f" + CASE WHEN is_numeric THEN num * {max(0.12, K.NUMERIC_WEIGHT * 0.85)!r}::DOUBLE ELSE 0 END", ", round(num, 6) AS numeric"
        source = f"{source}, {S.evidence_cte('(SELECT row_id AS qid, combined AS text FROM rowfull)', 'rowev')}"
    return f"""WITH {source}, {P.sparse_cte('rv', 'rowtext', 'row_id', 'search_text')}, {P.dense_cte('a', 'rowq', 8, 'rv', 'row_id')}, {P.features_cte('a', 'rowq')},
    pq AS (SELECT qid, question AS text FROM rowq), {S.profile_cte('pq', 'prof')},
    ft AS (SELECT *, {S.any_of('norm', K.ROW_TABLE_TERMS)} AND {S.any_of('norm', K.ROW_FOCUS_TERMS)} AND {S.any_of('norm', K.ROW_QUESTION_TERMS)}
           AND NOT {S.any_of('norm', K.DOCUMENT_LIST_PHRASES)} AS pri FROM afeat),
    rh AS (SELECT *, {S.fold('search_text')} AS hs, {S.norm('combined')} AS h FROM rowfull),
    hit AS (SELECT f.qid, r.row_id FROM ft f, rh r WHERE len(list_filter(terms, lambda t: contains(r.hs, t))) > 0),
    cnd AS (SELECT * FROM hit UNION SELECT qid, row_id FROM adense JOIN ft USING (qid) WHERE len(terms) > 0 OR pri{valued}),{scored}
    x AS (SELECT c.qid, c.row_id, coalesce(d.score, 0) AS sem, f.*EXCLUDE(qid), r.*EXCLUDE(row_id), p.is_numeric, {num} AS num FROM cnd c JOIN ft f USING (qid) JOIN rh r USING (row_id)
          JOIN prof p USING (qid) LEFT JOIN add d USING (qid, row_id){met}),
    y AS (SELECT *, {S.coverage('terms', 'h')} AS cov, {S.frequency('terms', 'h')} AS tf, {S.coverage('specific', 'h')} AS sc,
          greatest({S.kw('terms', 'h')}, {S.kw('specific', 'h')}) AS kw FROM x),
    z AS (SELECT *, round(sem * 0.85 + kw * 0.6 + least(0.35, tf * 0.06) + CASE WHEN contains(h, norm) THEN 0.35 ELSE 0 END
          + CASE WHEN pri AND cov >= 2 THEN 0.12 ELSE 0 END{extra}, 9) AS score FROM y),
    k AS (SELECT * FROM z WHERE NOT (len(specific) > 0 AND sc = 0 AND sem < 0.2 AND NOT pri) AND NOT (NOT pri AND score < 0.16 AND kw <= 0)
          AND NOT (pri AND cov = 0 AND sem < 0.16))
    SELECT qid, row_id, table_id, table_number, code, round(score, 6) AS score, round(sem, 6) AS semantic, round(kw, 6) AS keyword{shown}, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM k) WHERE rank <= 8"""


@query("row_candidates", _row_candidates_sql(ROW_SQL))
def row_candidates(spark, sf):
    r = C.row_candidates(row_questions(spark, sf), row_search(spark, sf), K.ROW_INTENT_TOP_K)
    return r.select("qid", "row_id", "table_id", "table_number", "code", *[r6(F.col(c)).alias(c) for c in ("score", "semantic", "keyword")], "rank")


_VALUE_ROW = """norm_row AS (
  SELECT p_partkey AS row_id, p_brand AS table_id, p_partkey AS row_index,
         regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS document_id, regexp_extract(p_brand, '(\\d+)', 1) AS table_number,
         [p_name, CASE p_partkey % 3 WHEN 0 THEN p_size || ' mm' WHEN 1 THEN (p_size // 10) || ',' || (p_size % 10) || ' sm'
           ELSE 'qalinligi kamida ' || p_size || ' mm bo''lishi kerak' END] AS texts FROM part)"""
_VALUE_Q = """SELECT DISTINCT p_size::BIGINT AS qid, CASE p_size % 3 WHEN 0 THEN 'qalinligi kamida ' || p_size || ' mm' WHEN 1 THEN CASE WHEN p_size < 10 THEN '' ELSE 'qoplama ' END || p_size || ' mm' ELSE 'necha ' || p_size || ' sm yoki ' || (p_size + 1) || ' mm' END AS question FROM part"""


@query("numeric_row_candidates", _row_candidates_sql(_row_sql(_VALUE_ROW, _VALUE_Q), True))
def numeric_row_candidates(spark, sf):
    """Rows whose last cell states a length, asked for by value in the same or another unit."""
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 3
    small = F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit(","), (F.col("p_size") % 10).cast("string"), F.lit(" sm"))
    must = F.concat(F.lit("qalinligi kamida "), size, F.lit(" mm bo'lishi kerak"))
    stated = F.when(k == 0, F.concat(size, F.lit(" mm"))).when(k == 1, small).otherwise(must)
    p = A.table(spark, sf, "part")
    said = p.select(F.col("p_partkey").alias("row_id"), F.array("p_name", stated).alias("texts"))
    rows = A.rows(spark, sf).drop("texts").join(said, "row_id")
    m = F.col("p_size") % 3
    one, two = F.concat(F.lit("qalinligi kamida "), size, F.lit(" mm")), F.concat(F.when(F.col("p_size") < 10, "").otherwise("qoplama "), size, F.lit(" mm"))
    three = F.concat(F.lit("necha "), size, F.lit(" sm yoki "), (F.col("p_size") + 1).cast("string"), F.lit(" mm"))
    q = p.select(F.col("p_size").cast("bigint").alias("qid"), F.when(m == 0, one).when(m == 1, two).otherwise(three).alias("question")).distinct()
    r = C.row_candidates(q.withColumn("row_priority", I.gates("question")["row_priority"]), row_search(spark, sf, rows), K.ROW_INTENT_TOP_K)
    return r.select("qid", "row_id", "table_id", "table_number", "code", *[r6(F.col(c)).alias(c) for c in ("score", "semantic", "keyword", "numeric")], "rank")


@query(
    "row_fallback",
    f"""WITH {ROW_SQL}, {P.features_cte('a', 'rowq')}, rh AS (SELECT row_id, {S.norm("array_to_string(texts, ' | ')")} AS h FROM rowtext),
    x AS (SELECT f.qid, row_id, {S.coverage('terms', 'h')} AS cov, {S.frequency('terms', 'h')} AS tf, len(terms) AS n FROM afeat f, rh
          WHERE len(list_filter(terms, lambda t: contains(h, t))) > 0),
    z AS (SELECT *, round(cov * 0.55 + least(0.55, tf * 0.07), 9) AS score FROM x)
    SELECT qid, row_id, round(score, 6)::DOUBLE AS score, round(cov / n, 6) AS keyword, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM z) WHERE rank <= 8""",
)
def row_fallback(spark, sf):
    r = C.row_fallback(row_questions(spark, sf), A.cells(spark, sf), 8)
    return r.select("qid", "row_id", r6(F.col("score")).alias("score"), r6(F.col("keyword")).alias("keyword"), "rank")


@query(
    "image_candidates",
    f"""WITH question AS (SELECT item_id AS qid, text AS question FROM benchmark), img AS (SELECT page_id AS image_id,
      {S.squeeze("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')")} || ' | URL: ' || url AS context FROM pages),
    {P.sparse_cte('iv', 'img', 'image_id', 'context')}, {P.dense_cte('a', 'question', 3, 'iv', 'image_id')}, {P.features_cte('a', 'question')},
    ih AS (SELECT image_id, {S.norm('context')} AS h FROM img),
    x AS (SELECT f.qid, i.image_id, coalesce(d.score, 0) AS sem, {S.kw('terms', 'i.h')} AS kw FROM afeat f CROSS JOIN ih i LEFT JOIN add d ON d.qid = f.qid AND d.image_id = i.image_id),
    z AS (SELECT *, round(sem + 0.15 * kw, 9) AS score FROM x)
    SELECT qid, image_id, round(score, 6) AS score, round(sem, 6) AS semantic, round(kw, 6) AS keyword, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, image_id) AS rank FROM z WHERE score >= 0.22 OR kw > 0) WHERE rank <= 3""",
)
def image_candidates(spark, sf):
    r = found_images(spark, sf)
    return r.select("qid", "image_id", *[r6(F.col(c)).alias(c) for c in ("score", "semantic", "keyword")], "rank")


def found_images(spark, sf):
    title = X.squeeze(F.regexp_replace(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), "<[^>]+>", " "))
    img = A.texts(spark, sf, "pages").select(F.col("page_id").alias("image_id"), F.concat(title, F.lit(" | URL: "), "url").alias("context"))
    return C.image_candidates(A.questions(spark, sf), img)


@query(
    "images_admitted",
    f"""WITH {P.BASE}, img AS (SELECT page_id AS image_id,
      {S.squeeze("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')")} || ' | URL: ' || url AS context FROM pages),
    {P.sparse_cte('iv', 'img', 'image_id', 'context')}, {P.dense_cte('a', 'question', 3, 'iv', 'image_id')}, {P.features_cte('a', 'question')}, {P.dense_cte('b', 'question', 1)},
    ih AS (SELECT image_id, {S.norm('context')} AS h FROM img),
    x AS (SELECT f.qid, i.image_id, coalesce(d.score, 0) AS sem, {S.kw('terms', 'i.h')} AS kw FROM afeat f CROSS JOIN ih i LEFT JOIN add d ON d.qid = f.qid AND d.image_id = i.image_id),
    z AS (SELECT *, round(sem + 0.15 * kw, 9) AS score FROM x),
    top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, image_id) AS rank FROM z WHERE score >= 0.22 OR kw > 0 QUALIFY rank <= 3),
    sg AS (SELECT q.qid, regexp_matches({S.norm('question')}, 'rasm|image|diagramma|sxema|surat|chizma') AS asks, coalesce(b.score, 0) AS best FROM question q LEFT JOIN bdense b USING (qid))
    SELECT top.qid, image_id, round(score, 6) AS score, rank FROM top JOIN sg USING (qid) WHERE asks OR (best < 0.5 AND score >= 0.3)""",
)
def images_admitted(spark, sf):
    """Image candidates by the question's words and its best clause; a clause answers from cosine 0.5 on here."""
    q = A.questions(spark, sf)
    best = vector.top_k(C.with_vector(q, "question", "qid", "qid"), C.with_vector(A.clauses(spark, sf), "text", "clause_id", "id"), 1, K.HASH_DIM)
    asks = X.normalize_text("question").rlike("|".join(K.IMAGE_TERMS))
    signals = q.select("qid", asks.alias("asks_image")).join(best.select("qid", F.col("score").alias("clause_score")), "qid", "left")
    r = C.admitted_images(found_images(spark, sf), signals, clause_floor=0.5)
    return r.select("qid", "image_id", r6(F.col("score")).alias("score"), "rank")


@query(
    "fewshot_topk",
    f"""WITH question AS (SELECT conv_id AS qid, text AS question FROM conversations WHERE turn = (SELECT min(turn) FROM conversations c2 WHERE c2.conv_id = conversations.conv_id AND c2.role = 'user') AND role = 'user'),
    lib AS (SELECT item_id, text FROM benchmark), {P.sparse_cte('lv', 'lib', 'item_id', 'text')}, {P.dense_cte('a', 'question', 3, 'lv', 'item_id')}
    SELECT qid, item_id, round(score, 6) AS score, rk AS rank FROM adense""",
)
def fewshot_topk(spark, sf):
    c = A.texts(spark, sf, "conversations").where("role = 'user'")
    first = c.groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("question"))
    lib = C.with_vector(A.table(spark, sf, "benchmark"), "text", "item_id", "id")
    hits = vector.top_k(C.with_vector(first, "question", "qid", "qid"), lib, 3, K.HASH_DIM)
    return hits.select("qid", F.col("id").alias("item_id"), r6(F.col("score")).alias("score"), "rank").where("score > 0")


# ---------------------------------------------------------------- discovery
def _library(spark, sf):
    """Library questions with their references and phrasings."""
    q = A.questions(spark, sf).withColumn("refs", R.exact_refs("question"))
    return q.withColumn("phrasings", I.expansions("question", F.col("refs"), N.query_profile("question")))


def _discovery_sql(scope: str | None = None) -> str:
    """SQL of the discovery passes; ``scope`` names the table of (qid, clause_id) that the passes before the wide one may use."""
    exp = f"""xs AS (SELECT qid, {S.squeeze('question')} AS base, {S.simple('question')} AS nb, p.is_numeric, p.comparator, p.props FROM question JOIN aprof p USING (qid))"""
    phr = (
        "SELECT qid, 0 AS pos, base AS question FROM xs UNION ALL SELECT qid, 1, base || ' shnq band talabi' FROM xs "
        "UNION ALL SELECT qid, 2, base || ' normativ band' FROM xs UNION ALL SELECT qid, 3, CASE WHEN is_numeric THEN CASE comparator "
        "WHEN 'min' THEN base || ' kamida me''yor' WHEN 'max' THEN base || ' ko''pi bilan me''yor' ELSE base || ' sonli norma' END END AS question FROM xs"
    )
    low = lambda items: f"""(SELECT f.qid, coalesce(t.score, 0) AS best, coalesce(t.n, 0) AS n, CASE WHEN t.qid IS NULL THEN true WHEN len(f.anchors) = 0 THEN false
      ELSE {S.kw('f.anchors', 't.h')} <= 0 AND (t.semantic < 0.7 OR t.keyword < 0.82) END AS low FROM afeat f LEFT JOIN (
        SELECT qid, max(score) AS score, count(*) AS n, arg_max({S.norm('snippet')}, (score, clause_id)) AS h, arg_max(semantic, (score, clause_id)) AS semantic,
               arg_max(keyword, (score, clause_id)) AS keyword FROM {items} GROUP BY qid) t USING (qid))"""
    held = " AND qid % 6 <> 1" if scope else ""  # every sixth question keeps to its scope
    deep = f" deep {P.MAT} (SELECT dq.qid, s.clause_id FROM dq JOIN {scope} s ON s.qid = dq.qid // 10)," if scope else ""
    return f"""WITH RECURSIVE {P.BASE}, {P.hybrid_cte('a', 'question', scope=scope)}, {exp}, phr {P.MAT} (SELECT * FROM ({phr}) WHERE question IS NOT NULL),
    st1 AS {low('acand')}, weak AS (SELECT qid FROM st1 WHERE n = 0 OR best < 0.24 OR n < 3),
    dq {P.MAT} (SELECT qid * 10 + pos AS qid, question FROM phr WHERE qid IN (SELECT qid FROM weak) AND pos < 4),{deep}
    {P.hybrid_cte('d', 'dq', 48, 48, 80, 16, 'dask', 'deep' if scope else None)},
    m1 {P.MAT} (SELECT qid, clause_id, max(score) AS score, arg_max(snippet, score) AS snippet, arg_max(semantic, score) AS semantic, arg_max(keyword, score) AS keyword FROM (
        SELECT qid, clause_id, score, snippet, semantic, keyword FROM acand UNION ALL
        SELECT qid // 10, clause_id, score * (0.98::DOUBLE * 1.03::DOUBLE), snippet, semantic, keyword FROM dcand) GROUP BY qid, clause_id),
    st2 AS {low('m1')}, gq0 AS (SELECT qid, CASE WHEN low THEN 1.06::DOUBLE ELSE 0.96::DOUBLE END AS w FROM st2 WHERE (n = 0 OR best < 0.24 OR low){held}),
    gq {P.MAT} (SELECT qid * 10 + pos AS qid, question FROM phr WHERE qid IN (SELECT qid FROM gq0) AND pos < 3), {P.hybrid_cte('g', 'gq', 50, 50, 80, 16, 'gask')},
    m2 AS (SELECT qid, clause_id, max(score) AS score FROM (SELECT qid, clause_id, score FROM m1 UNION ALL
        SELECT g.qid // 10, clause_id, score * w * w FROM gcand g JOIN gq0 ON gq0.qid = g.qid // 10) GROUP BY qid, clause_id)
    SELECT qid, clause_id, round(round(score, 9), 6) AS score FROM m2"""


def _with_asked(sql: str) -> str:
    """Profiles of the original questions under the phrasing keys."""
    for p, src in (("d", "dq"), ("g", "gq")):
        sql = sql.replace(
            f"{p}pa AS (", f"{p}ask {P.MAT} (SELECT x.qid, p.*EXCLUDE(qid) FROM {src} x JOIN aprof p ON p.qid = x.qid // 10),\n{p}pa AS ("
        )
    return sql


@query("deep_discovery", _with_asked(_discovery_sql()))
def deep_discovery(spark, sf):
    c = C.indexed(A.clauses(spark, sf))
    q = _library(spark, sf)
    d = C.discover(q, c, C.hybrid(q.select("qid", "question"), c))
    return d.select("qid", "clause_id", r6(F.col("score")).alias("score"))


@query(
    "dual_phrase_merge",
    f"""WITH RECURSIVE {P.BASE}, {P.hybrid_cte('a', 'question')}, second AS (SELECT qid, question || ' qurilish me''yori' AS question FROM question WHERE qid NOT IN (
       SELECT qid FROM acand GROUP BY qid HAVING max(score) >= 0.35)), {P.hybrid_cte('b', 'second')}
    SELECT qid, clause_id, round(max(score), 6) AS score FROM (SELECT qid, clause_id, score FROM acand UNION ALL SELECT qid, clause_id, score * 0.97 FROM bcand)
    GROUP BY qid, clause_id""",
)
def dual_phrase_merge(spark, sf):
    q, c = A.questions(spark, sf), C.indexed(A.clauses(spark, sf))
    first = cut_lineage(C.hybrid(q, c))  # read twice
    strong = first.groupBy("qid").agg(F.max("score").alias("best")).where(F.col("best") >= K.TRANSLATION_THRESHOLD)
    again = cut_lineage(q.join(strong, "qid", "left_anti").withColumn("question", F.concat("question", F.lit(" qurilish me'yori"))))
    merged = fusion.merge_weighted(first, C.hybrid(again, c), K.TRANSLATED_WEIGHT, "clause_id")
    return merged.select("qid", "clause_id", r6(F.col("score")).alias("score"))


# --------------------------------------------------------------- evaluation
_EXPECT = """expect AS (SELECT DISTINCT b.item_id AS qid, d.doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
_EVAL = f"""WITH {P.BASE}, {S.DOCUMENT}, {P.terms_cte('a', 'question')}, {P.lexical_cte('a', 10)}, {_EXPECT},
ec AS (SELECT e.qid, e.document_id, d.code FROM expect e JOIN document d USING (document_id)),
r AS (SELECT l.qid, l.rk, bool_or(e.code IS NOT NULL) AS m FROM alex l JOIN clause c USING (clause_id) LEFT JOIN ec e ON e.qid = l.qid AND lower(e.code) = lower(c.code) GROUP BY l.qid, l.rk),
cases AS (SELECT q.qid, coalesce(bool_or(m), false) AS hit, coalesce(1.0::DOUBLE / min(CASE WHEN m THEN rk END), 0) AS rr FROM question q LEFT JOIN r USING (qid) GROUP BY q.qid)"""


def _expectations(spark, sf):
    """Documents that contain a library question word for word: (qid, document_id)."""
    return E.containing_documents(A.questions(spark, sf), A.texts(spark, sf, "documents"))


def _cases(spark, sf):
    hits = lexical.retrieve(A.questions(spark, sf), A.clauses(spark, sf), 10)
    c = A.clauses(spark, sf).select("clause_id", "code", "clause_number")
    results = hits.join(c, "clause_id").select("qid", F.col("lexical_rank").alias("rank"), "code", "clause_number", F.lit(None).cast("string").alias("table_number"))
    docs = A.documents(spark, sf).select("document_id", "code")
    exp = _expectations(spark, sf).join(docs, "document_id").select("qid", F.lit("code").alias("field"), F.col("code").alias("value"))
    return E.cases(A.questions(spark, sf).select("qid"), results, exp, 10)


@query("eval_cases", f"{_EVAL} SELECT qid, hit, round(rr, 6) AS reciprocal_rank, hit AS doc_hit, false AS clause_hit, false AS table_hit FROM cases")
def eval_cases(spark, sf):
    return _cases(spark, sf).withColumn("reciprocal_rank", r6(F.col("reciprocal_rank")))


@query(
    "eval_summary",
    f"""{_EVAL} SELECT count(*) AS total, round(coalesce(avg(hit::INT), 0), 6) AS hit_rate, round(coalesce(avg(rr), 0), 6) AS mrr,
    round(coalesce(avg(hit::INT), 0), 6) AS doc_hit_rate, 0.0::DOUBLE AS clause_hit_rate, 0.0::DOUBLE AS table_hit_rate FROM cases""",
)
def eval_summary(spark, sf):
    s = E.summary(_cases(spark, sf))
    return s.select("total", *[r6(F.col(c)).alias(c) for c in ("hit_rate", "mrr", "doc_hit_rate", "clause_hit_rate", "table_hit_rate")])
