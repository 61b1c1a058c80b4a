"""Queries over filters, routing, ordering, confidence, disposition and answer sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import intent as I
from clausespark.functions import numeric as N
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.operators import answering as Q
from clausespark.operators import candidates as C
from clausespark.operators import fusion, lexical, rerank, vector
from clausespark.plans import retrieval_sql as P
from clausespark.plans import sql as S
from clausespark.plans.registry import query
from clausespark.plans.text_queries import REFS, _INTENT, ref_table
from clausespark.session import cut_lineage
from clausespark.sources import adapters as A

big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)
bar = lambda c: F.array_join(c, "|")

# intent of the list questions by construction
_M_INTENT = """CASE m WHEN 0 THEN 'table_lookup' WHEN 1 THEN 'image_lookup' WHEN 2 THEN 'exact_band_reference'
 WHEN 3 THEN 'topical_search' WHEN 4 THEN 'topical_search' ELSE 'general_synthesis' END"""
_M_NUMBER = "CASE WHEN m = 2 THEN (1 + qid % 3) || '.' || (qid % 4) END"


def item_features(spark, sf):
    """Order questions with references, intent, gates and profile."""
    q = A.item_questions(spark, sf).withColumn("refs", R.exact_refs("question"))
    q = q.withColumn("i", I.classify("question", F.col("refs"))).withColumn("intent", F.col("i.intent")).drop("i")
    return q


@query(
    "metadata_filter",
    f"""WITH {S.ITEM} SELECT qid, item_id FROM item WHERE
      (qid % 3 <> 0 OR lower(code) = lower({S.code('(qid % 5)')})) AND (qid % 4 <> 1 OR coalesce(clause_number, '') IN ('1.1', '2.2'))
      AND (qid % 5 <> 2 OR contains(lower(chapter), 'a-b'))""",
)
def metadata_filter(spark, sf):
    it, k = A.items(spark, sf), F.col("qid")
    empty = F.array().cast("array<string>")
    lists = {
        "code": (F.when(k % 3 == 0, F.array(F.lower(A.code_of(k % 5)), F.lit(" "))).otherwise(empty), "equal"),
        "clause_number": (F.when(k % 4 == 1, F.array(F.lit(" 1.1"), F.lit("2.2 "))).otherwise(empty), "equal"),
        "chapter": (F.when(k % 5 == 2, F.array(F.lit("A-B"))).otherwise(empty), "contains"),
    }
    return it.where(Q.matches_filters(lists)).select("qid", "item_id")


@query(
    "build_filters",
    f"""WITH {REFS}, {_INTENT} SELECT qid, {S.joined('codes')} AS codes, {S.joined('clauses')} AS clauses, {S.joined('tables')} AS tables,
      {S.joined('appendices')} AS appendices,
      {S.joined("list_concat(list_transform(chapters, lambda c: 'bob ' || c), list_transform(chapters, lambda c: c || '-bob'))")} AS titles,
      CASE intent WHEN 'table_lookup' THEN 'table_row' WHEN 'image_lookup' THEN 'image' WHEN 'exact_band_reference' THEN 'clause' ELSE '' END AS kinds FROM intents""",
)
def build_filters(spark, sf):
    t = ref_table(spark, sf).withColumn("r", R.exact_refs("text"))
    t = t.withColumn("f", I.metadata_filters(I.classify("text", F.col("r"))["intent"], F.col("r")))
    return t.select(
        "qid", bar("f.document_codes").alias("codes"), bar("f.clause_numbers").alias("clauses"), bar("f.table_numbers").alias("tables"),
        bar("f.appendix_numbers").alias("appendices"), bar("f.section_titles").alias("titles"), bar("f.content_types").alias("kinds"),
    )


@query(
    "scope_resolve",
    f"""WITH {S.DOCUMENT}, {S.CLAUSE}, scope AS (SELECT DISTINCT item_id % 20 AS sid FROM benchmark),
    c AS (SELECT sid, code FROM scope JOIN document ON sid % 4 = 0 AND category_code = (SELECT source FROM documents WHERE doc_id = sid)
     UNION SELECT sid, code FROM scope JOIN document ON sid % 4 = 1 AND section_code = (SELECT lang FROM documents WHERE doc_id = sid)
     UNION SELECT sid, code FROM scope JOIN clause ON sid % 4 = 2 AND contains(chapter_title, (10 + sid) || '-bob')
     UNION SELECT sid, {S.code('sid')} FROM scope)
    SELECT sid, count(DISTINCT lower(code)) AS n_codes, min(code) AS first_code, max(code) AS last_code FROM c GROUP BY sid""",
)
def scope_resolve(spark, sf):
    d = A.documents(spark, sf)
    s = A.table(spark, sf, "benchmark").select((F.col("item_id") % 20).alias("sid")).distinct()
    own = s.join(d.select(F.col("document_id").alias("sid"), "category_code", "section_code"), "sid")
    by_cat = own.where("sid % 4 = 0").select("sid", "category_code").join(d, "category_code").select("sid", "code")
    by_sec = own.where("sid % 4 = 1").select("sid", "section_code").join(d, "section_code").select("sid", "code")
    chapters = A.clauses(spark, sf).select("code", F.regexp_extract("chapter_title", r"(\d+-bob)", 1).alias("chapter")).distinct()
    want = s.where("sid % 4 = 2").withColumn("chapter", F.concat((F.col("sid") + 10).cast("string"), F.lit("-bob")))
    tails = F.transform(F.sequence(F.lit(1), F.length("chapter") - 4), lambda i: F.substring(F.col("chapter"), i, F.length("chapter")))
    by_title = chapters.select("code", F.explode(tails).alias("chapter")).join(want, "chapter").select("sid", "code")
    explicit = s.select("sid", A.code_of(F.col("sid")).alias("code"))
    u = by_cat.unionByName(by_sec).unionByName(by_title).unionByName(explicit)
    u = u.withColumn("k", F.lower("code")).dropDuplicates(["sid", "k"])
    return u.groupBy("sid").agg(F.count(F.lit(1)).alias("n_codes"), F.min("code").alias("first_code"), F.max("code").alias("last_code"))


@query(
    "ilike_any",
    f"""WITH {P.BASE}, {P.terms_cte('a', 'question')}, h AS (SELECT DISTINCT qid, clause_id FROM aterms t JOIN hay ON contains(b, term))
    SELECT qid, count(*) AS n_clauses FROM h GROUP BY qid""",
)
def ilike_any(spark, sf):
    h = lexical.containing(A.clauses(spark, sf), lexical.question_terms(A.questions(spark, sf)))
    return h.groupBy("qid").agg(F.count(F.lit(1)).alias("n_clauses"))


@query(
    "semi_scope",
    f"""WITH {S.CLAUSE}, {S.NORM_TABLE} SELECT clause_id, code FROM clause WHERE code IN (SELECT code FROM norm_table)""",
)
def semi_scope(spark, sf):
    return A.clauses(spark, sf).select("clause_id", "code").join(A.tables(spark, sf).select("code"), "code", "left_semi").select("clause_id", "code")


@query(
    "hydrate_clauses",
    f"""WITH {S.CLAUSE}, {S.DOCUMENT}, want AS (SELECT DISTINCT (l_orderkey % 1000) || ':' || l_linenumber AS clause_id FROM lineitem)
    SELECT w.clause_id, c.clause_number, c.chapter_title, d.code, d.title, coalesce('Band ' || c.clause_number, 'Band -') AS label
    FROM want w LEFT JOIN clause c USING (clause_id) LEFT JOIN document d ON d.document_id = c.document_id""",
)
def hydrate_clauses(spark, sf):
    li = A.table(spark, sf, "lineitem")
    w = li.select(F.concat_ws(":", (F.col("l_orderkey") % 1000).cast("string"), F.col("l_linenumber").cast("string")).alias("clause_id")).distinct()
    c = A.clauses(spark, sf).select("clause_id", "document_id", "clause_number", "chapter_title")
    d = A.documents(spark, sf).select("document_id", "code", "title")
    j = w.join(c, "clause_id", "left").join(d, "document_id", "left")
    return j.select("clause_id", "clause_number", "chapter_title", "code", "title", F.coalesce(F.concat(F.lit("Band "), "clause_number"), F.lit("Band -")).alias("label"))


@query(
    "cell_row_table",
    f"""WITH {S.NORM_TABLE}, {S.NORM_ROW}, {S.CELL} SELECT c.row_id, c.col_index, c.text, t.table_number, t.code
    FROM cell c JOIN norm_row r ON r.row_id = c.row_id JOIN norm_table t ON t.table_id = r.table_id""",
)
def cell_row_table(spark, sf):
    c = A.cells(spark, sf).select("row_id", "col_index", "text")
    r = A.rows(spark, sf).select("row_id", "table_id")
    t = A.tables(spark, sf).select("table_id", "table_number", "code")
    return c.join(r, "row_id").join(t, "table_id").select("row_id", "col_index", "text", "table_number", "code")


@query(
    "anchor_filter",
    f"""WITH {S.ITEM}, {S.ITEM_Q}, {P.features_cte('a', 'item_q')},
    k AS (SELECT i.qid, i.item_id, len(f.anchors) = 0 OR {S.kw('f.anchors', S.norm("i.title || ' ' || i.chapter || ' ' || i.snippet"))} > 0
      OR semantic >= 0.82 OR (numeric >= 0.45 AND keyword >= 0.6) AS keep FROM item i JOIN afeat f USING (qid)),
    a AS (SELECT *, bool_or(keep) OVER (PARTITION BY qid) AS any_keep FROM k) SELECT qid, item_id FROM a WHERE keep OR NOT any_keep""",
)
def anchor_filter(spark, sf):
    f = C.question_features(A.item_questions(spark, sf)).select("qid", "anchors")
    return Q.anchor_filter(A.items(spark, sf).join(f, "qid"), F.col("anchors")).select("qid", "item_id")


_KEY = "kind || ':' || coalesce(clause_id, table_id, image_id, title)"


@query(
    "merge_candidates",
    f"""WITH {S.ITEM}, u AS (SELECT *, 1 AS src FROM item WHERE qid % 2 = 0 UNION ALL SELECT * REPLACE (score * 1.05 AS score), 0 FROM item),
    r AS (SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY qid, {_KEY} ORDER BY score DESC, src DESC, item_id DESC) AS rn FROM u)
    SELECT qid, key, item_id, round(score, 6) AS score FROM r WHERE rn = 1""",
)
def merge_candidates(spark, sf):
    it = A.items(spark, sf)
    m = fusion.merge_weighted(it.where("qid % 2 = 0"), it, 1.05)
    return m.select("qid", fusion.merge_key().alias("key"), "item_id", r6(F.col("score")).alias("score"))


def routed(spark, sf, explicit=None):
    """Document routes of the library questions; ``explicit`` codes (qid, code, pos) bypass them."""
    q, c, d = A.questions(spark, sf), A.clauses(spark, sf), A.documents(spark, sf)
    codes = c.select("clause_id", "code")
    lex = lexical.retrieve(q, c, K.ROUTE_DENSE_K).join(codes, "clause_id").select("qid", "code", F.col("clause_id").alias("item_id"), "lexical_score")
    dense = vector.dense_candidates(C.with_vector(q, "question", "qid", "qid"), C.with_vector(c, "text", "clause_id", "id"), K.ROUTE_DENSE_K)
    dense = dense.join(codes, "clause_id").select("qid", "code", F.col("clause_id").alias("item_id"), "dense_score")
    terms = q.select("qid", F.posexplode(X.route_terms(X.normalize_text("question"))).alias("pos", "term"))
    titles = d.select(F.col("document_id").alias("clause_id"), F.col("code").alias("chapter_title"), F.col("title").alias("text"))
    hits = cut_lineage(lexical.term_hits(lexical.clause_tokens(titles), terms))
    g = terms.join(hits, "term").groupBy("qid", "clause_id").agg(
        F.count(F.lit(1)).alias("cov"), F.sum("tf").alias("tf"), F.max(F.col("text_tf") > 0).alias("lead")
    ).where("lead")
    by_title = g.join(d.select(F.col("document_id").alias("clause_id"), "code"), "clause_id")
    by_title = by_title.groupBy("qid", "code").agg(F.max(F.col("cov") * 0.8 + F.least(F.lit(0.6), F.log1p("tf") * 0.3)).alias("doc_score"))
    named = q.select("qid", F.explode(R.doc_codes("question")).alias("code"))
    return Q.route(
        [(Q.doc_scores(dense, "dense_score"), 0.78), (by_title, 0.35), (Q.doc_scores(lex, "lexical_score"), 0.55)], named, explicit
    )


ROUTE_SQL = f"""{P.BASE}, {S.DOCUMENT}, {P.terms_cte('a', 'question')}, {P.lexical_cte('a', 50)}, {P.dense_cte('a', 'question', 50)},
    ds AS (SELECT qid, code, max(s) * 0.72 * 0.78 + avg(s) * 0.28 * 0.78 AS s FROM (SELECT qid, code, score AS s, row_number() OVER (PARTITION BY qid, code ORDER BY score DESC, clause_id) AS r
       FROM adense JOIN clause USING (clause_id) WHERE score > 0) WHERE r <= 3 GROUP BY qid, code),
    ls AS (SELECT qid, code, max(s) * 0.72 * 0.55 + avg(s) * 0.28 * 0.55 AS s FROM (SELECT qid, code, score AS s, row_number() OVER (PARTITION BY qid, code ORDER BY score DESC, clause_id) AS r
       FROM alex JOIN clause USING (clause_id) WHERE score > 0) WHERE r <= 3 GROUP BY qid, code),
    rt AS (SELECT qid, {S.top(S.distinct(S.stems('n')), 8)} AS ts FROM (SELECT qid, {S.norm('question')} AS n FROM question)),
    tt {P.MAT} (SELECT qid, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM rt),
    dh {P.MAT} (SELECT document_id, code, {S.norm("code || ' ' || title")} AS h, {S.norm('title')} AS t FROM document),
    th {P.MAT} (SELECT term, document_id, code, (length(h) - length(replace(h, term, ''))) // length(term) AS tf, contains(t, term) AS in_t
        FROM (SELECT DISTINCT term FROM tt), dh WHERE contains(h, term)),
    ts AS (SELECT qid, code, max(cov * 0.8 + least(0.6, ln(1 + tf) * 0.3)) * 0.35 AS s FROM (SELECT qid, document_id, any_value(code) AS code, count(*) AS cov, sum(tf) AS tf
        FROM tt JOIN th USING (term) GROUP BY qid, document_id HAVING bool_or(in_t)) GROUP BY qid, code),
    tot AS (SELECT qid, code, round(sum(s), 9) AS score FROM (SELECT * FROM ds UNION ALL SELECT * FROM ls UNION ALL SELECT * FROM ts) GROUP BY qid, code),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, code) AS rank, max(score) OVER (PARTITION BY qid) AS top FROM tot)"""
ROUTES = """SELECT qid, code, round(score, 6) AS score, rank, (score >= 0.12 OR score >= greatest(0.12 * 0.92, top - 0.08) OR top < 0.12 * 0.92) AND rank <= 3 AS selected FROM r WHERE rank <= 10"""


@query("doc_route", f"WITH {ROUTE_SQL} {ROUTES}")
def doc_route(spark, sf):
    r = routed(spark, sf).where("rank <= 10")
    return r.select("qid", "code", r6(F.col("score")).alias("score"), "rank", "selected")


_ROUTE = f"""{S.ITEM}, dsc AS (SELECT qid, code, round(max(score) * 0.72 + avg(score) * 0.28, 9) AS score FROM (
   SELECT *, row_number() OVER (PARTITION BY qid, code ORDER BY score DESC, item_id) AS r FROM item WHERE score > 0) WHERE r <= 3 GROUP BY qid, code),
 rts AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, code) AS rank FROM dsc)"""


def item_routes(spark, sf):
    it = A.items(spark, sf)
    none = it.select("qid", "code").limit(0)
    return Q.route([(Q.doc_scores(it, "score"), 1.0)], none)


@query(
    "route_ambiguous",
    f"""WITH {_ROUTE}, g AS (SELECT qid, max(round(score, 5)) FILTER (rank = 1) AS a, max(round(score, 5)) FILTER (rank = 2) AS b FROM rts GROUP BY qid)
    SELECT qid, CASE WHEN b IS NULL THEN false ELSE a - b <= 0.03 OR b / greatest(a, 1e-6) >= 0.9 OR a < 0.22 END AS ambiguous FROM g""",
)
def route_ambiguous(spark, sf):
    return Q.route_ambiguous(item_routes(spark, sf))


_PEN = f"""pen AS (SELECT lower(replace(code, ' ', '')) AS dk, least(0.58, sum(0.12 + least(0.28, (n - 1) * 0.05))) AS penalty FROM (
   SELECT code, answer, count(*) AS n FROM feedback WHERE vote = 'down' GROUP BY code, answer) GROUP BY 1)"""


@query(
    "route_reprioritize",
    f"""WITH {_ROUTE}, {S.FEEDBACK}, {_PEN},
    h AS (SELECT qid, code, rank, round(round(score, 5) * (1 - least(0.75, coalesce(penalty, 0))), 9) AS score FROM rts LEFT JOIN pen ON pen.dk = lower(replace(code, ' ', '')) WHERE rank <= 10)
    SELECT qid, code, round(score, 6) AS score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS new_rank FROM h) WHERE new_rank <= 3""",
)
def route_reprioritize(spark, sf):
    from clausespark.operators import feedback as FB

    down = A.feedback_events(spark, sf).where("vote = 'down'").groupBy("code", "answer").agg(F.count(F.lit(1)).alias("rejected_count"))
    pen = FB.doc_penalties(down).select(F.col("code_key"), "penalty")
    r = Q.reprioritize(item_routes(spark, sf), pen)
    return r.select("qid", "code", r6(F.col("score")).alias("score"), "new_rank")


_BEST = "best AS (SELECT qid, max(score) AS best FROM item WHERE kind = 'clause' GROUP BY qid)"


@query(
    "search_plan",
    f"""WITH {S.ITEM}, {S.ITEM_Q}, {_BEST} SELECT q.qid, m = 0 AS table_search, m = 3 AND coalesce(best, 0) < 0.42 AS soft_probe,
      CASE WHEN m = 0 THEN 8 ELSE 5 END::BIGINT AS row_k, m = 1 AS image_intent, m = 1 OR coalesce(best, 0) < 0.15 AS image_search FROM item_q q LEFT JOIN best USING (qid)""",
)
def search_plan(spark, sf):
    q = item_features(spark, sf)
    best = A.items(spark, sf).where("kind = 'clause'").groupBy("qid").agg(F.max("score").alias("best"))
    j = q.join(best, "qid", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    g = I.gates("question")
    j = j.withColumns({n: g[n] for n in ("table_intent", "row_priority", "clause_lookup", "numeric_requirement")})
    return Q.search_plan(j)


_ORDERED = f"""oi AS (SELECT i.*, q.m, row_number() OVER (PARTITION BY i.qid, kind ORDER BY score DESC, item_id) AS kr,
    max(CASE WHEN kind = 'clause' THEN score END) OVER (PARTITION BY i.qid) AS top FROM item i JOIN item_q q USING (qid)),
 op AS (SELECT *, CASE WHEN m = 0 THEN CASE kind WHEN 'table_row' THEN 0 WHEN 'clause' THEN 1 ELSE 2 END
    WHEN m = 1 THEN CASE kind WHEN 'image' THEN 0 WHEN 'clause' THEN 1 ELSE 2 END
    WHEN top IS NOT NULL THEN CASE WHEN kind = 'clause' THEN 0 WHEN score < greatest(0.15, top - 0.12) THEN NULL
       WHEN kind = 'table_row' AND kr <= 2 THEN 1 WHEN kind = 'image' AND kr <= 1 THEN 2 END
    ELSE CASE kind WHEN 'table_row' THEN 0 ELSE 1 END END AS place FROM oi),
 od AS (SELECT *, row_number() OVER (PARTITION BY qid, {_KEY} ORDER BY place, kr) AS f FROM op WHERE place IS NOT NULL),
 fo AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, kr) AS position FROM od WHERE f = 1),
 ordered AS (SELECT * FROM fo WHERE position <= 10)"""


def list_features(spark, sf):
    """Order questions with the flags that order their lists."""
    q = item_features(spark, sf)
    g = I.gates("question")
    q = q.select("qid", "question", "refs", "intent", g["table_intent"].alias("table_intent"), g["row_priority"].alias("row_priority"), N.is_numeric("question").alias("is_numeric"))
    q = q.withColumn("table_first", (F.col("intent") == "table_lookup") | F.col("table_intent") | F.col("row_priority"))
    return q.withColumn("image_first", F.col("intent") == "image_lookup")


def ordered_items(spark, sf, features=None):
    """Final lists of the order questions; ``features`` are those of ``list_features``, if they are at hand."""
    return Q.final_order(A.items(spark, sf).join(list_features(spark, sf) if features is None else features, "qid"))


@query("final_order", f"WITH {S.ITEM}, {S.ITEM_Q}, {_ORDERED} SELECT qid, item_id, position FROM ordered")
def final_order(spark, sf):
    return ordered_items(spark, sf).select("qid", "item_id", "position")


_CONTEXT = f"""cs0 AS (SELECT *, bool_or(kind = 'table_row') OVER (PARTITION BY qid) AS has_row, bool_or(kind = 'clause') OVER (PARTITION BY qid) AS has_clause,
   row_number() OVER (PARTITION BY qid, kind ORDER BY position) AS kp, row_number() OVER (PARTITION BY qid, kind = 'table_row' ORDER BY position) AS op_,
   row_number() OVER (PARTITION BY qid, kind ORDER BY CASE WHEN m = 3 THEN score + numeric * 0.35 ELSE 0 END DESC, position) AS cr FROM ordered),
 cs1 AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN has_row THEN CASE WHEN kind = 'table_row' THEN kp <= 4 ELSE op_ <= 2 END ELSE position <= 6 END
    WHEN has_clause THEN kind = 'clause' AND cr <= 6 ELSE kind = 'image' AND kp <= 3 END AS sel FROM cs0),
 ctx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN m = 0 AND has_row THEN -score WHEN m = 3 AND kind = 'clause' THEN cr ELSE position END, position) AS context_rank
    FROM cs1 WHERE sel) WHERE context_rank <= 6)"""


@query("context_select", f"WITH {S.ITEM}, {S.ITEM_Q}, {_ORDERED}, {_CONTEXT} SELECT qid, item_id, context_rank FROM ctx")
def context_select(spark, sf):
    return Q.context_select(ordered_items(spark, sf)).select("qid", "item_id", "context_rank")


_PROMPT = f"""WITH {S.ITEM}, {S.ITEM_Q}, {_ORDERED}, {_CONTEXT}, b AS (SELECT qid, context_rank, CASE kind
      WHEN 'clause' THEN 'Manba ' || context_rank || chr(10) || 'Hujjat: ' || code || chr(10) || 'Bob: ' || chapter || chr(10) || 'Band: ' || clause_number || chr(10) || 'Numeric dalil: -' || chr(10) || 'Matn: ' || snippet
      WHEN 'image' THEN 'Manba ' || context_rank || ' (Rasm)' || chr(10) || 'Hujjat: ' || code || chr(10) || 'Bob: ' || chapter || chr(10) || 'Ilova: ' || appendix_number || chr(10) || 'Rasm URL: -' || chr(10) || 'Matn: ' || snippet
      ELSE 'Manba ' || context_rank || ' (Jadval satri)' || chr(10) || 'Hujjat: ' || code || chr(10) || 'Bo''lim: ' || chapter || chr(10) || 'Jadval: ' || table_number || chr(10) || 'Satr: ' || row_index || chr(10) || 'Numeric dalil: -' || chr(10) || 'Matn: ' || snippet END AS block FROM ctx)"""


@query("prompt_context", f"{_PROMPT} SELECT qid, md5(string_agg(block, chr(10) || chr(10) ORDER BY context_rank)) AS context_md5 FROM b GROUP BY qid")
def prompt_context(spark, sf):
    it = Q.context_select(ordered_items(spark, sf)).withColumn("numeric_evidence", F.lit(None).cast("string")).withColumn("image_url", F.lit(None).cast("string"))
    return Q.prompt_context(it).select("qid", F.md5("context").alias("context_md5"))


@query(
    "prompt_examples",
    f"""{_PROMPT}, e AS (SELECT DISTINCT qid, 'Namuna 1' || chr(10) || 'Savol: s' || qid || chr(10) || 'Javob: j' || (qid % 5)
      || CASE WHEN qid % 4 = 0 THEN chr(10) || chr(10) || 'Namuna 2' || chr(10) || 'Savol: t' || chr(10) || 'Javob: u' ELSE '' END AS x FROM item WHERE qid % 2 = 0),
    c AS (SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY context_rank) AS c FROM b GROUP BY qid)
    SELECT qid, md5(c || coalesce(chr(10) || chr(10) || 'Javob uslubi namunalari:' || chr(10) || x, '')) AS context_md5 FROM c LEFT JOIN e USING (qid)""",
)
def prompt_examples(spark, sf):
    """Contexts followed by one or two style examples, or none."""
    it = Q.context_select(ordered_items(spark, sf)).withColumn("numeric_evidence", F.lit(None).cast("string")).withColumn("image_url", F.lit(None).cast("string"))
    k = F.col("qid").cast("string")
    pair = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    one = pair(F.concat(F.lit("s"), k), F.concat(F.lit("j"), (F.col("qid") % 5).cast("string")))
    ex = A.items(spark, sf).where("qid % 2 = 0").select("qid").distinct()
    ex = ex.select("qid", F.when(F.col("qid") % 4 == 0, F.array(one, pair(F.lit("t"), F.lit("u")))).otherwise(F.array(one)).alias("examples"))
    return Q.prompt_context(it, ex).select("qid", F.md5("context").alias("context_md5"))


@query(
    "confidence",
    f"""WITH {S.ITEM}, {S.ITEM_Q}, {_ORDERED},
    g AS (SELECT q.qid, any_value(q.m) AS m, max(score) FILTER (position = 1) AS s1, max(score) FILTER (position = 2) AS s2, max(lower(code)) FILTER (position = 1) AS d1,
      max(lower(code)) FILTER (position = 2) AS d2, max(semantic) FILTER (position = 1) AS sem, max(keyword) FILTER (position = 1) AS kw, max(numeric) AS num,
      bool_or(position <= 5 AND q.m = 2 AND coalesce(clause_number, '') = (1 + q.qid % 3) || '.' || (q.qid % 4)) AS exact FROM item_q q LEFT JOIN ordered o USING (qid) GROUP BY q.qid),
    s AS (SELECT *, greatest(s1, sem, kw, num) AS signal, coalesce(d1 <> d2 AND abs(s1 - s2) <= 0.03 AND s2 >= 0.15, false) AS conflict FROM g),
    r AS (SELECT *, CASE WHEN s1 IS NULL THEN 'no_retrieval_items' WHEN conflict AND sem < 0.15 AND num < 0.05 THEN 'conflicting_low_semantic_evidence'
      WHEN m = 2 AND NOT coalesce(exact, false) THEN 'exact_clause_not_found' WHEN signal >= 0.24 THEN 'signal_above_strict_threshold'
      WHEN signal >= 0.15 THEN 'signal_above_min_threshold' ELSE 'signal_below_min_threshold' END AS reason FROM s)
    SELECT qid, CASE WHEN s1 IS NULL THEN 0 ELSE signal END::DOUBLE AS score, CASE reason WHEN 'signal_above_strict_threshold' THEN 'high' WHEN 'signal_above_min_threshold' THEN 'medium' ELSE 'low' END AS label,
      reason NOT LIKE 'signal_above%' AS no_answer, reason, conflict FROM r""",
)
def confidence(spark, sf):
    # written, as the lists and the questions both need them
    q = cut_lineage(list_features(spark, sf).select("qid", "intent", F.col("refs.clause_numbers").alias("clause_numbers"), "table_first", "image_first"))
    lists = ordered_items(spark, sf, q.select("qid", "table_first", "image_first")).select("qid", "position", "score", "semantic", "keyword", "numeric", "code", "clause_number")
    return Q.confidence(lists, q.select("qid", "intent", "clause_numbers"))


_CLIST = "cl AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM item WHERE kind = 'clause')"
_ANSWER = f"""ab AS (SELECT *, max(score) FILTER (rank = 1) OVER (PARTITION BY qid) AS best, max(code) FILTER (rank = 1) OVER (PARTITION BY qid) AS c1 FROM cl),
 ag AS (SELECT qid, max(best) AS best, count(*) AS n, max(score) FILTER (rank = 2) AS second, max(greatest(semantic, keyword)) FILTER (rank = 1) AS sig1,
   max(greatest(semantic, keyword)) FILTER (rank = 2) AS sig2, max(keyword) FILTER (rank = 1) AS kw1, max(semantic) FILTER (rank = 1) AS sem1, max(numeric) FILTER (rank = 1) AS num1,
   least(6, count(DISTINCT lower(code)) FILTER (score >= greatest(0.12, best - 0.03))) AS docs,
   count(DISTINCT lower(code)) FILTER (score >= greatest(0.12, best - 0.03) AND rank <= 5 AND greatest(semantic, keyword) >= 0.24) AS strong,
   count(*) FILTER (rank <= 5 AND code = c1) / count(*) FILTER (rank <= 5) AS ratio FROM ab GROUP BY qid),
 answerable AS (SELECT qid, best, coalesce(n >= 2 AND docs > 1 AND best - second <= 0.03 AND sig1 >= 0.22 AND sig2 >= 0.22 AND (best >= 0.24 OR strong >= 2), false) AS ask_document,
   docs::BIGINT AS n_docs, best >= 0.24 OR (best >= greatest(0.15, 0.24 - 0.03) AND ratio >= 0.8 AND kw1 >= 0.3) AS relaxed, sem1 < 0.02 AND kw1 < 0.22 AND num1 < 0.14 AS weak_clause FROM ag)"""


@query("answerability", f"WITH {S.ITEM}, {_CLIST}, {_ANSWER} SELECT qid, ask_document, n_docs, relaxed, weak_clause FROM answerable")
def answerability(spark, sf):
    return Q.answerability(Q.ranked(A.items(spark, sf).where("kind = 'clause'")))


_RESCUE = """nm0 AS (SELECT i.qid, item_id, i.score, snippet, 0.12 + 0.12 + 0.04 + 0.06 + 0.08 AS num FROM item i JOIN item_q q USING (qid)
   WHERE q.m = 3 AND kind IN ('clause', 'table_row')),
 resc AS (SELECT qid, item_id, round(score + num * 0.35, 9) AS signal, regexp_extract(snippet, '(\\d+ mm)', 1) AS evidence FROM nm0),
 rescue AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY signal DESC, item_id) AS r FROM resc WHERE signal > 0) WHERE r = 1)"""


@query("numeric_rescue", f"WITH {S.ITEM}, {S.ITEM_Q}, {_RESCUE} SELECT qid, item_id, round(signal, 6) AS signal, evidence FROM rescue")
def numeric_rescue(spark, sf):
    q = A.item_questions(spark, sf).select("qid", N.query_profile("question").alias("profile"))
    r = Q.numeric_rescue(A.items(spark, sf).join(q, "qid"))
    return r.select("qid", "item_id", r6(F.col("signal")).alias("signal"), "evidence")


_EXACT = f"""exq AS (SELECT * FROM (SELECT i.qid, item_id, code, clause_number, score, row_number() OVER (PARTITION BY i.qid ORDER BY score DESC, item_id) AS r
   FROM item i JOIN item_q q USING (qid) WHERE kind = 'clause' AND m = 2 AND clause_number = {_M_NUMBER.replace('qid', 'q.qid')}) WHERE r = 1)"""


@query("exact_pick", f"WITH {S.ITEM}, {S.ITEM_Q}, {_EXACT} SELECT qid, item_id, code, clause_number, score FROM exq")
def exact_pick(spark, sf):
    q = item_features(spark, sf).select("qid", "refs")
    return Q.exact_pick(A.items(spark, sf).join(q, "qid"))


@query(
    "mixed_rerank",
    f"""WITH {S.ITEM}, {S.ITEM_Q}, st AS (SELECT qid, m, question, list_distinct({S.stems(S.fold('question'))}) AS ts FROM item_q),
    s AS (SELECT i.qid, i.item_id, len(list_filter(ts, lambda t: contains(lower(snippet), t))) AS o, len(ts) AS n, i.*EXCLUDE(qid, item_id), m FROM item i JOIN st USING (qid)),
    x AS (SELECT qid, item_id, round(score + o / greatest(n, 1) * 0.17 + semantic * 0.06 + keyword * 0.08
      + CASE WHEN m = 3 AND kind IN ('clause', 'table_row') THEN 0.42 * 0.2 ELSE 0 END
      + CASE WHEN m = 0 AND kind = 'table_row' THEN 0.22 WHEN m = 1 AND kind = 'image' THEN 0.25 WHEN m = 2 AND kind = 'clause' THEN 0.2 ELSE 0 END
      + CASE WHEN m = 2 AND clause_number = {_M_NUMBER} THEN 0.35 ELSE 0 END + CASE WHEN m = 0 AND table_number = '3' THEN 0.4 ELSE 0 END
      + least(0.04, ln(1 + o) * 0.015), 9) AS score FROM s) SELECT qid, item_id, round(score, 6) AS score FROM x""",
)
def mixed_rerank(spark, sf):
    it = A.items(spark, sf).join(rerank.with_question_features(item_features(spark, sf)), "qid")
    return rerank.mixed_scores(it).select("qid", "item_id", r6(F.col("score")).alias("score"))


@query("mixed_suppress")
def mixed_suppress(spark, sf):
    """Kept items and removal counts of the mixed rerank (its walk is property-tested)."""
    return rerank.rerank_mixed(ordered_items(spark, sf)).select("qid", "item_id", "final_rank", "removed")


@query(
    "source_records",
    f"""WITH {S.ITEM} SELECT qid, item_id, kind AS type, code AS shnq_code, left(snippet, 280) AS snippet, round_even(score, 4) AS score, round_even(semantic, 4) AS semantic_score,
      round_even(keyword, 4) AS keyword_score, round_even(numeric, 4) AS numeric_score, CASE WHEN kind <> 'clause' THEN title END AS title,
      code || CASE WHEN l_has THEN '|QMQ 1.02-97' ELSE '' END AS codes FROM (SELECT *, contains(snippet, ' 7 mm') AS l_has FROM item)""",
)
def source_records(spark, sf):
    it = A.items(spark, sf)
    mention = F.concat(F.col("snippet"), F.when(F.contains("snippet", F.lit(" 7 mm")), " QMQ  1.02-97").otherwise(""))
    codes = X.ci_distinct(F.concat(R.doc_codes("code"), R.doc_codes(mention)))
    s = it.select("qid", "item_id", Q.source_record().alias("s"), bar(codes).alias("codes"))
    return s.select("qid", "item_id", *[F.col(f"s.{c}").alias(c) for c in ("type", "shnq_code", "snippet", "score", "semantic_score", "keyword_score", "numeric_score", "title")], "codes")


@query(
    "slowest_stage",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN greatest(l_quantity, l_discount * 300, l_tax * 500) <= 0 THEN NULL
      WHEN round_even(l_quantity, 2) >= round_even(l_discount * 300, 2) AND round_even(l_quantity, 2) >= round_even(l_tax * 500, 2) THEN 'detect'
      WHEN round_even(l_discount * 300, 2) >= round_even(l_tax * 500, 2) THEN 'embed' ELSE 'rag_generate' END AS slowest FROM lineitem""",
)
def slowest_stage(spark, sf):
    li = A.table(spark, sf, "lineitem")
    stages = F.array(*[F.struct(F.bround(c, 2).alias("ms"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(
        [("detect", F.col("l_quantity")), ("embed", F.col("l_discount") * 300), ("rag_generate", F.col("l_tax") * 500)]
    )])
    best = F.array_max(F.filter(stages, lambda s: s["ms"] > 0))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", best["n"].alias("slowest"))


# ------------------------------------------------------------------ tables
def table_questions(spark, sf):
    """Questions about tables, one per part."""
    p = A.table(spark, sf, "part")
    num = F.regexp_extract("p_brand", r"(\d+)", 1)
    k = F.col("p_partkey") % 3
    text = (
        F.when(k == 0, F.concat(num, F.lit("-jadval "), num, F.lit("-bob materiallar")))
        .when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit("-jadval haqida")))
        .otherwise(F.concat(A.code_of(num.cast("bigint")), F.lit(" bo'yicha "), num, F.lit("-jadval "), F.col("p_name")))
    )
    q = p.select(F.col("p_partkey").alias("qid"), text.alias("question")).withColumn("n", X.normalize_text("question"))
    q = q.withColumn("number", R.first_table_number(F.col("n"))).withColumn("doc", F.coalesce(F.get(R.doc_codes("n"), F.lit(0)), F.lit("")))
    terms = F.filter(X.query_terms("n"), lambda t: ~t.isin(list(K.TABLE_GENERIC_TERMS)))
    return q.select("qid", "question", "number", R.code_key("doc").alias("doc_key"), terms.alias("terms"), Q.context_words(F.col("question"), F.col("doc")).alias("context"))


def two_tables(spark, sf):
    """Brand tables and a second table of the same number in the next document."""
    t = A.tables(spark, sf).withColumn("body", F.concat(F.lit("| "), "title", F.lit(" |")))
    u = t.select(
        F.concat("table_id", F.lit("b")).alias("table_id"), (F.col("document_id") + 1).alias("document_id"), A.code_of(F.col("document_id") + 1).alias("code"), "table_number",
        F.lit("Qo'shimcha").alias("title"), F.lit("umumiy qoidalar").alias("section_title"), (F.col("table_order") + 100).alias("table_order"), F.lit("-").alias("body"),
    )
    return t.select(u.columns).unionByName(u)


@query(
    "table_pick",
    """WITH b AS (SELECT DISTINCT p_brand, regexp_extract(p_brand, '(\\d+)', 1) AS num FROM part)
    SELECT p_partkey AS qid, CASE p_partkey % 3 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS n_candidates,
      CASE p_partkey % 3 WHEN 1 THEN NULL ELSE 'Brand#' || CASE p_partkey % 3 WHEN 1 THEN p_size::VARCHAR ELSE regexp_extract(p_brand, '(\\d+)', 1) END END AS table_id
    FROM part WHERE p_partkey % 3 <> 1 OR p_size::VARCHAR IN (SELECT num FROM b)""",
)
def table_pick(spark, sf):
    return Q.table_pick(table_questions(spark, sf), two_tables(spark, sf))


@query(
    "table_options",
    f"""WITH {S.NORM_TABLE}, o AS (SELECT code, table_order, table_number || '-jadval - ' || title AS label FROM norm_table UNION ALL
      SELECT {S.code('(document_id + 1)')}, table_order + 100, table_number || '-jadval - Qo''shimcha' FROM norm_table)
    SELECT code, label, position FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY table_order) AS position FROM o) WHERE position <= 12""",
)
def table_options(spark, sf):
    t = two_tables(spark, sf)
    ref = R.table_label("table_number")
    key = F.concat_ws("|", F.lower(ref), F.lower(F.trim("section_title")), F.lower(F.trim("title")))
    o = Q.first_distinct(t, "code", key, ["table_order", "table_id"], 12)
    tail = F.when(F.trim("title") != "", F.trim("title")).otherwise(F.trim("section_title"))
    return o.select("code", F.when(tail != "", F.concat(ref, F.lit(" - "), tail)).otherwise(ref).alias("label"), "position")


_SIZED = f"""sized AS (SELECT min(p_partkey) AS table_id, p_size::VARCHAR AS number, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS num,
  CASE WHEN min(p_partkey) % 2 = 0 THEN {S.code("regexp_extract(p_brand, '(\\d+)', 1)::BIGINT")} ELSE lower({S.code("regexp_extract(p_brand, '(\\d+)', 1)::BIGINT")}) END AS code,
  CASE WHEN min(p_partkey) % 5 > 0 THEN p_type END AS section FROM part GROUP BY p_size, p_brand, p_type)"""


@query(
    "table_choices",
    f"""WITH {_SIZED}, o AS (SELECT number, 'document' AS kind, code AS label, lower(code) AS key, num, table_id FROM sized
      UNION ALL SELECT number, 'chapter', coalesce(section, 'Noma''lum bob'), lower(coalesce(section, 'Noma''lum bob')), num, table_id FROM sized),
    f AS (SELECT number, kind, arg_min(label, (num, table_id)) AS label, min((num, table_id)) AS place FROM o GROUP BY number, kind, key)
    SELECT number AS number_key, kind, label, position FROM (SELECT *, row_number() OVER (PARTITION BY number, kind ORDER BY place) AS position FROM f)
    WHERE position <= CASE kind WHEN 'document' THEN 7 ELSE 6 END""",
)
def table_choices(spark, sf):
    """Tables numbered by size: one per size, brand and type."""
    num = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
    p = A.table(spark, sf, "part").groupBy("p_size", "p_type", num.alias("table_order")).agg(F.min("p_partkey").alias("table_id"))
    code = A.code_of(F.col("table_order"))
    t = p.select(
        "table_id", "table_order", F.col("p_size").cast("string").alias("table_number"), F.when(F.col("table_id") % 2 == 0, code).otherwise(F.lower(code)).alias("code"),
        F.when(F.col("table_id") % 5 > 0, F.col("p_type")).alias("section_title"),
    )
    return Q.table_choices(t).select("number_key", "kind", "label", "position")


# -------------------------------------------------------------- disposition
@query(
    "disposition",
    f"""WITH {S.ITEM}, {S.ITEM_Q}, {_ORDERED}, {_CLIST}, {_ANSWER}, {_RESCUE}, {_EXACT},
    have AS (SELECT qid, bool_or(kind = 'clause') AS c, bool_or(kind = 'table_row') AS r, bool_or(kind = 'image') AS i FROM item GROUP BY qid),
    top AS (SELECT q.qid, max(score) FILTER (position = 1) AS s1, max(greatest(score, semantic, keyword)) FILTER (position = 1) AS sg, max(numeric) AS num,
       bool_or(position <= 5 AND coalesce(clause_number, '') = (1 + q.qid % 3) || '.' || (q.qid % 4)) AS exact,
       max(score) FILTER (position = 2) AS s2, max(code) FILTER (position = 1) AS c1, max(code) FILTER (position = 2) AS c2, max(semantic) FILTER (position = 1) AS sem
       FROM item_q q LEFT JOIN ordered o USING (qid) GROUP BY q.qid),
    x AS (SELECT q.qid, q.m, coalesce(h.c, false) AS c, coalesce(h.r, false) AS r, coalesce(h.i, false) AS i, coalesce(a.weak_clause, false) AS weak, coalesce(a.relaxed, false) AS relaxed,
       coalesce(a.best, 0) AS best, e.qid IS NOT NULL AND e.score >= 0.15 AS exact_found, s.qid IS NOT NULL AS rescue,
       t.s1 IS NULL OR (t.c1 <> t.c2 AND abs(t.s1 - t.s2) <= 0.03 AND t.s2 >= 0.15 AND t.sem < 0.15 AND t.num < 0.05) OR (q.m = 2 AND NOT coalesce(t.exact, false)) OR greatest(t.sg, t.num) < 0.15 AS no_answer
       FROM item_q q LEFT JOIN have h USING (qid) LEFT JOIN answerable a USING (qid) LEFT JOIN exq e USING (qid) LEFT JOIN rescue s USING (qid) LEFT JOIN top t USING (qid)),
    w AS (SELECT *, CASE WHEN rescue THEN 'rag_rescue' END AS wk FROM x)
    SELECT qid, CASE WHEN m = 5 THEN 'greeting' WHEN m = 0 THEN CASE WHEN qid % 5 = 0 THEN 'table_lookup' WHEN qid % 5 = 1 THEN 'clarification' ELSE 'no_match' END
      WHEN m <> 2 AND qid % 7 = 0 THEN 'verified_cache' WHEN m = 2 AND exact_found THEN 'rag_direct'
      WHEN c AND NOT r AND NOT i AND weak THEN coalesce(wk, 'no_match')
      WHEN best < 0.24 AND NOT (relaxed OR r OR i) THEN coalesce(wk, CASE WHEN m = 3 THEN 'clarification' END, 'no_match')
      WHEN coalesce(no_answer, false) AND NOT (r OR i) AND NOT relaxed THEN coalesce(wk, 'no_match') ELSE 'rag' END AS disposition FROM w""",
)
def disposition(spark, sf):
    q = item_features(spark, sf)
    q = q.withColumns(I.gates("question"))
    it = A.items(spark, sf)
    k = lambda n: F.max(F.col("kind") == n)
    have = it.groupBy("qid").agg(k("clause").alias("has_clause"), k("table_row").alias("has_row"), k("image").alias("has_image"), F.max(F.when(F.col("kind") == "clause", F.col("score"))).alias("best"))
    ans = Q.answerability(Q.ranked(it.where("kind = 'clause'"))).select("qid", "relaxed", "weak_clause")
    lists = ordered_items(spark, sf).select("qid", "position", "score", "semantic", "keyword", "numeric", "code", "clause_number")
    conf = Q.confidence(lists, q.select("qid", "intent", F.col("refs.clause_numbers").alias("clause_numbers"))).select("qid", "no_answer")
    exact = Q.exact_pick(it.join(q.select("qid", "refs"), "qid")).where(F.col("score") >= max(K.MIN_SCORE, 0.12)).select("qid", F.lit(True).alias("exact_found"))
    prof = A.item_questions(spark, sf).select("qid", N.query_profile("question").alias("profile"))
    rescue = Q.numeric_rescue(it.join(prof, "qid")).select("qid", F.lit(True).alias("has_rescue"))
    j = q
    for df in (have, ans, conf, exact, rescue):
        j = j.join(df, "qid", "left")
    flags = ("has_clause", "has_row", "has_image", "relaxed", "weak_clause", "no_answer", "exact_found", "has_rescue")
    j = j.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}).withColumn("best", F.coalesce("best", F.lit(0.0)))
    n = F.col("qid")
    j = j.withColumns(
        {
            "filters_active": F.lit(False), "filter_empty": F.lit(False), "table_found": n % 5 == 0, "table_ambiguous": n % 5 == 1,
            "cache_hit": n % 7 == 0, "has_explicit": F.col("refs.has_explicit"), "doc_requested": F.size("refs.document_codes") > 0,
            "n_clause_refs": F.size("refs.clause_numbers"),
        }
    )
    return Q.disposition(j)
