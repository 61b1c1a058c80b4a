"""Queries over the taxonomy, pipeline status, listings and draft curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.operators import catalog as G
from clausespark.operators import curate as U
from clausespark.plans import sql as S
from clausespark.plans.registry import query
from clausespark.sources import adapters as A

big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)


@query(
    "filter_tree",
    """WITH c AS (SELECT n_nationkey, n_regionkey, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS nd FROM nation)
    SELECT r_name AS section, n_name AS category, s_name AS document, (SELECT count(*) FROM c x WHERE x.n_regionkey = r_regionkey) AS section_categories,
      (SELECT coalesce(sum(nd), 0) FROM c x WHERE x.n_regionkey = r_regionkey)::BIGINT AS section_documents, coalesce(nd, 0) AS category_documents
    FROM region LEFT JOIN c ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey""",
)
def filter_tree(spark, sf):
    t = G.filter_tree(*taxonomy(spark, sf)).orderBy("section", "category", "document")
    return t.select("section", "category", "document", "section_categories", "section_documents", "category_documents")


def taxonomy(spark, sf):
    r = A.table(spark, sf, "region").select(F.col("r_regionkey").alias("section_id"), F.col("r_name").alias("section"))
    n = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_regionkey").alias("section_id"), F.col("n_name").alias("category"))
    d = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_nationkey").alias("category_id"), F.col("s_name").alias("document"))
    return r, n, d


@query(
    "child_counts",
    """SELECT n_name AS category, count(s_suppkey) AS children, count(s_suppkey) = 0 AS removable FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def child_counts(spark, sf):
    _, n, d = taxonomy(spark, sf)
    c = d.groupBy("category_id").agg(F.count(F.lit(1)).alias("children"))
    j = n.join(c, "category_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return j.select("category", "children", (F.col("children") == 0).alias("removable"))


@query(
    "catalog_rollups",
    f"""WITH {S.PROCESS}, d AS (SELECT count(*) AS t, count(*) FILTER (status = 'processing') AS p, count(*) FILTER (status IN ('processing', 'queued')) AS k, count(*) FILTER (status = 'done') AS dn FROM process)
    SELECT r_name AS section, count(*) AS categories, max(p) AS processing, max(k) AS stuck, max(CASE WHEN t > 0 THEN floor(dn / t * 100 + 0.5) ELSE 0 END)::BIGINT AS success_rate
    FROM region JOIN nation ON n_regionkey = r_regionkey, d GROUP BY r_name""",
)
def catalog_rollups(spark, sf):
    r, n, _ = taxonomy(spark, sf)
    c = n.groupBy("section_id").agg(F.count(F.lit(1)).alias("categories"))
    status = F.col("status")
    cnt = lambda *s: F.count(F.when(status.isin(*s), 1))
    p = A.doc_processes(spark, sf).agg(F.count(F.lit(1)).alias("total"), cnt("done").alias("done"), cnt("processing").alias("processing"), cnt("processing", "queued").alias("stuck"))
    rate = F.when(F.col("total") > 0, F.floor(F.col("done") / F.col("total") * 100 + 0.5)).otherwise(0)
    # one row of totals beside every section
    return r.join(c, "section_id").withColumn("_all", F.lit(0)).join(p.withColumn("_all", F.lit(0)), "_all").select("section", "categories", "processing", "stuck", big(rate).alias("success_rate"))


@query(
    "doc_counts",
    f"""WITH {S.CLAUSE}, {S.DOCUMENT}, {S.NORM_TABLE} SELECT d.document_id, (SELECT count(*) FROM clause c WHERE c.document_id = d.document_id) AS clauses,
      (SELECT count(*) FROM norm_table t WHERE t.document_id = d.document_id) AS tables, (SELECT count(*) FROM labels l WHERE l.doc_id = d.document_id AND quality = 1) AS approved FROM document d""",
)
def doc_counts(spark, sf):
    d = A.documents(spark, sf).select("document_id")
    n = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    l = A.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    j = d
    for df, name in ((A.clauses(spark, sf), "clauses"), (A.tables(spark, sf), "tables"), (l, "approved")):
        j = j.join(n(df, name), "document_id", "left")
    return j.select("document_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("clauses", "tables", "approved")])


_EFF = "CASE WHEN status = 'processing' AND doc_html = 100 AND chunking = 100 AND row_embedding = 100 AND img_embedding = 100 THEN 'done' ELSE status END"


@query(
    "dashboard",
    f"""WITH {S.PROCESS}, {S.CLAUSE}, {S.NORM_TABLE}, e AS (SELECT {_EFF} AS s FROM process), n AS (SELECT (SELECT count(*) FROM lineitem) AS docs, (SELECT count(*) FROM process) AS np)
    SELECT count(*) FILTER (s = 'queued') + greatest(max(docs) - max(np), 0) AS queued, count(*) FILTER (s = 'processing') AS processing, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'failed') AS failed,
      max(docs) AS documents, (SELECT count(*) FROM clause) AS clauses, (SELECT count(*) FROM norm_table) AS tables, (SELECT count(*) FROM part) AS table_rows, (SELECT count(*) FROM part WHERE p_size % 2 = 0) AS row_embeddings,
      greatest(0, least(100, round_even((SELECT count(*) FROM part WHERE p_size % 2 = 0) / (SELECT count(*) FROM part) * 100, 0)))::BIGINT AS coverage FROM e, n""",
)
def dashboard(spark, sf):
    p = A.table(spark, sf, "part")
    totals = {"clauses": A.clauses(spark, sf), "tables": A.tables(spark, sf), "table_rows": p, "row_embeddings": p.where("p_size % 2 = 0")}
    return G.dashboard(A.table(spark, sf, "lineitem"), A.doc_processes(spark, sf), totals)


@query(
    "doc_status",
    f"""WITH {S.PROCESS}, {S.DOCUMENT} SELECT d.document_id, d.code, coalesce({_EFF}, 'queued') AS status, coalesce(doc_html, 0) AS doc_html FROM document d LEFT JOIN process p USING (document_id)""",
)
def doc_status(spark, sf):
    j = A.documents(spark, sf).select("document_id", "code").join(A.doc_processes(spark, sf), "document_id", "left")
    return j.select("document_id", "code", G.effective_status().alias("status"), F.coalesce("doc_html", F.lit(0)).alias("doc_html"))


@query(
    "status_sorted_docs",
    f"""WITH {S.PROCESS} SELECT document_id, status, {S.code('document_id')} AS code, row_number() OVER (ORDER BY CASE status WHEN 'processing' THEN 0 WHEN 'queued' THEN 1 ELSE 99 END, {S.code('document_id')}, document_id) AS position
    FROM process""",
)
def status_sorted_docs(spark, sf):
    p = A.doc_processes(spark, sf).select("document_id", "status").withColumn("code", A.code_of(F.col("document_id")))
    return G.status_sorted(p, {"processing": 0, "queued": 1})


@query(
    "process_snapshot",
    """WITH e AS (SELECT l_orderkey AS document_id, (l_linenumber::BIGINT * 1000000 + l_partkey) * 1000 + l_suppkey AS seq, CASE WHEN l_returnflag = 'A' THEN 'processing' WHEN l_returnflag = 'N' THEN 'queued' ELSE 'done' END AS status,
      'stage' || (l_linenumber % 4) AS stage, (l_quantity * 3 - 10)::BIGINT AS p FROM lineitem)
    SELECT document_id, arg_max(status, seq) AS status, arg_max(stage, seq) AS stage, greatest(0, least(100, max(p))) AS doc_html, greatest(0, least(100, max(p // 2))) AS chunking FROM e GROUP BY document_id""",
)
def process_snapshot(spark, sf):
    li = A.table(spark, sf, "lineitem")
    p = (F.col("l_quantity") * 3 - 10).cast("bigint")
    half = F.floor(p / 2)
    status = F.when(F.col("l_returnflag") == "A", "processing").when(F.col("l_returnflag") == "N", "queued").otherwise("done")
    e = li.select(
        F.col("l_orderkey").alias("document_id"), ((F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("seq"), status.alias("status"),
        F.concat(F.lit("stage"), (F.col("l_linenumber") % 4).cast("string")).alias("stage"), p.alias("doc_html"), half.alias("chunking"), p.alias("row_embedding"), half.alias("img_embedding"),
    )
    return G.status_snapshot(e).select("document_id", "status", "stage", big(F.col("doc_html")).alias("doc_html"), big(F.col("chunking")).alias("chunking"))


@query("missing_process", f"WITH {S.PROCESS} SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT document_id FROM process WHERE document_id % 3 <> 0)")
def missing_process(spark, sf):
    return A.documents(spark, sf).select("document_id").join(A.doc_processes(spark, sf).where("document_id % 3 <> 0"), "document_id", "left_anti")


@query("stale_docs", f"WITH {S.PROCESS} SELECT document_id, updated_at FROM process WHERE status = 'processing' AND updated_at < TIMESTAMP '1998-06-01 00:10:00' - INTERVAL 15 MINUTE")
def stale_docs(spark, sf):
    return G.stale(A.doc_processes(spark, sf), F.lit("1998-06-01 00:10:00").cast("timestamp")).select("document_id", "updated_at")


@query("oldest_queued", f"WITH {S.PROCESS} SELECT document_id, updated_at FROM process WHERE status = 'queued' ORDER BY updated_at, document_id LIMIT 32")
def oldest_queued(spark, sf):
    return A.doc_processes(spark, sf).where("status = 'queued'").orderBy("updated_at", "document_id").limit(32).select("document_id", "updated_at")


@query(
    "reprocess_set",
    f"""WITH {S.PROCESS}, {S.DOCUMENT} SELECT d.document_id FROM document d LEFT JOIN process p USING (document_id) WHERE coalesce({_EFF}, 'queued') IN ('queued', 'processing')""",
)
def reprocess_set(spark, sf):
    """Documents to run again, by their effective status."""
    j = A.documents(spark, sf).select("document_id").join(A.doc_processes(spark, sf), "document_id", "left")
    return j.where(G.effective_status().isin("queued", "processing")).select("document_id")


@query(
    "changed_processes",
    f"""WITH {S.PROCESS}, o AS (SELECT document_id, status, doc_html FROM process WHERE document_id % 5 <> 1),
    n AS (SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN document_id % 7 = 0 THEN 0 ELSE doc_html END::BIGINT AS doc_html FROM process)
    SELECT * FROM n EXCEPT SELECT * FROM o""",
)
def changed_processes(spark, sf):
    """Snapshot rows that a listener has not seen yet."""
    p = A.doc_processes(spark, sf).select("document_id", "status", "doc_html")
    k = F.col("document_id")
    new = p.withColumns({"status": F.when(k % 3 == 0, "failed").otherwise(F.col("status")), "doc_html": F.when(k % 7 == 0, 0).otherwise(F.col("doc_html"))})
    return G.changed(p.where("document_id % 5 <> 1"), new).select("document_id", "status", big(F.col("doc_html")).alias("doc_html"))


@query(
    "documents_listing",
    f"""WITH {S.DOCUMENT} SELECT document_id, code, title, section_code, category_code, position FROM (
      SELECT *, row_number() OVER (PARTITION BY section_code, category_code ORDER BY code, document_id) AS position FROM document) WHERE position BETWEEN 3 AND 7""",
)
def documents_listing(spark, sf):
    """The second page of five documents of every category, by code."""
    return G.listing(A.documents(spark, sf), ["section_code", "category_code"], ["code", "document_id"], offset=2, size=5).select(
        "document_id", "code", "title", "section_code", "category_code", big(F.col("position")).alias("position"))


# --------------------------------------------------------------- inventories
_INV = f"""{S.CLAUSE}, inv AS (SELECT 0 AS kind_order, 'clause' AS kind, document_id, clause_order AS seq, clause_id AS id, 'Band ' || clause_number AS name, len(string_split(text, ' ')) AS token_count,
    CASE WHEN length(text) > 220 THEN left(text, 217) || '...' ELSE text END AS preview FROM clause
  UNION ALL SELECT 1, 'table_row', regexp_extract(p_brand, '(\\d+)', 1)::BIGINT, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT * 100000 + p_partkey, p_partkey::VARCHAR, 'Jadval ' || regexp_extract(p_brand, '(\\d+)', 1) || ' (qator ' || p_partkey || ')',
    len(string_split(p_name, ' ')), p_name FROM part
  UNION ALL SELECT 2, 'image', page_id, page_id, page_id::VARCHAR, 'Rasm ' || page_id, 1, CASE WHEN length(url) > 220 THEN left(url, 217) || '...' ELSE url END FROM pages)"""


def inventory(spark, sf):
    """Clauses, table rows and images of all documents in one schema."""
    c = A.clauses(spark, sf).select(
        F.lit(0).alias("kind_order"), F.lit("clause").alias("kind"), "document_id", F.col("clause_order").alias("seq"), F.col("clause_id").alias("id"),
        F.concat(F.lit("Band "), "clause_number").alias("name"), big(F.size(F.split("text", " "))).alias("token_count"), X.preview("text", 220).alias("preview"),
    )
    p = A.table(spark, sf, "part")
    num = F.regexp_extract("p_brand", r"(\d+)", 1)
    r = p.select(
        F.lit(1).alias("kind_order"), F.lit("table_row").alias("kind"), num.cast("bigint").alias("document_id"), (num.cast("bigint") * 100000 + F.col("p_partkey")).alias("seq"), F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.lit("Jadval "), num, F.lit(" (qator "), F.col("p_partkey").cast("string"), F.lit(")")).alias("name"), big(F.size(F.split("p_name", " "))).alias("token_count"), X.preview("p_name", 220).alias("preview"),
    )
    g = A.table(spark, sf, "pages").select(
        F.lit(2).alias("kind_order"), F.lit("image").alias("kind"), F.col("page_id").alias("document_id"), F.col("page_id").alias("seq"), F.col("page_id").cast("string").alias("id"),
        F.concat(F.lit("Rasm "), F.col("page_id").cast("string")).alias("name"), F.lit(1).cast("bigint").alias("token_count"), X.preview("url", 220).alias("preview"),
    )
    return c.unionByName(r).unionByName(g)


@query("embedding_page", f"WITH {_INV} SELECT document_id, kind, seq, id, name, token_count::BIGINT AS token_count, preview FROM inv ORDER BY kind_order, seq, id LIMIT 1000 OFFSET 500")
def embedding_page(spark, sf):
    return G.page(inventory(spark, sf), 500, 1000).select("document_id", "kind", "seq", "id", "name", "token_count", "preview")


@query("embedding_summary", f"WITH {_INV} SELECT document_id, count(*) FILTER (kind = 'clause') AS clause, count(*) FILTER (kind = 'table_row') AS table_row, count(*) FILTER (kind = 'image') AS image, count(*) AS total FROM inv GROUP BY document_id")
def embedding_summary(spark, sf):
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    return inventory(spark, sf).groupBy("document_id").agg(n("clause"), n("table_row"), n("image"), F.count(F.lit(1)).alias("total"))


@query(
    "taxonomy_import",
    """WITH r AS (SELECT s_suppkey, upper(trim(CASE WHEN s_suppkey % 11 = 0 THEN ' ' WHEN s_suppkey % 7 = 0 THEN ' k' || (s_suppkey % 3) ELSE 'Q' || s_suppkey END)) AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'UMUMIY' ELSE 'S' || (s_nationkey % 3) END AS section_code FROM supplier),
    e AS (SELECT DISTINCT 'S' || (n_nationkey % 3) AS section_code, 'Q' || n_nationkey AS code FROM nation),
    n AS (SELECT *, count(*) OVER (PARTITION BY section_code, code) AS k FROM r)
    SELECT s_suppkey, section_code, n.code, CASE WHEN n.code = '' THEN 'empty_code' WHEN k > 1 THEN 'duplicate_in_batch' WHEN e.code IS NOT NULL THEN 'already_exists' ELSE 'accepted' END AS outcome FROM n LEFT JOIN e USING (section_code, code)""",
)
def taxonomy_import(spark, sf):
    s = A.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    code = F.when(k % 11 == 0, " ").when(k % 7 == 0, F.concat(F.lit(" k"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("q"), k.cast("string")))
    section = F.when(k % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("s"), (F.col("s_nationkey") % 3).cast("string")))
    rows = s.select("s_suppkey", code.alias("code"), section.alias("section_code"))
    n = A.table(spark, sf, "nation")
    old = n.select(F.concat(F.lit("S"), (F.col("n_nationkey") % 3).cast("string")).alias("section_code"), F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("code"))
    ok, bad = G.import_taxonomy(rows, old)
    return ok.withColumn("problem", F.lit("accepted")).unionByName(bad).select("s_suppkey", "section_code", "code", F.col("problem").alias("outcome"))


# ----------------------------------------------------------------- curation
@query(
    "qa_contexts",
    f"""WITH {S.CLAUSE}, c AS (SELECT *, {' + '.join(f"contains(lower(text), {S.q(t)})::INT" for t in K.QUALITY_TERMS)} AS terms FROM clause WHERE length(text) >= 40)
    SELECT document_id, clause_id AS item, 'clause' AS kind, round(least(3, len(regexp_extract_all(text, '\\d'))) * 0.12 + terms * 0.08 + least(length(text), 900) / 900 * 0.25, 6) AS score, md5(left(text, 850)) AS excerpt_md5 FROM c
    UNION ALL SELECT document_id, table_id, 'table', round(least(6, len(regexp_extract_all(hay, '\\d'))) * 0.06 + 0.3, 6), md5(left(content, 1400)) FROM (
      SELECT document_id, table_id, table_number || ' ' || title || ' ' || section_title AS hay, title || ' ' || section_title || ' qatorlar soni ' || row_count || ' ta' AS content FROM ({"WITH " + S.NORM_TABLE + " SELECT * FROM norm_table"})) WHERE length(content) >= 40""",
)
def qa_contexts(spark, sf):
    return draft_contexts(spark, sf).select("document_id", "item", "kind", r6(F.col("score")).alias("score"), F.md5("excerpt").alias("excerpt_md5"))


def draft_contexts(spark, sf):
    t = A.tables(spark, sf).select(
        "document_id", "table_id", F.concat_ws(" ", "table_number", "title", "section_title").alias("haystack"),
        F.concat_ws(" ", "title", "section_title", F.lit("qatorlar soni"), F.col("row_count").cast("string"), F.lit("ta")).alias("content"),
    )
    return U.contexts(A.clauses(spark, sf), t)


@query(
    "context_window",
    f"""WITH {S.CLAUSE}, c AS (SELECT *, {' + '.join(f"contains(lower(text), {S.q(t)})::INT" for t in K.QUALITY_TERMS)} AS terms FROM clause WHERE length(text) >= 40),
    {S.NORM_TABLE}, u AS (SELECT document_id, clause_id AS item, 0 AS t, round(least(3, len(regexp_extract_all(text, '\\d'))) * 0.12 + terms * 0.08 + least(length(text), 900) / 900 * 0.25, 9) AS score FROM c
      UNION ALL SELECT document_id, table_id, 1, round(least(6, len(regexp_extract_all(table_number || ' ' || title || ' ' || section_title, '\\d'))) * 0.06 + 0.3, 9) FROM norm_table
        WHERE length(title || ' ' || section_title || ' qatorlar soni ' || row_count || ' ta') >= 40),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id, t ORDER BY score DESC, item) - 1 AS i FROM u),
    s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i * 2 + t) AS position FROM r WHERE CASE t WHEN 0 THEN i BETWEEN 2 AND 19 ELSE i BETWEEN 2 AND 7 END)
    SELECT document_id, item, position FROM s WHERE position <= 18""",
)
def context_window(spark, sf):
    return U.context_window(draft_contexts(spark, sf), 2, 3).select("document_id", "item", "position")


def drafts(spark, sf):
    """Generated drafts derived from parts; lengths and table claims vary."""
    p = A.table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    num = F.regexp_extract("p_brand", r"(\d+)", 1)
    return p.select(
        k.alias("draft_id"), num.cast("bigint").alias("document_id"), (k % 40).alias("job_id"),
        F.when(k % 13 == 0, "Savol?").otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit(" kengligi  qancha bo'ladi?"))).alias("question"),
        F.concat(F.col("p_name"), F.lit(" kengligi kamida "), size, F.lit(" mm bo'lishi kerak")).alias("answer"),
        F.concat(size, F.lit(" mm")).alias("short_answer"),
        F.when(k % 17 == 0, "qisqa").otherwise(F.concat(num, F.lit("-jadval: "), F.col("p_type"), F.lit(" uchun belgilangan qiymat"))).alias("source_excerpt"),
        F.when(k % 5 == 0, "Mixed").when(k % 5 == 1, "table").when(k % 5 == 2, "boshqa").otherwise("").alias("source_kind"),
        (k % 5 < 2).alias("has_table"), F.when(k % 10 == 1, "99").when(k % 10 == 5, num).otherwise("").alias("table_number"),
        F.lit("1.1").alias("clause_number"), F.when(k % 4 == 0, "a1").otherwise("").alias("source_anchor"),
    )


_DRAFT = """draft AS (SELECT p_partkey AS draft_id, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS document_id, p_partkey % 40 AS job_id,
   CASE WHEN p_partkey % 13 = 0 THEN 'Savol?' ELSE p_name || ' kengligi qancha bo''ladi?' END AS question, p_name || ' kengligi kamida ' || p_size || ' mm bo''lishi kerak' AS answer,
   CASE WHEN p_partkey % 17 = 0 THEN 'qisqa' ELSE regexp_extract(p_brand, '(\\d+)', 1) || '-jadval: ' || p_type || ' uchun belgilangan qiymat' END AS ex, p_partkey AS k, regexp_extract(p_brand, '(\\d+)', 1) AS num FROM part),
 valid AS (SELECT *, CASE WHEN k % 10 = 5 THEN num WHEN k % 5 < 2 AND k % 10 <> 1 THEN num END AS tn FROM draft WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 10 <> 1)"""


def valid_drafts(spark, sf):
    t = A.tables(spark, sf).select("document_id", "table_id", "table_number", F.concat(F.lit("t"), "table_number").alias("html_anchor"))
    c = A.clauses(spark, sf).select("document_id", "clause_number", F.concat(F.lit("c"), "clause_number").alias("html_anchor"))
    return U.validate(drafts(spark, sf), t, c)


@query(
    "draft_validate",
    f"""WITH {_DRAFT}, {S.CLAUSE} SELECT draft_id, v.document_id, question, tn IS NOT NULL AS has_table, CASE WHEN tn IS NOT NULL THEN 'Brand#' || tn END AS table_id, tn AS table_number,
      CASE WHEN k % 5 = 0 THEN 'mixed' WHEN k % 5 = 1 AND tn IS NOT NULL THEN 'table' ELSE 'clause' END AS source_kind,
      CASE WHEN k % 4 = 0 THEN 'a1' WHEN EXISTS (SELECT 1 FROM clause c WHERE c.document_id = v.document_id AND c.clause_number = '1.1') THEN 'c1.1' WHEN tn IS NOT NULL THEN 't' || tn ELSE '' END AS source_anchor FROM valid v""",
)
def draft_validate(spark, sf):
    return valid_drafts(spark, sf).select("draft_id", "document_id", "question", "has_table", "table_id", "table_number", "source_kind", "source_anchor")


_USED = "used AS (SELECT DISTINCT document_id, lower(question) AS question_key FROM valid WHERE k % 50 = 0 UNION SELECT DISTINCT document_id, lower(question) FROM valid WHERE k % 70 = 0 UNION SELECT DISTINCT document_id, lower(question) FROM valid WHERE k % 90 = 0)"


def _used(v):
    return U.used_questions(*[v.where(F.col("draft_id") % n == 0).withColumn("question", F.upper("question")) for n in (50, 70, 90)])


@query("used_questions", f"WITH {_DRAFT}, {_USED} SELECT document_id, question_key FROM used")
def used_questions(spark, sf):
    return _used(valid_drafts(spark, sf))


@query(
    "draft_dedupe",
    f"""WITH {_DRAFT}, {_USED}, f AS (SELECT document_id, lower(question) AS question_key, min(draft_id) AS draft_id FROM valid GROUP BY 1, 2) SELECT draft_id, f.document_id FROM f ANTI JOIN used USING (document_id, question_key)
    WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.k % 60 = 0 AND v.document_id = f.document_id AND v.question = (SELECT w.question FROM valid w WHERE w.draft_id = f.draft_id))""",
)
def draft_dedupe(spark, sf):
    v = valid_drafts(spark, sf)
    return U.dedupe(v, _used(v), v.where("draft_id % 60 = 0")).select("draft_id", "document_id")


def reviewed(spark, sf):
    v = valid_drafts(spark, sf).withColumn("status", F.when(F.col("draft_id") % 11 == 0, "approved").otherwise("draft"))
    k = F.col("draft_id") % 3
    decisions = v.where(k < 2).select("draft_id", F.when(k == 0, "approve").otherwise("reject").alias("decision"), F.when(F.col("draft_id") % 2 == 0, "izoh").alias("note"))
    return U.review(v, decisions)


HASH_SQL = f"""sha1('["' || array_to_string(list_sort(list_filter([CASE WHEN k % 5 <> 1 OR tn IS NULL THEN 'clause:' || lower(replace({S.code('document_id')}, ' ', '')) || ':1.1' END, CASE WHEN tn IS NOT NULL THEN 'table:' || lower(replace({S.code('document_id')}, ' ', '')) || ':' || tn END], lambda x: x IS NOT NULL)), '", "') || '"]')"""


def draft_source_ids():
    """Identity strings of the sources of a draft."""
    src = U.draft_sources(F.col("source_kind"), F.col("has_table"), A.code_of(F.col("document_id")), F.col("clause_number"), F.col("source_anchor"), F.col("source_excerpt"), F.col("table_number"))
    nothing = F.lit(None).cast("string")
    names = ("clause_number", "html_anchor", "table_number", "snippet")
    return F.array_distinct(F.transform(src, lambda s: R.source_id(s["type"], s["shnq_code"], {n: s[n] for n in names} | {"row_index": F.lit(None).cast("bigint"), "appendix_number": nothing, "image_url": nothing, "title": nothing})))


@query("approve_drafts", f"WITH {_DRAFT} SELECT draft_id, {S.norm('question')} AS normalized_question, {HASH_SQL} AS source_hash FROM valid WHERE k % 11 <> 0 AND k % 3 = 0")
def approve_drafts(spark, sf):
    _, ok, _ = reviewed(spark, sf)
    return ok.select("draft_id", X.normalize_text("question").alias("normalized_question"), R.source_hash(draft_source_ids()).alias("source_hash"))


@query("reject_drafts", f"WITH {_DRAFT} SELECT draft_id, {S.norm('question')} AS normalized_question, CASE WHEN k % 2 = 0 THEN 'izoh' ELSE 'qa_generator_reject_delete' END AS reason FROM valid WHERE k % 11 <> 0 AND k % 3 = 1")
def reject_drafts(spark, sf):
    _, _, no = reviewed(spark, sf)
    return no.select("draft_id", X.normalize_text("question").alias("normalized_question"), "reason")


_JOBS = f"""{_DRAFT}, after AS (SELECT job_id, CASE WHEN k % 11 = 0 OR k % 3 = 0 THEN 'approved' ELSE 'draft' END AS status FROM valid WHERE k % 11 = 0 OR k % 3 <> 1),
 jobs AS (SELECT DISTINCT p_partkey % 40 AS job_id, (p_partkey % 40) AS requested FROM part)"""


def jobs(spark, sf):
    return A.table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("job_id")).distinct().withColumn("requested", F.col("job_id"))


@query(
    "job_counters",
    f"""WITH {_JOBS} SELECT j.job_id, count(a.job_id) AS generated, count(*) FILTER (a.status = 'approved') AS approved, greatest(0, max(requested) - count(a.job_id)) AS remaining FROM jobs j LEFT JOIN after a USING (job_id) GROUP BY j.job_id""",
)
def job_counters(spark, sf):
    after, _, _ = reviewed(spark, sf)
    return U.job_counters(jobs(spark, sf), after).select("job_id", "generated", "approved", "remaining")


@query("job_totals", f"WITH {_JOBS} SELECT (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM jobs WHERE job_id % 4 < 2) AS running_jobs, count(*) AS generated, count(*) FILTER (status = 'approved') AS approved FROM after")
def job_totals(spark, sf):
    after, _, _ = reviewed(spark, sf)
    j = U.job_counters(jobs(spark, sf), after).withColumn("status", F.when(F.col("job_id") % 4 == 0, "queued").when(F.col("job_id") % 4 == 1, "running").otherwise("done"))
    return j.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count(F.when(F.col("status").isin("queued", "running"), 1)).alias("running_jobs"), F.sum("generated").alias("generated"), F.sum("approved").alias("approved")
    )


@query("latest_job", "SELECT user_id AS document_id, max(event_id) AS job_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_job(spark, sf):
    e = A.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("document_id")).agg(F.max("event_id").alias("job_id"), F.max_by("event_type", "event_id").alias("status"))


_LISTED_AT = "2024-01-15 12:00:00"


@query(
    "jobs_listing",
    f"""WITH jobs AS (SELECT event_id AS job_id, user_id AS document_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancelled' ELSE 'completed' END AS status FROM events)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC NULLS LAST, job_id DESC) AS place, job_id,
      CASE WHEN status IN ('queued', 'running') AND ts < TIMESTAMP '{_LISTED_AT}' - INTERVAL 10 MINUTE THEN 'failed' ELSE status END AS status FROM jobs QUALIFY place <= 50""",
)
def jobs_listing(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "signup", "queued").when(t == "view", "running").when(t == "click", "cancelled").otherwise("completed")
    j = A.table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return U.list_jobs(j, F.lit(_LISTED_AT).cast("timestamp")).select("document_id", big(F.col("place")).alias("place"), "job_id", "status")


@query("recent_drafts", "SELECT p_partkey AS draft_id, p_size FROM part WHERE p_size > 10 ORDER BY p_size DESC, p_partkey LIMIT 500")
def recent_drafts(spark, sf):
    return A.table(spark, sf, "part").where("p_size > 10").orderBy(F.desc("p_size"), "p_partkey").limit(500).select(F.col("p_partkey").alias("draft_id"), "p_size")


_CMD = """cmd AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'extend' WHEN 'click' THEN 'progress' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'finish' ELSE 'start' END
    ELSE CASE WHEN event_id % 5 = 0 THEN 'delete' WHEN event_id % 2 = 0 THEN 'cancel' ELSE 'restart' END END AS command, floor(value)::BIGINT AS amount FROM events),
 ci AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i FROM cmd)"""


@query(
    "job_ledger",
    f"""WITH RECURSIVE {_CMD}, w(job_id, i, status, requested, generated, touched, refused) AS (
      SELECT DISTINCT job_id, 0::BIGINT, 'none', 0::BIGINT, 0::BIGINT, NULL::TIMESTAMP, 0::BIGINT FROM cmd
      UNION ALL SELECT x.job_id, x.i, CASE WHEN ok THEN CASE WHEN command IN ('create', 'restart', 'extend') THEN 'queued' WHEN command IN ('start', 'progress') THEN 'running' WHEN command = 'finish' THEN CASE WHEN requested <= generated THEN 'completed' ELSE 'failed' END WHEN command = 'cancel' THEN 'cancelled' ELSE 'deleted' END ELSE st END,
        requested + CASE WHEN ok AND command IN ('create', 'extend') THEN greatest(1, amount) ELSE 0 END, generated + CASE WHEN ok AND command = 'progress' THEN amount ELSE 0 END, CASE WHEN ok THEN ts ELSE touched END, refused + (NOT ok)::INT
      FROM (SELECT y.*, CASE command WHEN 'create' THEN st = 'none' WHEN 'start' THEN st = 'queued' WHEN 'progress' THEN st IN ('queued', 'running') WHEN 'finish' THEN st IN ('queued', 'running') WHEN 'cancel' THEN st IN ('queued', 'running')
          WHEN 'restart' THEN st NOT IN ('queued', 'running', 'none', 'deleted') AND requested > generated ELSE st NOT IN ('queued', 'running', 'none', 'deleted') END AS ok
        FROM (SELECT c.job_id, c.i, c.command, c.amount, c.ts, w.requested, w.generated, w.touched, w.refused, CASE WHEN w.status IN ('queued', 'running') AND w.touched < c.ts - INTERVAL 10 MINUTE THEN 'failed' ELSE w.status END AS st FROM w JOIN ci c ON c.job_id = w.job_id AND c.i = w.i + 1) y) x),
    l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1)
    SELECT job_id, CASE WHEN status IN ('queued', 'running') AND touched < TIMESTAMP '2024-02-01' - INTERVAL 10 MINUTE THEN 'failed' ELSE status END AS status, requested, generated, refused, greatest(0, requested - generated) AS remaining FROM l""",
)
def job_ledger(spark, sf):
    e, k = A.table(spark, sf, "events"), F.col("event_id")
    t = F.col("event_type")
    command = (
        F.when(t == "signup", "create").when(t == "purchase", "extend").when(t == "click", "progress").when(t == "view", F.when(k % 3 == 0, "finish").otherwise("start"))
        .otherwise(F.when(k % 5 == 0, "delete").when(k % 2 == 0, "cancel").otherwise("restart"))
    )
    c = e.select(F.col("user_id").alias("job_id"), k.alias("seq"), "ts", command.alias("command"), F.floor("value").alias("amount"))
    l = U.job_ledger(c, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return l.select("job_id", "status", "requested", "generated", big(F.col("refused")).alias("refused"), "remaining")


