"""Queries over the ingestion pipeline, run on pages that Spark derives from the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.functions import vectors as V
from clausespark.operators import ingest as H
from clausespark.plans import retrieval_sql as P
from clausespark.plans import sql as S
from clausespark.plans.registry import query
from clausespark.session import cut_lineage
from clausespark.sources import adapters as A
from clausespark.sources import html_files, sinks

big = lambda c: c.cast("bigint")


def pages(spark, sf):
    """A page per document: its lines as clauses with headers, anchors, appendices, images and tables between."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def block(line, i):
        n = i.cast("string")
        on = lambda cond, *parts: F.when(cond, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])).otherwise("")
        return F.concat(
            on(i % 10 == 0, '<div class="TEXT_HEADER_DEFAULT">Bob  ', (F.floor(i / 10) + 1).cast("string"), "</div>"),
            on(i % 7 == 3, '<div class="appl_banner_x"><b>', n, "-ilova</b></div>"),
            on(i % 7 == 4, '<div class="ACT_TITLE_APPL">Sarlavha ', n, "</div>"),
            F.lit('<div class="ACT_TEXT">'), esc(line), F.lit("</div>"),
            on(i % 3 == 0, '<a id="anc', n, '"></a>'),
            on(i % 10 == 2, '<div><img src=" /img/', n, '.png"></div>'),
            on(i % 10 == 7, '<div><img src="/img/dup.png"></div>'),
            on(i % 6 == 5, '<div class="w">'),
            on(i % 12 == 5, "<p>", n, "-jadval. Nomi ", n, "</p>"),
            on(
                i % 6 == 5, "<table><tr><th>Nomi</th><th>Qiymat</th></tr><tr><td>", n, "</td><td>", (i * 2).cast("string"),
                '</td></tr><tr><td colspan="2">Nomi</td></tr></table></div>',
            ),
        )

    d = A.texts(spark, sf, "documents")
    return d.select(F.col("doc_id"), F.array_join(F.transform(F.split("text", "\n"), block), "").alias("html"))


def segmented(spark, sf, *roles):
    return H.segment(pages(spark, sf), *roles)


_L = f"""li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
ln AS (SELECT doc_id, i, {S.squeeze('raw')} AS t, i // 10 + 1 AS ch, 'Bob ' || (i // 10 + 1) AS ct FROM li)"""
_APPX = """(SELECT max(j) FROM range(ln.i // 10 * 10, ln.i + 1) r(j) WHERE j % 7 = 3)"""
_APPT = """(SELECT max(j) FROM range(ln.i // 10 * 10, ln.i + 1) r(j) WHERE j % 7 = 4)"""


@query("html_elements", f"WITH {_L} SELECT doc_id, 'header' AS role, count(*) AS n FROM ln WHERE i % 10 = 0 GROUP BY 1 UNION ALL SELECT doc_id, 'clause', count(*) FROM ln GROUP BY 1 UNION ALL SELECT doc_id, 'table', count(*) FROM ln WHERE i % 6 = 5 GROUP BY 1 UNION ALL SELECT doc_id, 'image', count(*) FROM ln WHERE i % 5 = 2 GROUP BY 1")
def html_elements(spark, sf):
    e = segmented(spark, sf).where(F.col("role").isin("header", "clause", "table", "image"))
    return e.groupBy("doc_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("page_elements")
def page_elements(spark, sf):
    """Elements of the raw crawled pages, with unclosed tags and scripts."""
    p = A.texts(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return html_files.flatten(p).select("doc_id", "pos", "tag", F.array_join("classes", " ").alias("classes"), "text")


@query("chapter_segments", f"WITH {_L} SELECT doc_id, ch AS chapter_order, any_value(ct) AS title, count(*) AS n_clauses FROM ln GROUP BY doc_id, ch")
def chapter_segments(spark, sf):
    s = segmented(spark, sf).where("role = 'clause'")
    g = s.groupBy("doc_id", "chapter_order").agg(F.max("chapter_title").alias("title"), F.count(F.lit(1)).alias("n_clauses"))
    return g.select("doc_id", big(F.col("chapter_order")).alias("chapter_order"), "title", "n_clauses")


@query("clauses", f"WITH {_L} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS clause_order, ch AS chapter_order, nullif(regexp_extract(t, {S.q(K.LEADING_NUMBER)}, 1), '') AS clause_number, md5(t) AS text_md5 FROM ln WHERE length(t) >= 30")
def clauses(spark, sf):
    c = H.clauses(segmented(spark, sf))
    return c.select("doc_id", big(F.col("clause_order")).alias("clause_order"), big(F.col("chapter_order")).alias("chapter_order"), "clause_number", F.md5("text").alias("text_md5"))


@query(
    "appendix_state",
    f"""WITH {_L}, im AS (SELECT *, CASE WHEN i % 10 = 2 THEN '/img/' || i || '.png' ELSE '/img/dup.png' END AS src, {_APPX} AS an, {_APPT} AS ap_t FROM ln WHERE i % 5 = 2),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, src ORDER BY i) AS k FROM im)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS image_order, src AS image_url, an::VARCHAR AS appendix_number, 'Sarlavha ' || ap_t AS title, ct AS section_title FROM f WHERE k = 1""",
)
def appendix_state(spark, sf):
    i = H.images(segmented(spark, sf))
    return i.select("doc_id", big(F.col("image_order")).alias("image_order"), "image_url", "appendix_number", "title", "section_title")


@query(
    "image_search_text",
    f"""WITH {_L}, im AS (SELECT *, CASE WHEN i % 10 = 2 THEN '/img/' || i || '.png' ELSE '/img/dup.png' END AS src, {_APPX} AS an, {_APPT} AS ap_t FROM ln WHERE i % 5 = 2),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, src ORDER BY i) AS k FROM im)
    SELECT doc_id, src AS image_url, concat_ws(chr(10), 'Hujjat: ' || {S.code('doc_id')}, 'Rasm URL: ' || src, 'Bo''lim: ' || ct, 'Ilova: ' || an, 'Sarlavha: Sarlavha ' || ap_t) AS head FROM f WHERE k = 1""",
)
def image_search_text(spark, sf):
    i = H.images(segmented(spark, sf)).withColumn("code", A.code_of(F.col("doc_id"))).withColumn("context_text", F.lit(None).cast("string"))
    return i.select("doc_id", "image_url", H.image_search_text().alias("head"))


# the blocks of a page in order; a block with an image has no text of its own
_DIVS = """dv AS (SELECT doc_id, i, 0 AS o, ct AS x FROM ln WHERE i % 10 = 0 UNION ALL SELECT doc_id, i, 1, i || '-ilova' FROM ln WHERE i % 7 = 3 UNION ALL SELECT doc_id, i, 2, 'Sarlavha ' || i FROM ln WHERE i % 7 = 4
  UNION ALL SELECT doc_id, i, 3, t FROM ln UNION ALL SELECT doc_id, i, 4, '' FROM ln WHERE i % 5 = 2
  UNION ALL SELECT doc_id, i, 5, CASE WHEN i % 12 = 5 THEN i || '-jadval. Nomi ' || i || ' ' ELSE '' END || 'Nomi Qiymat ' || i || ' ' || (i * 2) || ' Nomi' FROM ln WHERE i % 6 = 5),
nb AS (SELECT doc_id, i, o, list_transform(list_filter([lag(x) OVER w, lag(x, 2) OVER w, lag(x, 3) OVER w, lead(x) OVER w, lead(x, 2) OVER w], lambda v: v <> '' AND lower(v) NOT LIKE 'http://%' AND lower(v) NOT LIKE 'https://%'), lambda v: left(v, 220)) AS c
  FROM dv WINDOW w AS (PARTITION BY doc_id ORDER BY i, o)),
cx AS (SELECT doc_id, i, array_to_string(list_filter(c, lambda v, k: list_position(list_transform(c, lambda u: lower(u)), lower(v)) = k)[:3], ' | ') AS context_text FROM nb WHERE o = 4)"""


@query(
    "image_context",
    f"""WITH {_L}, {_DIVS}, im AS (SELECT *, CASE WHEN i % 10 = 2 THEN '/img/' || i || '.png' ELSE '/img/dup.png' END AS src, {_APPX} AS an, {_APPT} AS ap_t FROM ln WHERE i % 5 = 2),
    f AS (SELECT im.*, context_text FROM im JOIN cx USING (doc_id, i) QUALIFY row_number() OVER (PARTITION BY doc_id, src ORDER BY i) = 1)
    SELECT doc_id, src AS image_url, context_text, concat_ws(chr(10), 'Hujjat: ' || {S.code('doc_id')}, 'Rasm URL: ' || src, 'Bo''lim: ' || ct, 'Ilova: ' || an, 'Sarlavha: Sarlavha ' || ap_t, 'Kontekst: ' || nullif(context_text, '')) AS search_text FROM f""",
)
def image_context(spark, sf):
    """Each image with the texts around it and the search text built from them."""
    i = H.images(segmented(spark, sf)).withColumn("code", A.code_of(F.col("doc_id")))
    return i.select("doc_id", "image_url", "context_text", H.image_search_text().alias("search_text"))


_TB = f"""tb0 AS (SELECT *, CASE WHEN i % 12 = 5 THEN i::VARCHAR ELSE 'ilova-' || {_APPX} END AS num FROM ln WHERE i % 6 = 5),
tb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS table_order, coalesce(num, (count(*) FILTER (num IS NULL) OVER (PARTITION BY doc_id ORDER BY i))::VARCHAR) AS table_number,
  CASE WHEN i % 12 = 5 THEN 'Nomi ' || i END AS title FROM tb0)"""


@query("table_numbers", f"WITH {_L}, {_TB} SELECT doc_id, table_order, table_number, ct AS section_title FROM tb")
def table_numbers(spark, sf):
    return H.tables(segmented(spark, sf, "table")).select("doc_id", big(F.col("table_order")).alias("table_order"), "table_number", "section_title")


@query("table_titles", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'Jadval' ELSE p_name || ' haqida' END AS title, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || 'a' END AS number FROM part")
def table_titles(spark, sf):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    label = (
        F.when(k == 0, F.concat(size, F.lit("-jadval. "), F.col("p_name"))).when(k == 1, F.concat(F.lit("Jadval "), size, F.lit("a - "), F.col("p_name")))
        .when(k == 2, "Jadval").otherwise(F.concat("p_name", F.lit(" haqida")))
    )
    p = A.table(spark, sf, "part").select("p_partkey", X.clean_text(label).alias("label"))
    return p.select("p_partkey", R.label_title(F.col("label")).alias("title"), R.label_table_number(F.lower("label")).alias("number"))


@query(
    "table_cells",
    f"""WITH {_L}, {_TB}, c AS (SELECT doc_id, table_order, unnest([{{'r': 1, 'c': 1, 't': 'Nomi', 'h': true}}, {{'r': 1, 'c': 2, 't': 'Qiymat', 'h': true}}, {{'r': 2, 'c': 1, 't': i::VARCHAR, 'h': false}},
      {{'r': 2, 'c': 2, 't': (i * 2)::VARCHAR, 'h': false}}, {{'r': 3, 'c': 1, 't': 'Nomi', 'h': false}}]) AS x FROM tb)
    SELECT doc_id, table_order, x.r::BIGINT AS row_index, x.c::BIGINT AS col_index, x.t AS text, x.h AS is_header FROM c""",
)
def table_cells(spark, sf):
    g = H.cells(H.tables(segmented(spark, sf, "table"))).where("NOT carried")
    return g.select("doc_id", "table_order", big(F.col("row_index")).alias("row_index"), big(F.col("col_index")).alias("col_index"), "text", "is_header")


@query(
    "grid_markdown",
    f"""WITH {_L}, {_TB} SELECT doc_id, table_order, '| Nomi | Qiymat |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || i || ' | ' || (i * 2) || ' |' || chr(10) || '| Nomi | Nomi |' AS markdown FROM tb""",
)
def grid_markdown(spark, sf):
    return H.markdown(H.cells(H.tables(segmented(spark, sf, "table"))))


@query(
    "row_search_text",
    f"""WITH {_L}, {_TB}, r AS (SELECT *, unnest([1, 2, 3]) AS row_index FROM tb)
    SELECT doc_id, table_order, row_index::BIGINT AS row_index, concat_ws(chr(10), 'Hujjat: ' || {S.code('doc_id')}, 'Jadval: ' || table_number, 'Satr: ' || row_index, 'Bo''lim: ' || ct, 'Sarlavha: ' || title,
      'Qiymatlar: ' || CASE row_index WHEN 1 THEN 'Ustun 1: Nomi | Ustun 2: Qiymat' WHEN 2 THEN 'Nomi: ' || i || ' | Qiymat: ' || (i * 2) ELSE 'Ustun 1: Nomi' END) AS search_text FROM r""",
)
def row_search_text(spark, sf):
    # written, so that pages are parsed once for the cells and for the heads of the tables
    t = cut_lineage(H.tables(segmented(spark, sf, "table")).select("doc_id", "table_order", "table_number", "section_title", "title", "cells"))
    info = t.select("doc_id", big(F.col("table_order")).alias("table_order"), A.code_of(F.col("doc_id")).alias("code"), "table_number", "section_title", "title")
    return H.row_search_text(H.cells(t), info).select("doc_id", "table_order", big(F.col("row_index")).alias("row_index"), "search_text")


@query("anchors")
def anchors(spark, sf):
    """Anchors of clauses, tables and images (the fold is property-tested)."""
    return H.anchors(segmented(spark, sf))


@query(
    "infer_codes",
    f"""WITH {S.DOCUMENT}, t AS (SELECT document_id, category_code, code, CASE WHEN document_id % 3 = 0 THEN 'QMQ 2.01.' || (document_id % 50) || '-97' WHEN document_id % 3 = 1 THEN {S.code('(document_id + 1)')} END AS stated FROM document),
    w AS (SELECT *, stated IS NOT NULL AND stated <> code AND NOT EXISTS (SELECT 1 FROM document d WHERE d.category_code = t.category_code AND d.code = t.stated) AS free FROM t),
    k AS (SELECT *, free AND document_id = min(document_id) FILTER (free) OVER (PARTITION BY category_code, stated) AS renamed FROM w)
    SELECT document_id, CASE WHEN coalesce(renamed, false) THEN stated ELSE code END AS code, coalesce(renamed, false) AS renamed FROM k""",
)
def infer_codes(spark, sf):
    d = A.documents(spark, sf).select("document_id", F.col("category_code").alias("category"), "code")
    k = F.col("document_id")
    title = F.when(k % 3 == 0, F.concat(F.lit("Me'yorlar  qmq  2.01."), (k % 50).cast("string"), F.lit("-97 to'plami"))).when(k % 3 == 1, A.code_of(k + 1)).otherwise("Nomsiz")
    return H.infer_codes(d, d.select("document_id", title.alias("title"))).select("document_id", "code", "renamed")


@query(
    "clause_embeddings",
    f"""WITH {S.CLAUSE}, {P.sparse_cte('cv', 'clause', 'clause_id', 'text')}, g AS (SELECT clause_id, count(*) AS n_dims, round(sum(w * w), 6) AS norm, round(sum(w * idx), 4) AS checksum FROM cv GROUP BY clause_id)
    SELECT clause_id, code, chapter_title, len(string_split(text, ' ')) AS token_count, n_dims, norm, checksum FROM clause JOIN g USING (clause_id)""",
)
def clause_embeddings(spark, sf):
    c = A.clauses(spark, sf).withColumn("v", V.hash_vectors("text"))
    total = lambda f: F.aggregate(F.arrays_zip("v.idx", "v.w"), F.lit(0.0), lambda a, x: a + f(x))
    return c.where(F.size("v.idx") > 0).select(
        "clause_id", "code", "chapter_title", big(F.size(F.split("text", " "))).alias("token_count"), big(F.size("v.idx")).alias("n_dims"),
        F.round(total(lambda x: x["w"] * x["w"]), 6).alias("norm"), F.round(total(lambda x: x["w"] * x["idx"]), 4).alias("checksum"),
    )


@query(
    "replace_doc",
    f"""WITH {S.CLAUSE} SELECT document_id, clause_order, text_md5 FROM (SELECT document_id, clause_order, md5(text) AS text_md5 FROM clause WHERE document_id % 7 <> 2
    UNION ALL SELECT document_id, clause_order, md5('x ' || text) FROM clause WHERE document_id % 7 = 2 AND clause_order <= 5)""",
)
def replace_doc(spark, sf):
    c = A.clauses(spark, sf).select("document_id", "clause_order", "text")
    fresh = c.where("document_id % 7 = 2 AND clause_order <= 5").withColumn("text", F.concat(F.lit("x "), "text"))
    return H.replace_documents(c, fresh).select("document_id", "clause_order", F.md5("text").alias("text_md5"))


@query(
    "vec_upsert",
    """SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 AND vec_id % 5 <> 0 THEN 'new' ELSE 'old' END AS version, label::BIGINT AS label FROM embeddings WHERE vec_id % 2 = 0 OR (vec_id % 3 = 0 AND vec_id % 5 <> 0)""",
)
def vec_upsert(spark, sf):
    v = A.vectors(spark, sf)
    point = lambda df, tag: df.select(F.col("vec_id").alias("id"), "vector", F.struct(F.lit(tag).alias("version"), "label").alias("payload"))
    short = v.where("vec_id % 3 = 0").withColumn("vector", F.when(F.col("vec_id") % 5 == 0, F.slice("vector", 1, 8)).otherwise(F.col("vector")))
    u = sinks.upsert_points(point(v.where("vec_id % 2 = 0"), "old"), point(short, "new"), 64)
    return u.select("id", "payload.version", "payload.label")
