"""Queries over sources and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import intent as I
from clausespark.functions import lang as L
from clausespark.functions import numeric as N
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.plans import sql as S
from clausespark.plans.registry import query
from clausespark.sources import adapters as A

big = lambda c: c.cast("bigint")
bar = lambda c: F.array_join(c, "|")
r6 = lambda c: F.round(c, 6)


@query(
    "src_pages",
    """SELECT page_id, url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, length(html) AS n_chars,
       md5(html) AS html_md5 FROM pages""",
)
def src_pages(spark, sf):
    p = A.texts(spark, sf, "pages")
    html = X.repair_mojibake("html")
    return p.select(
        "page_id", "url", F.regexp_extract(html, '<html lang="([^"]*)"', 1).alias("lang"),
        big(F.length(html)).alias("n_chars"), F.md5(html).alias("html_md5"),
    )


@query(
    "fewshot_clean",
    f"""SELECT item_id, {S.squeeze(f"translate(text, {S.q(K.APOSTROPHES)}, {S.q(chr(39) * 6)})")} AS question,
       'Javob ' || (item_id % 5) AS answer FROM benchmark
       WHERE item_id % 5 <> 0 AND {S.squeeze('text')} <> ''""",
)
def fewshot_clean(spark, sf):
    from clausespark.sources.fewshot import clean_examples

    answer = F.when(F.col("item_id") % 5 != 0, F.concat(F.lit("Javob "), (F.col("item_id") % 5).cast("string"))).otherwise("  ")
    raw = A.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), answer.alias("answer"))
    return clean_examples(raw)


@query("clean_text", f"SELECT doc_id, md5({S.squeeze('text')}) AS clean_md5, length({S.squeeze('text')}) AS n FROM documents")
def clean_text(spark, sf):
    d = A.texts(spark, sf, "documents").select("doc_id", X.clean_text("text").alias("t"))
    return d.select("doc_id", F.md5("t").alias("clean_md5"), big(F.length("t")).alias("n"))


@query("mojibake_repair")
def mojibake_repair(spark, sf):
    """Damage every text, repair it and report per source how many rows changed and came back."""
    d = A.texts(spark, sf, "documents").select("source", "text", X.to_mojibake("text").alias("bad"))
    f = d.select("source", "text", "bad", X.repair_mojibake("bad").alias("fixed"))
    return f.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("fixed") != F.col("bad"), 1).otherwise(0)).alias("changed"),
        F.sum(F.when(F.col("fixed") == F.trim("text"), 1).otherwise(0)).alias("restored"),
    )


@query("norm_question", f"SELECT conv_id, turn, md5({S.norm('text')}) AS norm_md5 FROM conversations")
def norm_question(spark, sf):
    c = A.texts(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(X.normalize_text("text", compat=True)).alias("norm_md5"))


@query(
    "stem_tokens",
    f"""SELECT s AS stem, count(*) AS n FROM (SELECT unnest({S.stems(S.fold('text'))}) AS s FROM documents) GROUP BY s""",
)
def stem_tokens(spark, sf):
    d = A.texts(spark, sf, "documents").select(F.explode(X.tokenize("text")).alias("stem"))
    return d.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tokens",
    f"""WITH t AS (SELECT doc_id, list_filter({S.tokens(S.fold('text'))}, lambda t: length(t) > 2) AS ts FROM documents)
    SELECT doc_id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_distinct FROM t""",
)
def tokens(spark, sf):
    ts = F.filter(X.extract_tokens(X.lexical_fold("text")), lambda t: F.length(t) > 2)
    d = A.texts(spark, sf, "documents").select("doc_id", ts.alias("ts"))
    return d.select(
        "doc_id", big(F.size("ts")).alias("n_tokens"), big(F.size(F.array_distinct("ts"))).alias("n_distinct")
    )


_QT = f"""qt AS (SELECT item_id AS qid, n, {S.stems('n')} AS st FROM (SELECT item_id, {S.norm('text')} AS n FROM benchmark)),
qf AS (SELECT qid, n, st, {S.top(S.distinct(f"list_filter(st, lambda t: NOT {S.in_list('t', K.QUERY_STOPWORDS)})"), 8)} AS terms
       FROM qt)"""


@query(
    "query_terms",
    f"""WITH {_QT} SELECT qid, {S.joined('terms')} AS terms, {S.joined(S.top(S.distinct('st'), 8))} AS route,
    {S.joined(S.top(S.distinct(f"list_filter({S.tokens('n')}, lambda t: length(t) > 2)"), 12))} AS plain FROM qf""",
)
def query_terms(spark, sf):
    q = A.questions(spark, sf).withColumn("n", X.normalize_text("question", compat=True))
    return q.select(
        "qid", bar(X.query_terms("n")).alias("terms"), bar(X.route_terms("n")).alias("route"),
        bar(X.plain_terms(X.simple_norm("question"))).alias("plain"),
    )


_SPEC = f"""sp0 AS (SELECT *, list_filter(terms, lambda t: length(t) >= 4 AND NOT {S.in_list('t', K.ANCHOR_STOPWORDS)}) AS g,
      list_filter(terms, lambda t: length(t) >= 4 AND NOT {S.in_list('t', K.SPECIFICITY_STOPWORDS)}) AS s2 FROM qf),
sp AS (SELECT *, CASE WHEN len(g) > 0 THEN {S.top(S.longest_first('g'), 4)} ELSE s2[1:2] END AS specific FROM sp0),
an0 AS (SELECT *, {S.longest_first('specific')} AS rk FROM sp),
an AS (SELECT *, CASE WHEN len(list_filter(rk, lambda t: length(t) >= 8)) > 0
      THEN list_filter(rk, lambda t: length(t) >= 8)[1:2] ELSE rk[1:2] END AS anchors FROM an0)"""


@query(
    "anchor_terms",
    f"""WITH {_QT}, {_SPEC},
    pr AS (SELECT qid, {S.distinct('st')} AS d FROM qt),
    pr2 AS (SELECT qid, list_filter(d, lambda t: length(t) >= 4 AND NOT {S.in_list('t', K.PRIORITY_STOPWORDS)}) AS g,
            list_filter(d, lambda t: length(t) >= 5) AS l5 FROM pr),
    pr3 AS (SELECT qid, CASE WHEN len(g) > 0 THEN g ELSE l5 END AS c FROM pr2)
    SELECT an.qid, {S.joined(S.top(S.longest_first('c'), 4))} AS priority, {S.joined('specific')} AS specific,
           {S.joined('anchors')} AS anchors FROM an JOIN pr3 USING (qid)""",
)
def anchor_terms(spark, sf):
    q = A.questions(spark, sf).withColumn("terms", X.query_terms(X.normalize_text("question", compat=True)))
    q = q.withColumn("specific", X.specific_terms(F.col("terms")))
    return q.select(
        "qid", bar(X.priority_terms("question")).alias("priority"), bar("specific").alias("specific"),
        bar(X.anchor_terms(F.col("specific"))).alias("anchors"),
    )


@query(
    "keyword_score",
    f"""WITH p AS (SELECT u.conv_id, u.turn, {S.norm('u.text')} AS un, {S.norm('a.text')} AS h
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant'),
    t AS (SELECT conv_id, turn, h,
      {S.top(S.distinct(f"list_filter({S.stems('un')}, lambda t: NOT {S.in_list('t', K.QUERY_STOPWORDS)})"), 8)} AS terms FROM p)
    SELECT conv_id, turn, round({S.kw('terms', 'h')}, 6) AS score, {S.coverage('terms', 'h')} AS coverage,
           {S.frequency('terms', 'h')}::BIGINT AS tf FROM t""",
)
def keyword_score(spark, sf):
    c = A.texts(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", X.query_terms(X.normalize_text("text")).alias("terms"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), X.normalize_text("text").alias("h"))
    j = u.join(a, ["conv_id", "turn"])
    return j.select(
        "conv_id", "turn", r6(X.keyword_score(F.col("terms"), F.col("h"))).alias("score"),
        big(X.term_coverage(F.col("terms"), F.col("h"))).alias("coverage"),
        big(X.term_frequency(F.col("terms"), F.col("h"))).alias("tf"),
    )


@query(
    "fingerprints",
    f"""WITH {S.CLAUSE} SELECT clause_id, md5(array_to_string(list_sort(list_distinct({S.stems(S.fold('text'))})), ' ')) AS fp
    FROM clause""",
)
def fingerprints(spark, sf):
    return A.clauses(spark, sf).select("clause_id", F.md5(F.array_join(X.fingerprint("text"), " ")).alias("fp"))


@query(
    "clause_number",
    f"""WITH t AS (SELECT p_partkey, '0' || p_size || '.' || lpad((p_partkey % 13)::VARCHAR, 2, '0') || ') ' || p_name AS s FROM part),
    n AS (SELECT p_partkey, regexp_extract(s, {S.q(K.LEADING_NUMBER)}, 1) AS lead FROM t)
    SELECT p_partkey, lead AS number,
      array_to_string(list_transform(string_split(lead, '.'), lambda x: x::INT::VARCHAR), '.') AS canonical FROM n""",
)
def clause_number(spark, sf):
    s = F.concat(
        F.lit("0"), F.col("p_size").cast("string"), F.lit("."),
        F.lpad((F.col("p_partkey") % 13).cast("string"), 2, "0"), F.lit(") "), F.col("p_name"),
    )
    p = A.table(spark, sf, "part").select("p_partkey", s.alias("s"))
    return p.select(
        "p_partkey", X.clause_number("s").alias("number"), X.canonical_clause_number(X.clause_number("s")).alias("canonical")
    )


_REFQ_ALL = f"""rq AS (SELECT qid::VARCHAR AS qid, text FROM ref_q UNION ALL SELECT 'b' || item_id, text FROM benchmark),
rn AS (SELECT qid, text, {S.lsq('text')} AS n FROM rq),
rc AS (SELECT *, list_transform(list_zip(regexp_extract_all(n, {S.q(K.DOC_CODE)}, 1), regexp_extract_all(n, {S.q(K.DOC_CODE)}, 2)),
       lambda z: upper(z[1]) || ' ' || z[2]) AS codes0 FROM rn),
rd AS (SELECT *, {S.ci_distinct('codes0')} AS codes FROM rc)"""


def _either(pattern: str, n: str = "n") -> str:
    return (
        f"list_transform(list_zip(regexp_extract_all({n}, {S.q(pattern)}, 1), regexp_extract_all({n}, {S.q(pattern)}, 2)), "
        "lambda z: CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END)"
    )


REFS = f"""{S.REF_Q}, {_REFQ_ALL},
re AS (SELECT *, list_concat({_either(K.CLAUSE_REF)}, list_filter(regexp_extract_all(n, {S.q(K.BARE_CLAUSE)}, 1),
        lambda b: NOT list_contains(list_transform(codes, lambda c: split_part(split_part(c, ' ', 2), '-', 1)), b))) AS cl0,
      {_either(K.CHAPTER_REF)} AS ch0, {_either(K.TABLE_REF)} AS tb0, {_either(K.APPENDIX_REF)} AS ap0 FROM rd),
refs AS (SELECT qid, text, n, codes, {S.ci_distinct('cl0')} AS clauses, {S.ci_distinct('ch0')} AS chapters,
      {S.ci_distinct('tb0')} AS tables, {S.ci_distinct('ap0')} AS appendices,
      len(codes) + len(cl0) + len(ch0) + len(tb0) + len(ap0) > 0 AS has_explicit FROM re)"""


def ref_table(spark, sf):
    """Reference questions and library questions in one table."""
    a = A.reference_questions(spark, sf).select(F.col("qid").cast("string").alias("qid"), "text")
    b = A.questions(spark, sf).select(F.concat(F.lit("b"), F.col("qid").cast("string")).alias("qid"), F.col("question").alias("text"))
    return a.unionByName(b)


@query("doc_codes", f"WITH {S.REF_Q}, {_REFQ_ALL} SELECT qid, {S.joined('codes')} AS codes, lower(replace({S.joined('codes')}, ' ', '')) AS keys FROM rd")
def doc_codes(spark, sf):
    t = ref_table(spark, sf).withColumn("codes", R.doc_codes("text"))
    return t.select("qid", bar("codes").alias("codes"), R.code_key(bar("codes")).alias("keys"))


@query(
    "exact_refs",
    f"""WITH {REFS} SELECT qid, {S.joined('codes')} AS codes, {S.joined('clauses')} AS clauses, {S.joined('chapters')} AS chapters,
    {S.joined('tables')} AS tables, {S.joined('appendices')} AS appendices, has_explicit FROM refs""",
)
def exact_refs(spark, sf):
    t = ref_table(spark, sf).withColumn("r", R.exact_refs("text"))
    return t.select(
        "qid", bar("r.document_codes").alias("codes"), bar("r.clause_numbers").alias("clauses"),
        bar("r.chapter_numbers").alias("chapters"), bar("r.table_numbers").alias("tables"),
        bar("r.appendix_numbers").alias("appendices"), F.col("r.has_explicit").alias("has_explicit"),
    )


@query(
    "table_ref_match",
    f"""WITH b AS (SELECT p_partkey, p_size, 'X ' || p_size || '-' || (p_partkey % 3) || '-jadval bor, ' || p_name AS txt,
        ' ' || p_size || CASE p_partkey % 3 WHEN 0 THEN ',' WHEN 1 THEN '-' ELSE ' ' END || (p_partkey % 3) || ' ' AS raw FROM part),
    k AS (SELECT *, trim(regexp_replace(lower(trim(raw)), '[\\s,\\-]+', '.', 'g'), '.') AS key FROM b)
    SELECT p_partkey, key, array_to_string(list_filter({S.distinct("[key, replace(key,'.','-'), replace(key,'.',','), replace(key,'.','')]")}, lambda v: v <> ''), '|') AS variants,
      trim(raw) || '-jadval' AS label,
      regexp_matches({S.norm('txt')}, '(?i)\\b' || replace(key, '.', '[\\s,.\\-]*') || '\\s*[-.]?\\s*jadval(?:da|ni|ga|dan|ning|lar)?\\b') AS mentioned,
      key = p_size::VARCHAR || '.' || (p_partkey % 2) AS same FROM k""",
)
def table_ref_match(spark, sf):
    size, m = F.col("p_size").cast("string"), (F.col("p_partkey") % 3).cast("string")
    sep = F.when(F.col("p_partkey") % 3 == 0, ",").when(F.col("p_partkey") % 3 == 1, "-").otherwise(" ")
    p = A.table(spark, sf, "part").select(
        "p_partkey", "p_size", F.concat(F.lit("X "), size, F.lit("-"), m, F.lit("-jadval bor, "), F.col("p_name")).alias("txt"),
        F.concat(F.lit(" "), size, sep, m, F.lit(" ")).alias("raw"),
    )
    other = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 2).cast("string"))
    return p.select(
        "p_partkey", R.table_key("raw").alias("key"), bar(R.table_variants("raw")).alias("variants"),
        R.table_label("raw").alias("label"), R.table_mentioned(X.normalize_text("txt"), F.col("raw")).alias("mentioned"),
        (R.table_key("raw") == R.table_key(other)).alias("same"),
    )


@query(
    "numeric_evidence",
    f"""WITH {S.NORM_Q}, {S.evidence_cte('norm_q')}
    SELECT qid, i - 1 AS pos, raw, value, unit, round(metres, 6) AS metres, instr(n, raw) - 1 AS start_pos,
           instr(n, raw) - 1 + length(raw) AS end_pos FROM ev""",
)
def numeric_evidence(spark, sf):
    e = A.norm_questions(spark, sf).select("qid", F.posexplode(N.evidence("text")).alias("pos", "e"))
    return e.select(
        "qid", big(F.col("pos")).alias("pos"), F.col("e.raw").alias("raw"), F.col("e.value").alias("value"),
        F.col("e.unit").alias("unit"), r6(F.col("e.metres")).alias("metres"), big(F.col("e.start")).alias("start_pos"),
        big(F.col("e.end")).alias("end_pos"),
    )


@query(
    "numeric_profile",
    f"""WITH {S.NORM_Q}, {S.REF_Q}, src AS (SELECT 'n' || qid AS qid, text FROM norm_q UNION ALL SELECT 'r' || qid, text FROM ref_q),
    {S.profile_cte('src')} SELECT qid, is_numeric, comparator, {S.joined('props')} AS props, {S.joined(S.distinct('hints'))} AS hints,
    len(vals) AS n_values FROM prof""",
)
def numeric_profile(spark, sf):
    a = A.norm_questions(spark, sf).select(F.concat(F.lit("n"), F.col("qid").cast("string")).alias("qid"), "text")
    b = A.reference_questions(spark, sf).select(F.concat(F.lit("r"), F.col("qid").cast("string")).alias("qid"), "text")
    t = a.unionByName(b).withColumn("p", N.query_profile("text"))
    return t.select(
        "qid", F.col("p.is_numeric").alias("is_numeric"), F.col("p.comparator").alias("comparator"),
        bar("p.property_terms").alias("props"), bar("p.unit_hints").alias("hints"), big(F.size("p.values")).alias("n_values"),
    )


@query(
    "numeric_score",
    f"""WITH {S.NORM_Q}, {S.profile_cte('norm_q')},
    pairs AS (SELECT a.qid, b.qid AS tid, b.text FROM norm_q a JOIN norm_q b ON b.qid = a.qid + 1), {S.match_cte('prof', 'pairs')}
    SELECT p.qid, round(coalesce(m.score, 0), 6) AS score, m.value, m.unit, coalesce(m.cnt, 0) AS n
    FROM pairs p LEFT JOIN nm m ON m.pair = p.qid || '#' || p.tid""",
)
def numeric_score(spark, sf):
    n = A.norm_questions(spark, sf)
    q = n.select("qid", N.query_profile("text").alias("p"))
    t = n.select((F.col("qid") - 1).alias("qid"), "text")
    m = q.join(t, "qid").withColumn("m", N.match(F.col("p"), F.col("text")))
    return m.select(
        "qid", r6(F.col("m.score")).alias("score"), F.col("m.value").alias("value"), F.col("m.unit").alias("unit"),
        big(F.col("m.evidence_count")).alias("n"),
    )


@query(
    "numeric_format",
    r"""SELECT l_orderkey, l_linenumber, replace(regexp_replace(regexp_replace(printf('%.3f', l_extendedprice / 10), '0+$', ''), '\.$', ''), '.', ',')
    || CASE l_linenumber % 2 WHEN 0 THEN '%' ELSE ' mm' END AS shown FROM lineitem""",
)
def numeric_format(spark, sf):
    unit = F.when(F.col("l_linenumber") % 2 == 0, "%").otherwise("mm")
    li = A.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", N.format_value(F.col("l_extendedprice") / 10, unit).alias("shown"))


_INTENT = f"""ip AS (SELECT qid::VARCHAR AS qid, text FROM refs), {S.profile_cte('ip', 'pf')},
intents AS (SELECT r.qid, r.text, r.n, r.codes, r.clauses, r.chapters, r.tables, r.appendices, r.has_explicit, pf.is_numeric,
  CASE WHEN {S.any_of('r.n', K.COMPARE_TERMS)} AND (len(codes) >= 2 OR {S.any_of('r.n', (' va ', ' bilan '))}) THEN 'compare_documents'
       WHEN len(tables) > 0 OR len(appendices) > 0 OR {S.any_of('r.n', K.INTENT_TABLE_TERMS)} THEN 'table_lookup'
       WHEN {S.any_of('r.n', K.IMAGE_TERMS)} THEN 'image_lookup'
       WHEN len(clauses) > 0 AND ({S.any_of('r.n', K.BAND_TERMS)} OR has_explicit) THEN 'exact_band_reference'
       WHEN len(string_split(r.n, ' ')) >= 4 AND NOT has_explicit THEN 'topical_search' ELSE 'general_synthesis' END AS intent
  FROM refs r JOIN pf USING (qid))"""


@query(
    "intent",
    f"""WITH {REFS}, {_INTENT} SELECT qid, intent,
    CASE intent WHEN 'compare_documents' THEN 0.9 WHEN 'table_lookup' THEN CASE WHEN len(tables) + len(appendices) > 0 THEN 0.88 ELSE 0.72 END
      WHEN 'image_lookup' THEN 0.82 WHEN 'exact_band_reference' THEN 0.9 WHEN 'topical_search' THEN CASE WHEN is_numeric THEN 0.76 ELSE 0.7 END
      ELSE 0.6 END::DOUBLE AS confidence,
    CASE intent WHEN 'compare_documents' THEN 'compare_terms_detected' WHEN 'table_lookup' THEN 'table_reference_or_terms'
      WHEN 'image_lookup' THEN 'image_terms_detected' WHEN 'exact_band_reference' THEN 'clause_reference_detected'
      WHEN 'topical_search' THEN CASE WHEN is_numeric THEN 'numeric_norm_query' ELSE 'descriptive_query_without_exact_reference' END
      ELSE 'default_fallback' END AS reason, is_numeric AS numeric_query FROM intents""",
)
def intent(spark, sf):
    t = ref_table(spark, sf).withColumn("r", R.exact_refs("text")).withColumn("i", I.classify("text", F.col("r")))
    return t.select("qid", "i.intent", "i.confidence", "i.reason", "i.numeric_query")


def _gate_sql(src: str) -> str:
    n = "n"
    first = lambda p: f"(len({_either(p)}) > 0)"
    listing = S.any_of(n, K.DOCUMENT_LIST_PHRASES)
    word = f"regexp_matches(n, {S.q('(?i)' + K.TABLE_WORD)})"
    return f"""g0 AS (SELECT qid, text, {S.norm('text')} AS n FROM {src}),
g1 AS (SELECT *, len(regexp_extract_all(n, {S.q(K.DOC_CODE)}, 1)) > 0 AS has_doc, {first(K.TABLE_REF)} AS has_table,
       {first(K.APPENDIX_REF)} AS has_app, {word} AS word, {listing} AS listing FROM g0),
gp AS (SELECT qid, text FROM g0), {S.profile_cte('gp', 'gpf')},
gates AS (SELECT g1.qid, regexp_matches(g1.n, {S.q(K.GREETING)}) AS greeting, {S.any_of('g1.n', K.DOMAIN_KEYWORDS)} AS in_domain,
  {S.any_of('g1.n', K.OUT_OF_SCOPE_KEYWORDS)} AS out_of_scope,
  ((has_doc AND (has_table OR has_app)) OR ((has_table OR has_app) AND word) OR {S.any_of('g1.n', K.TABLE_HINTS)}) AS table_request,
  NOT contains(text, '?') AND NOT {S.any_of('g1.n', K.TABLE_QUESTION_HINTS)} AS direct_lookup,
  (has_table OR has_app) AS explicit_table, word AND NOT (has_table OR has_app) AS missing_table_number,
  regexp_matches(text, {S.q('(?i)' + K.CLAUSE_LOOKUP)}) AS clause_lookup,
  NOT listing AND {S.any_of('g1.n', K.ROW_TABLE_TERMS)} AND {S.any_of('g1.n', K.ROW_FOCUS_TERMS)} AND {S.any_of('g1.n', K.ROW_QUESTION_TERMS)} AS row_priority,
  ((has_doc AND (has_table OR has_app)) OR ((has_table OR has_app) AND word) OR {S.any_of('g1.n', K.INTENT_TABLE_TERMS)}) AS table_intent,
  {S.any_of('g1.n', K.NUMERIC_REQUIREMENT_HINTS)} OR is_numeric AS numeric_requirement, listing AS document_list,
  CASE WHEN listing THEN NULL
       WHEN regexp_matches(g1.n, '\\b(qancha|necha|minimal|maksimal|me''yor|meyor)\\b') AND NOT regexp_matches(g1.n, '\\d') THEN 'missing_parameter'
       WHEN {S.any_of('g1.n', ('taqqos', 'solishtir', 'farqi'))} AND NOT contains(g1.n, ' va ') THEN 'missing_comparison_target'
       WHEN {S.any_of('g1.n', ('eshik', 'deraza', 'zina', 'evakuatsiya'))} AND NOT {S.any_of('g1.n', ('turar joy', 'jamoat', 'sanoat', 'ombor'))} THEN 'missing_use_case' END AS missing_case
  FROM g1 JOIN gpf USING (qid))"""


@query(
    "query_gates",
    f"""WITH {S.REF_Q}, gsrc AS (SELECT qid::VARCHAR AS qid, text FROM ref_q UNION ALL
      SELECT conv_id || '/' || turn, CASE WHEN turn % 3 = 0 THEN 'Salom, ' ELSE '' END || text || CASE WHEN conv_id % 4 = 0 THEN ' eshik talab jadval qaysi' ELSE '' END
      FROM conversations WHERE role = 'user'), {_gate_sql('gsrc')} SELECT * FROM gates""",
)
def query_gates(spark, sf):
    c = A.texts(spark, sf, "conversations").where("role = 'user'")
    u = c.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.concat(
            F.when(F.col("turn") % 3 == 0, "Salom, ").otherwise(""), F.col("text"),
            F.when(F.col("conv_id") % 4 == 0, " eshik talab jadval qaysi").otherwise(""),
        ).alias("text"),
    )
    t = A.reference_questions(spark, sf).select(F.col("qid").cast("string").alias("qid"), "text").unionByName(u)
    return t.select("qid", *[c.alias(n) for n, c in I.gates("text").items()])


def _lang_sql() -> str:
    tk = f"regexp_extract_all(lower(t), {S.q(K.LATIN_WORD)})"
    hits = lambda ws: f"len(list_filter(tk, lambda x: {S.in_list('x', ws)}))"
    return f"""l0 AS (SELECT doc_id, {S.ends('text')} AS t FROM documents),
l1 AS (SELECT doc_id, t, {tk} AS tk, len(regexp_extract_all(t, '[\\x{{AC00}}-\\x{{D7AF}}]')) AS ko,
   len(regexp_extract_all(t, '[\\x{{0400}}-\\x{{04FF}}]')) AS cy, len(regexp_extract_all(t, '[\\x00-\\x7F]')) AS asc_n, length(t) AS total FROM l0),
l2 AS (SELECT *, {hits(K.UZ_HINTS)} AS uz, {hits(K.EN_HINTS)} AS en, {S.any_of('t', K.UZ_APOSTROPHE_MARKS)} AS marks,
   asc_n / greatest(total, 1) AS ratio FROM l1)"""


@query(
    "detect_lang",
    f"""WITH {_lang_sql()} SELECT doc_id,
    CASE WHEN t = '' THEN 'uz' WHEN ko > 0 AND ko >= cy THEN 'ko' WHEN cy > 0 THEN 'ru' WHEN len(tk) = 0 THEN 'uz'
      WHEN marks OR uz >= 2 THEN 'uz' WHEN en >= 2 OR (en >= 1 AND ratio > 0.98 AND len(tk) >= 4 AND uz = 0) THEN 'en' ELSE 'uz' END AS detected,
    (total > 0 AND ko = 0 AND cy = 0 AND len(tk) >= 3 AND en >= 1 AND ratio > 0.95) AS strong_english,
    CASE WHEN t = '' THEN true WHEN ko > 0 OR cy > 0 THEN false WHEN marks OR uz >= 2 THEN true WHEN en >= 2 AND uz = 0 THEN false
      ELSE uz >= en END AS looks_uz FROM l2""",
)
def detect_lang(spark, sf):
    d = A.texts(spark, sf, "documents").select("doc_id", X.squeeze_ends("text").alias("t"))
    return d.select(
        "doc_id", L.detect("t").alias("detected"), L.strong_english("t").alias("strong_english"),
        L.looks_like("t", F.lit("uz")).alias("looks_uz"),
    )


def _expansion_sql() -> str:
    base = S.squeeze("r.text")
    strip1 = r"regexp_replace(nb, '(?i)\b(shnq|qmq|kmk|snip)\s*[0-9][0-9.\-]*\b', '', 'g')"
    strip2 = (
        r"regexp_replace(" + strip1 + r", '(?i)\b(?:band|modda)\s*[-.:]?\s*\d+(?:\.\d+){0,3}\b|\b\d+(?:\.\d+){0,3}\s*[-.:]?\s*(?:band|modda)\b', '', 'g')"
    )
    d, c = "len(codes) > 0", "len(clauses) > 0"
    items = [
        "base", "CASE WHEN bare <> '' AND bare <> nb THEN bare END",
        f"CASE WHEN {d} AND {c} THEN base || ' band matni' END",
        f"CASE WHEN {d} AND NOT {c} THEN base || ' band talabi' END",
        f"CASE WHEN {d} AND NOT {c} THEN base || ' me''yor talabi' END",
        f"CASE WHEN NOT ({d}) THEN base || ' shnq band talabi' END",
        f"CASE WHEN NOT ({d}) THEN base || ' normativ band' END",
        "CASE WHEN is_numeric AND comparator = 'min' THEN base || ' kamida me''yor' END",
        "CASE WHEN is_numeric AND comparator = 'min' THEN base || ' minimal talab band' END",
        "CASE WHEN is_numeric AND comparator = 'max' THEN base || ' ko''pi bilan me''yor' END",
        "CASE WHEN is_numeric AND comparator = 'max' THEN base || ' maksimal talab band' END",
        "CASE WHEN is_numeric AND comparator NOT IN ('min','max') THEN base || ' sonli norma' END",
        "CASE WHEN is_numeric AND len(props) > 0 THEN base || ' ' || array_to_string(props[1:2], ' ') || ' normasi' END",
    ]
    for word, variants in K.SYNONYMS.items():
        items += [f"CASE WHEN contains(nb, {S.q(word)}) THEN replace(nb, {S.q(word)}, {S.q(v)}) END" for v in variants]
    return f"""x0 AS (SELECT r.*, {base} AS base, {S.simple('r.text')} AS nb FROM refs r),
x1 AS (SELECT x0.*, {S.squeeze(strip2)} AS bare, pf2.is_numeric, pf2.comparator, pf2.props FROM x0 JOIN pf2 USING (qid)),
x2 AS (SELECT qid, list_transform(list_filter([{', '.join(items)}], lambda v: v IS NOT NULL), lambda v: {S.squeeze('v')}) AS xs FROM x1),
expanded AS (SELECT qid, {S.top(S.ci_distinct('xs'), 6)} AS xs FROM x2)"""


@query(
    "query_expansion",
    f"""WITH {REFS}, rt AS (SELECT qid, text FROM refs), {S.profile_cte('rt', 'pf2')}, {_expansion_sql()}
    SELECT qid, generate_subscripts(xs, 1) - 1 AS pos, unnest(xs) AS phrasing FROM expanded""",
)
def query_expansion(spark, sf):
    t = ref_table(spark, sf).withColumn("r", R.exact_refs("text")).withColumn("p", N.query_profile("text"))
    e = t.select("qid", F.posexplode(I.expansions("text", F.col("r"), F.col("p"))).alias("pos", "phrasing"))
    return e.select("qid", big(F.col("pos")).alias("pos"), "phrasing")


@query(
    "short_answer",
    f"""WITH a AS (SELECT conv_id, turn, {S.ends("CASE WHEN turn % 4 = 1 THEN 'Batafsil: ' || text || chr(10) || 'Qisqa qilib aytganda: ' || left(text, 90) ELSE text END")} AS t
      FROM conversations WHERE role = 'assistant'),
    b AS (SELECT *, {S.ends("regexp_extract(t, '(?is)^.*?(?:qisqa qilib aytganda:|in short:)(.*)$', 1)")} AS lab,
      trim(regexp_extract(t, '(?s)^(.*?)(?:[.!?](?:\\s|$)|$)', 1)) AS sent FROM a)
    SELECT conv_id, turn, left(CASE WHEN lab <> '' THEN lab WHEN sent <> '' THEN sent ELSE t END, 400) AS short_answer FROM b""",
)
def short_answer(spark, sf):
    labelled = F.concat(F.lit("Batafsil: "), F.col("text"), F.lit("\nQisqa qilib aytganda: "), F.left("text", F.lit(90)))
    a = A.texts(spark, sf, "conversations").where("role = 'assistant'")
    t = F.when(F.col("turn") % 4 == 1, labelled).otherwise(F.col("text"))
    return a.select("conv_id", "turn", X.short_answer(t).alias("short_answer"))


@query(
    "answer_cleanup",
    f"""WITH a AS (SELECT conv_id, turn, {S.ends("CASE WHEN turn % 4 = 1 THEN '(3) Javob: ' || text || chr(10) || '(4) Xulosa: ' || left(text, 120) WHEN turn % 4 = 3 THEN 'Details: ' || text ELSE text END")} AS t
      FROM conversations WHERE role = 'assistant'),
    b AS (SELECT conv_id, turn, {S.ends(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\(\s*3\s*\)\s*[^.\n:]*[:.]?\s*', 'Batafsil: ', 'g'), '(?i)\(\s*4\s*\)\s*[^.\n:]*[:.]?\s*', chr(10) || 'Qisqa qilib aytganda: ', 'g'), '(?i)details?\s*:', 'Batafsil:', 'g'), '(?i)in\s*short\s*:', 'Qisqa qilib aytganda:', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM a),
    c AS (SELECT conv_id, turn, CASE WHEN contains(t, 'Batafsil:') THEN t ELSE 'Batafsil: ' || t END AS t FROM b),
    d AS (SELECT conv_id, turn, CASE WHEN contains(t, 'Qisqa qilib aytganda:') THEN t ELSE t || chr(10) || 'Qisqa qilib aytganda: ' ||
       {S.ends("regexp_extract(" + S.ends("replace(t, 'Batafsil:', '')") + ", '(?s)^(.*?)(?:[.!?](?:\\s|$)|$)', 1)")} || '.' END AS t FROM c),
    e AS (SELECT conv_id, turn, {S.ends("replace(t[1:instr(t, 'Qisqa qilib aytganda:') - 1], 'Batafsil:', '')")} AS det,
       {S.ends("regexp_extract(" + S.ends("t[instr(t, 'Qisqa qilib aytganda:') + 21:]") + ", '^[^\\n\\r]*')")} AS sh FROM d),
    f AS (SELECT *, string_split({S.squeeze('sh')}, ' ') AS ws FROM e)
    SELECT conv_id, turn, md5('Batafsil: ' || det || chr(10) || 'Qisqa qilib aytganda: ' ||
       CASE WHEN len(ws) > 14 THEN trim(array_to_string(ws[1:12], ' '), ' ,;:-') || '.' ELSE sh END) AS answer_md5 FROM f""",
)
def answer_cleanup(spark, sf):
    t, turn = F.col("text"), F.col("turn")
    scaffold = F.concat(F.lit("(3) Javob: "), t, F.lit("\n(4) Xulosa: "), F.left("text", F.lit(120)))
    raw = F.when(turn % 4 == 1, scaffold).when(turn % 4 == 3, F.concat(F.lit("Details: "), t)).otherwise(t)
    a = A.texts(spark, sf, "conversations").where("role = 'assistant'")
    return a.select("conv_id", "turn", F.md5(X.cleanup_answer(raw)).alias("answer_md5"))


@query(
    "relevant_sentence",
    f"""WITH {S.NORM_Q}, b AS (SELECT qid, p_name || ' haqida. ' || text || ' Izoh: ' || p_name AS s, ' ' || p_size || ' MM ' AS ev FROM norm_q),
    c AS (SELECT qid, string_split_regex(replace(s, '. ', '.' || chr(10)), chr(10)) AS ss, lower(trim(ev)) AS ev FROM b),
    d AS (SELECT qid, ev, coalesce(list_filter(ss, lambda x: contains(lower(x), ev))[1], ss[1]) AS sentence FROM c)
    SELECT qid, sentence, 'Batafsil: ' || CASE WHEN ends_with(sentence, '.') THEN sentence ELSE sentence || '.' END || chr(10) ||
      'Qisqa qilib aytganda: ' || ev || ' (' || {S.code('qid')} || ', 3.1-band).' AS direct FROM d""",
)
def relevant_sentence(spark, sf):
    s = F.concat(F.col("p_name"), F.lit(" haqida. "), F.col("text"), F.lit(" Izoh: "), F.col("p_name"))
    ev = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" MM "))
    n = A.norm_questions(spark, sf).select("qid", s.alias("s"), ev.alias("ev"))
    return n.select(
        "qid", X.relevant_sentence("s", "ev").alias("sentence"),
        X.direct_answer(F.col("s"), F.lower(F.trim("ev")), A.code_of(F.col("qid")), F.lit("3.1")).alias("direct"),
    )


@query(
    "text_previews",
    f"""WITH m AS (SELECT conv_id, turn, text, {S.squeeze('text')} AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(t) > 220 THEN left(t, 217) || '...' ELSE t END AS preview,
      CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS title,
      {S.any_of(S.norm("text || CASE WHEN conv_id % 3 = 0 THEN ' TOPILMADI' ELSE '' END"), K.NO_ANSWER_MARKERS)} AS no_answer,
      CASE WHEN conv_id % 2 = 0 THEN 'https://x.example/' || turn || '.png' END AS image_url FROM m""",
)
def text_previews(spark, sf):
    c = A.texts(spark, sf, "conversations")
    no = F.concat(F.col("text"), F.when(F.col("conv_id") % 3 == 0, " TOPILMADI").otherwise(""))
    url = F.when(
        F.col("conv_id") % 2 == 0, F.concat(F.lit("rasm url: https://x.example/"), F.col("turn").cast("string"), F.lit(".png),; qarang"))
    ).otherwise("rasm")
    return c.select(
        "conv_id", "turn", X.preview("text", 220).alias("preview"), X.preview("text", 80).alias("title"),
        X.looks_like_no_answer(no).alias("no_answer"), X.image_url(url).alias("image_url"),
    )


def feedback_sources():
    """Two sources per vote: the cited clause and a table row."""
    def field(kind: str, **values):
        names = ("clause_number", "html_anchor", "table_number", "row_index", "appendix_number", "image_url", "title", "snippet")
        cols = {n: values.get(n, F.lit(None).cast("bigint" if n == "row_index" else "string")) for n in names}
        return F.struct(F.lit(kind).alias("type"), F.col("code").alias("shnq_code"), *[c.alias(n) for n, c in cols.items()])

    return F.array(
        field("clause", clause_number=F.col("clause_number")),
        field("table_row", table_number=(F.col("user_id") % 4).cast("string"), row_index=F.col("user_id") % 6),
        field("clause", clause_number=F.col("clause_number")),
        field("note", title=F.concat(F.lit("Izoh "), (F.col("user_id") % 2).cast("string"))),
    )


def source_ids_of(sources):
    """Distinct identity strings of an array of source structs."""
    names = ("clause_number", "html_anchor", "table_number", "row_index", "appendix_number", "image_url", "title", "snippet")
    return F.array_distinct(
        F.transform(sources, lambda s: R.source_id(s["type"], s["shnq_code"], {n: s[n] for n in names}))
    )


SRC_SQL = f"""fs AS (SELECT *, lower(replace(code, ' ', '')) AS dk FROM feedback),
fid AS (SELECT *, ['clause:' || dk || ':' || clause_number, 'table_row:' || dk || ':' || (user_id % 4) || ':' || (user_id % 6),
        'note:' || dk || ':izoh ' || (user_id % 2)] AS ids FROM fs)"""


@query(
    "source_ids",
    f"""WITH {S.FEEDBACK}, {SRC_SQL} SELECT event_id, {S.joined('ids')} AS ids,
    sha1('["' || array_to_string(list_sort(ids), '", "') || '"]') AS hash FROM fid""",
)
def source_ids(spark, sf):
    f = A.feedback_events(spark, sf).withColumn("ids", source_ids_of(feedback_sources()))
    return f.select("event_id", bar("ids").alias("ids"), R.source_hash(F.col("ids")).alias("hash"))


@query(
    "primary_source",
    f"""WITH {S.FEEDBACK} SELECT event_id, CASE WHEN user_id % 3 = 0 THEN {S.code('(user_id % 11)')} ELSE code END AS code FROM feedback""",
)
def primary_source(spark, sf):
    f = A.feedback_events(spark, sf)
    first = F.when(F.col("user_id") % 3 == 0, A.code_of(F.col("user_id") % 11)).otherwise("  ")
    codes = F.array(first, F.col("code"))
    hit = F.get(F.filter(F.transform(codes, lambda v: F.trim(v)), lambda v: v != ""), F.lit(0))
    return f.select("event_id", hit.alias("code"))


@query(
    "json_salvage",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events""",
)
def json_salvage(spark, sf):
    e, k = A.table(spark, sf, "events"), F.col("event_id") % 4
    p = F.col("props")
    raw = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Javob: "), p, F.lit(" tugadi"))).otherwise(F.lit("javob yo'q"))
    )
    s = e.select("event_id", X.json_salvage(raw).alias("j"))
    return s.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"))


@query(
    "choice_parse",
    f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN NULL WHEN 1 THEN {S.code('p_size')} ELSE {S.code('(p_size + 1)')} END AS choice FROM part""",
)
def choice_parse(spark, sf):
    k, a, b = F.col("p_partkey") % 3, A.code_of(F.col("p_size")), A.code_of(F.col("p_size") + 1)
    raw = (
        F.when(k == 0, F.concat(F.lit('```json\n{"code": "'), F.lower(b), F.lit('"}```')))
        .when(k == 1, F.concat(F.lit("Menimcha "), F.replace(a, F.lit(" "), F.lit("  ")), F.lit(" mos")))
        .otherwise('{"code": ""}')
    )
    p = A.table(spark, sf, "part").select("p_partkey", raw.alias("raw"), F.array(a, b).alias("cands"))
    return p.select("p_partkey", X.choice_parse("raw", F.col("cands")).alias("choice"))


@query(
    "localized_table",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 AND p_size % 2 = 0 THEN '<en>' || p_name WHEN p_partkey % 4 = 2 AND p_size % 2 = 0 THEN p_name
      ELSE p_name END AS html, CASE WHEN p_partkey % 4 = 2 AND p_size % 2 = 0 THEN 'ru ' || p_type ELSE p_type END AS markdown FROM part""",
)
def localized_table(spark, sf):
    p = A.table(spark, sf, "part")
    lang = F.when(F.col("p_partkey") % 4 == 1, "EN").when(F.col("p_partkey") % 4 == 2, "ru").when(F.col("p_partkey") % 4 == 3, "ko")
    even = F.col("p_size") % 2 == 0
    empty = F.lit(None).cast("string")
    variants = {
        "en": (F.when(even, F.concat(F.lit("<en>"), F.col("p_name"))), empty),
        "ru": (F.lit(" "), F.when(even, F.concat(F.lit("ru "), F.col("p_type")))),
        "ko": (empty, F.lit("  ")),
    }
    html_variants = dict(variants, ru=(empty, variants["ru"][1]))
    return p.select(
        "p_partkey", X.localized(F.col("p_name"), lang, html_variants, False).alias("html"),
        X.localized(F.col("p_type"), lang, variants, True).alias("markdown"),
    )


@query(
    "followup_flags",
    f"""WITH {S.REF_Q}, {_REFQ_ALL}, w AS (SELECT *, len(string_split(n, ' ')) AS nw FROM rd)
    SELECT qid, len(codes) > 0 AND (nw <= 8 OR (nw <= 14 AND {S.any_of('n', K.SELECTION_MARKERS)})) AS selection,
      len(codes) >= 2 AS prompt FROM w""",
)
def followup_flags(spark, sf):
    t = ref_table(spark, sf)
    prompt = F.concat(F.lit("Quyidagi SHNQ hujjatlarida uchraydi:\n1. "), F.col("text"))
    return t.select("qid", R.looks_like_selection("text").alias("selection"), R.looks_like_document_prompt(prompt).alias("prompt"))


@query(
    "clause_quality",
    f"""WITH {S.CLAUSE}, f AS (SELECT clause_id, text, {' + '.join(f"contains(lower(text), {S.q(t)})::INT" for t in K.QUALITY_TERMS)} AS terms FROM clause)
    SELECT clause_id, round(least(3, len(regexp_extract_all(text, '\\d'))) * 0.12 + terms * 0.08 + least(length(text), 900) / 900 * 0.25, 6) AS score,
      length(text) >= 40 AS useful FROM f""",
)
def clause_quality(spark, sf):
    c = A.clauses(spark, sf).select("clause_id", "text")
    return c.select("clause_id", r6(X.clause_quality(F.col("text"))).alias("score"), (F.length("text") >= 40).alias("useful"))


@query("html_to_text", "SELECT page_id, md5(" + S.squeeze("regexp_replace(html, '<[^>]+>', ' ', 'g')") + ") AS text_md5 FROM pages")
def html_to_text(spark, sf):
    p = A.texts(spark, sf, "pages")
    return p.select("page_id", F.md5(X.html_to_text(F.lit(None).cast("string"), "html")).alias("text_md5"))


@query(
    "ci_distinct",
    f"SELECT p_partkey, {S.joined(S.ci_distinct('[p_type, lower(p_type), p_brand, upper(p_brand), chr(32) || p_name, chr(32), p_type]'))} AS vals FROM part",
)
def ci_distinct(spark, sf):
    p = A.table(spark, sf, "part")
    arr = F.array("p_type", F.lower("p_type"), F.col("p_brand"), F.upper("p_brand"), F.concat(F.lit(" "), "p_name"), F.lit(" "), F.col("p_type"))
    return p.select("p_partkey", bar(X.ci_distinct(arr)).alias("vals"))


@query(
    "sentence_chunks",
    f"""WITH {S.CLAUSE}, s AS (SELECT clause_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS ss FROM clause)
    SELECT clause_id, generate_subscripts(ss, 1) AS seq, md5(unnest(ss)) AS chunk_md5 FROM s""",
)
def sentence_chunks(spark, sf):
    c = A.clauses(spark, sf)
    parts = F.filter(X.sentences("text"), lambda s: s != "")
    e = c.select("clause_id", F.posexplode(parts).alias("pos", "chunk"))
    return e.select("clause_id", (big(F.col("pos")) + 1).alias("seq"), F.md5("chunk").alias("chunk_md5"))
