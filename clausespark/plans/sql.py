"""SQL fragments for the checking side, written from the rules and not from the Spark plans."""

from __future__ import annotations

from clausespark import constants as K


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def in_list(expr: str, words) -> str:
    return f"({expr} IN ({', '.join(q(w) for w in words)}))"


def any_of(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(K.WS)}, ' ', 'g'))"


def ends(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q('^' + K.WS + '|' + K.WS + '$')}, '', 'g')"


def fold(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), {q(K.APOSTROPHES)}, {q(chr(39) * len(K.APOSTROPHES))})"


def norm(x: str) -> str:
    return squeeze(fold(x))


def simple(x: str) -> str:
    return squeeze(f"translate(lower(coalesce({x}, '')), '’`', {q(chr(39) * 2)})")


def lsq(x: str) -> str:
    return squeeze(f"lower(coalesce({x}, ''))")


_STEP = "^(.{4,}?)(?:" + "|".join(K.SUFFIXES) + ")$"


def stem(x: str) -> str:
    for _ in range(8):
        x = f"regexp_replace({x}, {q(_STEP)}, '\\1')"
    return x


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(K.TOKEN)})"


def stems(folded: str) -> str:
    kept = f"list_filter({tokens(folded)}, lambda t: length(t) > 2)"
    return f"list_transform({kept}, lambda t: {stem('t')})"


def distinct(xs: str) -> str:
    """Order-preserving distinct."""
    return f"list_filter({xs}, lambda v, i: list_position({xs}, v) = i)"


def ci_distinct(xs: str) -> str:
    base = f"list_filter(list_transform({xs}, lambda v: trim(v)), lambda v: v <> '')"
    keys = f"list_transform({base}, lambda v: lower(v))"
    return f"list_filter({base}, lambda v, i: list_position({keys}, lower(v)) = i)"


def longest_first(xs: str) -> str:
    keyed = f"list_transform({xs}, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})"
    return f"list_transform(list_sort({keyed}), lambda s: s.t)"


def top(xs: str, n: int) -> str:
    return f"({xs})[1:{n}]"


def joined(xs: str) -> str:
    return f"array_to_string({xs}, '|')"


def code(n: str) -> str:
    return (
        f"'SHNQ ' || (1 + {n} % 9) || '.' || lpad(({n} % 100)::VARCHAR, 2, '0') || '.' || "
        f"lpad(({n} % 13)::VARCHAR, 2, '0') || '-' || (10 + {n} % 15)"
    )


def coverage(terms: str, hay: str) -> str:
    return f"len(list_filter({terms}, lambda t: contains({hay}, t)))"


def frequency(terms: str, hay: str) -> str:
    return (
        f"coalesce(list_sum(list_transform({terms}, lambda t: "
        f"(length({hay}) - length(replace({hay}, t, ''))) // length(t))), 0)"
    )


def kw(terms: str, hay: str) -> str:
    return f"CASE WHEN len({terms}) > 0 AND {hay} <> '' THEN {coverage(terms, hay)} / len({terms}) ELSE 0.0 END"


CLAUSE = f"""clause AS (
  SELECT doc_id || ':' || pos AS clause_id, doc_id AS document_id, {code('doc_id')} AS code, pos AS clause_order,
         (1 + doc_id % 9) || '.' || pos AS clause_number, (pos - 1) // 10 + 1 AS chapter_order,
         ((pos - 1) // 10 + 1) || '-bob ' || lang AS chapter_title, txt AS text
  FROM (SELECT doc_id, lang, unnest(ls) AS txt, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)),
                     lambda x: {squeeze('x')}), lambda t: length(t) >= {K.MIN_TEXT_LEN}) AS ls FROM documents)))"""

DOCUMENT = f"""document AS (
  SELECT doc_id AS document_id, lang AS section_code, source AS category_code, {code('doc_id')} AS code,
         left({squeeze("string_split(text, chr(10))[1]")}, 80) AS title FROM documents)"""

NORM_Q = """norm_q AS (
  SELECT p_partkey AS qid, p_size, p_name,
         CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ulushi ko''pi bilan ' || p_size || ' foiz bo''lishi kerak.'
              ELSE p_name || ' kengligi kamida ' || p_size || ' mm bo''lishi kerak.' END AS text FROM part)"""

REF_Q = """ref_q AS (
  SELECT p_partkey AS qid,
    CASE WHEN p_partkey % 4 = 0 THEN 'SHNQ 2.01.05-24 bo''yicha 3.' || p_size || ' band va ' || (p_size % 9) || '-jadval'
         WHEN p_partkey % 4 = 1 THEN p_name || ' uchun ' || p_size || '-ilova va 2-bob qanday talab qo''yadi?'
         WHEN p_partkey % 4 = 2 THEN 'QMQ 2.03.' || lpad(p_size::VARCHAR, 2, '0') || ' va KMK 1.02-97 farqi: ' || p_size
              || '.' || (p_partkey % 7) || ' haqida'
         ELSE p_name || ' kengligi necha mm bo''lishi kerak? rasm ' || p_size END AS text FROM part)"""

NORM_TABLE = f"""norm_table AS (
  SELECT p_brand AS table_id, num::BIGINT AS document_id, {code('num::BIGINT')} AS code, num AS table_number,
         'Ro''yxat ' || p_brand AS title, num || '-bob materiallar' AS section_title, num::BIGINT AS table_order,
         count(*) AS row_count, min(p_partkey) AS first_part
  FROM (SELECT *, regexp_extract(p_brand, '(\\d+)', 1) AS num FROM part) GROUP BY p_brand, num)"""

NORM_ROW = """norm_row AS (
  SELECT p_partkey AS row_id, p_brand AS table_id, p_partkey AS row_index,
         regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS document_id, regexp_extract(p_brand, '(\\d+)', 1) AS table_number,
         [p_name, p_brand, p_type, p_size::VARCHAR] AS texts FROM part)"""

CELL = """cell AS (
  SELECT row_id, table_id, row_index, unnest(texts) AS text, generate_subscripts(texts, 1) AS col_index FROM norm_row)"""

MESSAGE = """message AS (
  SELECT conv_id AS session_id, turn AS ord, role, text AS content FROM conversations)"""

FEEDBACK = f"""feedback AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'up' WHEN event_type = 'error' THEN 'down' END AS vote,
         'Q' || json_extract_string(props, '$.k') || '  savol' AS question, 'a' || (user_id % 5) AS answer,
         {code('(user_id % 7)')} AS code, (1 + user_id % 3) || '.1' AS clause_number,
         CASE WHEN value > 20 THEN 'sabab ' || (event_id % 4) END AS reason
  FROM events WHERE event_type IN ('purchase', 'signup', 'error'))"""

PROCESS = """process AS (
  SELECT o_orderkey AS document_id,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'processing' END AS stage,
         CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE (o_orderkey * 1) % 101 END AS doc_html,
         CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE (o_orderkey * 3) % 101 END AS chunking,
         CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE (o_orderkey * 7) % 101 END AS row_embedding,
         CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE (o_orderkey * 11) % 101 END AS img_embedding,
         o_orderdate AS updated_at FROM orders)"""

# Requirement text parsing, shared by the numeric checks: expects columns qid, text in {src}.
_VU = q(K.VALUE_UNIT)


def evidence_cte(src: str, name: str = "ev") -> str:
    unit = (
        "CASE WHEN u IN ('cm','sm') THEN 'cm' WHEN u IN ('m','metr','metri','metra','meter','metre') THEN 'm' "
        "WHEN u IN ('foiz','%') THEN '%' ELSE u END"
    )
    return f"""{name}_n AS (SELECT qid, {simple('text')} AS n FROM {src}),
{name}_l AS (SELECT qid, n, unnest(regexp_extract_all(n, {_VU}, 0)) AS raw,
       unnest(regexp_extract_all(n, {_VU}, 1)) AS v, unnest(regexp_extract_all(n, {_VU}, 2)) AS u,
       generate_subscripts(regexp_extract_all(n, {_VU}, 0), 1) AS i FROM {name}_n),
{name} AS (SELECT qid, n, raw, i, replace(v, ',', '.')::DOUBLE AS value, {unit} AS unit,
       CASE {unit} WHEN 'mm' THEN replace(v, ',', '.')::DOUBLE / 1000.0 WHEN 'cm' THEN replace(v, ',', '.')::DOUBLE / 100.0
            WHEN 'm' THEN replace(v, ',', '.')::DOUBLE END AS metres FROM {name}_l)"""


def comparator(n: str) -> str:
    return (
        f"CASE WHEN {any_of(n, K.MIN_TERMS)} THEN 'min' WHEN {any_of(n, K.MAX_TERMS)} THEN 'max' "
        f"WHEN {any_of(n, K.EXACT_TERMS)} THEN 'exact' ELSE 'unknown' END"
    )


def properties(n: str) -> str:
    parts = [f"CASE WHEN {any_of(n, a)} THEN {q(p)} END" for p, a in K.PROPERTY_ALIASES.items()]
    return f"list_filter([{', '.join(parts)}], lambda p: p IS NOT NULL)"


def profile_cte(src: str, name: str = "prof") -> str:
    """qid, is_numeric, comparator, props, hints, vals, lens for a table (qid, text)."""
    return f"""{evidence_cte(src, name + '_ev')},
{name} AS (SELECT b.qid, b.n, {comparator('b.n')} AS comparator, {properties('b.n')} AS props,
       coalesce(e.hints, []) AS hints, coalesce(e.vals, []) AS vals, coalesce(e.lens, []) AS lens,
       ({comparator('b.n')} <> 'unknown' OR e.qid IS NOT NULL
        OR (len({properties('b.n')}) > 0 AND {any_of('b.n', K.NUMERIC_QUESTION_TERMS)})) AS is_numeric
  FROM {name}_ev_n b LEFT JOIN (
    SELECT qid, list(unit ORDER BY i) AS hints, list(value ORDER BY i) AS vals,
           list(metres ORDER BY i) FILTER (metres IS NOT NULL) AS lens FROM {name}_ev GROUP BY qid) e USING (qid))"""


def match_cte(profile: str, texts: str, name: str = "nm") -> str:
    """Best numeric match of rows (qid, tid, text) in {texts} under profiles in {profile}."""
    ev = evidence_cte(f"(SELECT qid || '#' || tid AS qid, text FROM {texts})", name + "_e")
    has_min, has_max = any_of("e.n", K.MIN_HINTS), any_of("e.n", K.MAX_HINTS)
    return f"""{ev},
{name}_s AS (SELECT e.qid AS pair, e.i, e.value, e.unit, count(*) OVER (PARTITION BY e.qid) AS cnt,
    0.12 + CASE WHEN len(p.hints) = 0 THEN 0.12 WHEN list_contains(p.hints, e.unit) THEN 0.2 ELSE 0.03 END
    + CASE WHEN len(list_filter(p.props, lambda t: contains(e.n, t))) > 0 THEN 0.18 ELSE 0.04 END
    + CASE p.comparator WHEN 'min' THEN CASE WHEN {has_min} THEN 0.22 WHEN {has_max} THEN -0.08 ELSE 0.06 END
        WHEN 'max' THEN CASE WHEN {has_max} THEN 0.22 WHEN {has_min} THEN -0.08 ELSE 0.06 END
        WHEN 'exact' THEN CASE WHEN contains(e.n, 'aniq') THEN 0.12 ELSE 0.04 END ELSE 0.04 END
    + CASE WHEN contains(e.n, 'kerak') THEN 0.08 ELSE 0 END
    + CASE WHEN len(p.lens) = 0 OR e.metres IS NULL THEN 0
           WHEN list_min(list_transform(p.lens, lambda m: abs(m - e.metres))) <= 0.001 THEN 0.18
           WHEN list_min(list_transform(p.lens, lambda m: abs(m - e.metres))) <= 0.02 THEN 0.1 ELSE -0.04 END AS s
  FROM {name}_e e JOIN {profile} p ON p.qid::VARCHAR = split_part(e.qid, '#', 1) WHERE p.is_numeric),
{name} AS (SELECT pair, greatest(0, least(1, max(s::DOUBLE))) AS score, arg_max(value, s::DOUBLE - i * 1e-9) AS value,
       arg_max(unit, s::DOUBLE - i * 1e-9) AS unit, max(cnt) AS cnt FROM {name}_s GROUP BY pair)"""

ITEM = f"""item AS (
  SELECT l_orderkey AS qid, concat_ws('-', l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS item_id,
    CASE l_linenumber % 4 WHEN 0 THEN 'table_row' WHEN 3 THEN 'image' ELSE 'clause' END AS kind,
    CASE WHEN l_linenumber % 4 IN (1, 2) THEN 'C' || (l_partkey % 500) END AS clause_id,
    CASE WHEN l_linenumber % 4 = 0 THEN 'T' || (l_partkey % 6) END AS table_id,
    CASE WHEN l_linenumber % 4 = 3 THEN 'I' || (l_partkey % 5) END AS image_id,
    CASE WHEN l_linenumber % 4 IN (1, 2) THEN 'Band ' || (1 + l_partkey % 3) || '.' || (l_partkey % 4)
         WHEN l_linenumber % 4 = 0 THEN 'Jadval ' || (l_partkey % 6) ELSE 'Rasm ' || (l_partkey % 5) END AS title,
    'Detal ' || l_partkey || ' kengligi ' || l_quantity::INT || ' mm kerak' AS snippet, {code('(l_suppkey % 5)')} AS code,
    CASE WHEN l_linenumber % 4 IN (1, 2) THEN (1 + l_partkey % 3) || '.' || (l_partkey % 4) END AS clause_number,
    CASE WHEN l_linenumber % 4 = 0 THEN (l_partkey % 6)::VARCHAR END AS table_number,
    CASE WHEN l_linenumber % 4 = 0 THEN l_linenumber::BIGINT END AS row_index,
    CASE WHEN l_linenumber % 4 = 3 THEN (l_partkey % 5)::VARCHAR END AS appendix_number, l_returnflag || '-bob' AS chapter,
    round((l_extendedprice % 50) / 100, 6) AS score, round(l_discount * 3, 6) AS semantic, round(l_tax * 5, 6) AS keyword,
    round((l_partkey % 7) / 10, 6) AS numeric FROM lineitem)"""

ITEM_Q = """item_q AS (
  SELECT o_orderkey AS qid, CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 6 + 3) || '-jadval bo''yicha talab' WHEN 1 THEN 'rasm chizma kerak'
    WHEN 2 THEN (1 + o_orderkey % 3) || '.' || (o_orderkey % 4) || ' band nima deydi' WHEN 3 THEN 'detal kengligi kamida necha mm'
    WHEN 4 THEN 'Detal haqida ' || o_orderkey || ' umumiy tushuncha bering' ELSE 'salom python haqida' END AS question,
    o_orderkey % 6 AS m FROM orders)"""
