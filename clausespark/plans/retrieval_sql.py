"""SQL of the retrieval pipeline, assembled per parameter set for the checking side."""

from __future__ import annotations

from clausespark import constants as K
from clausespark.plans import sql as S

MAT = "AS MATERIALIZED"
WORD = r"[\p{L}\p{N}_]+"
_HEX = "0123456789abcdef"


def bucket(t: str) -> str:
    low = f"(('0x' || sha256({t})[63:64])::INT % 128)"
    m3 = f"(list_sum(list_transform(string_split(sha256({t}), ''), lambda c: instr('{_HEX}', c) - 1)) % 3)"
    return f"({low} + 128 * ((2 * ({m3} - {low}) % 3 + 3) % 3))::BIGINT"


def sparse_cte(name: str, src: str, key: str, text: str) -> str:
    """name(key, idx, w): unit sparse vectors of a text column."""
    return f"""{name}_t {MAT} (SELECT {key}, unnest(regexp_extract_all(lower({text}), {S.q(WORD)})) AS t FROM {src}),
{name}_v {MAT} (SELECT t, {bucket('t')} AS idx FROM (SELECT DISTINCT t FROM {name}_t)),
{name}_c AS (SELECT {key}, idx, count(*)::DOUBLE AS n FROM {name}_t JOIN {name}_v USING (t) GROUP BY {key}, idx),
{name} {MAT} (SELECT {key}, idx, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM {name}_c)"""


def terms_cte(p: str, src: str) -> str:
    """{p}terms(qid, term, is_u, is_p, n_p) of src(qid, question)."""
    st = S.stems(S.fold("question"))
    return f"""{p}t0 AS (SELECT qid, {st} AS st FROM {src}),
{p}t1 AS (SELECT qid, {S.distinct('st')} AS d FROM {p}t0),
{p}t2 AS (SELECT qid, d, list_filter(d, lambda t: length(t) >= 4 AND NOT {S.in_list('t', K.PRIORITY_STOPWORDS)}) AS g,
      list_filter(d, lambda t: length(t) >= 5) AS l5 FROM {p}t1),
{p}t3 AS (SELECT qid, d, CASE WHEN len(g) > 0 THEN g ELSE l5 END AS c FROM {p}t2),
{p}t4 AS (SELECT qid, d[1:10] AS u, {S.top(S.longest_first('c'), 4)} AS pr FROM {p}t3),
{p}terms {MAT} (SELECT qid, term, list_contains(u, term) AS is_u, list_contains(pr, term) AS is_p, len(pr) AS n_p
      FROM (SELECT qid, u, pr, unnest(list_distinct(list_concat(u, pr))) AS term FROM {p}t4))"""


def inside(scope: str | None, item: str = "clause_id") -> str:
    """Join that leaves the pairs of a table (qid, clause_id), or nothing to join."""
    return f" SEMI JOIN {scope} USING (qid, {item})" if scope else ""


def lexical_cte(p: str, k: int | None, scope: str | None = None) -> str:
    """{p}lex(qid, clause_id, score, coverage, tf, rk) by scanning every clause for every term; all of them without ``k``."""
    return f"""{p}hit {MAT} (SELECT term, clause_id, (length(h) - length(replace(h, term, ''))) // length(term) AS tf
      FROM (SELECT DISTINCT term FROM {p}terms) t, hay WHERE contains(h, term)),
{p}g {MAT} (SELECT qid, clause_id, sum(CASE WHEN is_u THEN tf ELSE 0 END) AS tf, count(*) FILTER (is_u) AS coverage,
      sum(CASE WHEN is_p THEN tf ELSE 0 END) AS p_tf, count(*) FILTER (is_p) AS p_cov, max(n_p) AS n_p
      FROM {p}terms JOIN {p}hit USING (term){inside(scope)} GROUP BY qid, clause_id),
{p}ok AS (SELECT * FROM {p}g WHERE tf > 0 AND NOT (n_p > 0 AND p_cov = 0 AND coverage < 2)),
{p}ls AS (SELECT qid, clause_id, coverage, tf, round(p_cov * 3.0::DOUBLE + coverage * 1.15::DOUBLE + least(1.0, ln(1 + p_tf) * 0.45::DOUBLE)
      + least(0.6, ln(1 + tf) * 0.18::DOUBLE) + CASE WHEN n_p > 0 AND p_cov = n_p THEN 0.45 ELSE 0 END::DOUBLE, 9) AS score FROM {p}ok),
{p}lex {MAT} (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, clause_id) AS rk FROM {p}ls){f" WHERE rk <= {k}" if k else ""})"""


HAY = f"""hay {MAT} (SELECT clause_id, {S.fold("chapter_title || ' ' || text")} AS h, {S.fold('text')} AS b FROM clause)"""


def dense_cte(p: str, src: str, k: int, iv: str = "cv", item: str = "clause_id", scope: str | None = None) -> str:
    met = f"SELECT qid, {item}, round(sum(a.w * b.w), 9) AS score FROM {p}qv a JOIN {iv} b USING (idx){inside(scope, item)} GROUP BY qid, {item}"
    if scope:  # a small scope may hold fewer rows that share a word than the list has places
        met = f"""SELECT qid, {item}, coalesce(score, 0) AS score FROM (FROM {scope} SEMI JOIN {p}qv USING (qid) SEMI JOIN {iv} USING ({item})) LEFT JOIN ({met}) USING (qid, {item})"""
    return f"""{sparse_cte(p + 'qv', src, 'qid', 'question')},
{p}dd AS ({met}),
{p}dense {MAT} (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {item}) AS rk FROM {p}dd) WHERE rk <= {k})"""


def fused_cte(p: str) -> str:
    return f"""{p}fu AS (SELECT qid, clause_id, max(dr) AS dense_rank, max(ds) AS dense_score, max(lr) AS lexical_rank, max(ls) AS lexical_score FROM (
      SELECT qid, clause_id, rk AS dr, score AS ds, NULL AS lr, 0.0 AS ls FROM {p}dense UNION ALL
      SELECT qid, clause_id, NULL, 0.0, rk, score FROM {p}lex) GROUP BY qid, clause_id),
{p}fh AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 12) AS hybrid FROM {p}fu),
{p}fused {MAT} (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid DESC, clause_id) AS fr FROM {p}fh)"""


def rerank_cte(p: str, src: str, n: int, prof_src: str | None = None) -> str:
    """{p}rr(qid, clause_id, ..., rerank, overlap, rk): feature scores of the fused head."""
    return f"""{p}it {MAT} (SELECT f.qid, q.question, f.clause_id, f.hybrid, f.dense_score, f.lexical_score, c.clause_number, c.code, c.document_id,
      c.chapter_title, c.text AS snippet FROM {p}fused f JOIN {src} q USING (qid) JOIN clause c USING (clause_id) WHERE fr <= {n}),
{p}pq AS (SELECT qid, question AS text FROM {src}), {S.profile_cte(p + 'pq', p + 'prof')},
{p}pp AS (SELECT qid, clause_id AS tid, snippet AS text FROM {p}it), {S.match_cte(p + 'prof', p + 'pp', p + 'nm')},
{p}ov AS (SELECT i.*, t.d, len(list_filter(t.d, lambda x: contains(lower(i.snippet), x))) AS overlap, pr.is_numeric, coalesce(m.score, 0) AS num
      FROM {p}it i JOIN {p}t1 t USING (qid) JOIN {p}prof pr USING (qid) LEFT JOIN {p}nm m ON m.pair = i.qid || '#' || i.clause_id),
{p}rs AS (SELECT *, round(CASE WHEN len(d) > 0 THEN hybrid * 0.52 + dense_score * 0.24 + lexical_score * 0.12 + overlap / greatest(len(d), 1) * 0.12
      + CASE WHEN contains(question, clause_number) THEN 0.12 ELSE 0 END
      + CASE WHEN is_numeric THEN num * 0.22 - CASE WHEN num <= 0.01 THEN 0.03 ELSE 0 END ELSE 0 END
      + least(0.03, ln(1 + overlap) * 0.01) ELSE hybrid END, 9) AS rerank FROM {p}ov),
{p}rr {MAT} (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, clause_id) AS rk,
      list_sort(list_distinct({S.stems(S.fold('snippet'))})) AS fp FROM {p}rs)"""


def suppress_cte(p: str, k: int, rows: str = "rr", scope: str = "code") -> str:
    """{p}kept(qid, clause_id, fr): greedy near-duplicate suppression as a recursive walk over ranks."""
    return f"""{p}walk(qid, r, kept) AS (
      SELECT DISTINCT qid, 0, []::STRUCT(g VARCHAR, c VARCHAR, fp VARCHAR[])[] FROM {p}{rows}
      UNION ALL SELECT w.qid, w.r + 1, CASE WHEN len(x.fp) > 0 AND len(list_filter(w.kept, lambda y: y.g = x.{scope}
        AND len(list_intersect(y.fp, x.fp)) / greatest(len(y.fp), len(x.fp), 1) >= 0.9)) > 0 THEN w.kept
        ELSE list_append(w.kept, {{'g': x.{scope}, 'c': x.clause_id, 'fp': x.fp}}) END
      FROM {p}walk w JOIN {p}{rows} x ON x.qid = w.qid AND x.rk = w.r + 1),
{p}last AS (SELECT qid, arg_max(kept, r) AS kept FROM {p}walk GROUP BY qid),
{p}kept {MAT} (SELECT qid, unnest(kept).c AS clause_id, generate_subscripts(kept, 1) AS fr FROM {p}last),
{p}best {MAT} (SELECT r.*, k.fr AS final_rank FROM {p}{rows} r JOIN {p}kept k USING (qid, clause_id) WHERE k.fr <= {k})"""


def features_cte(p: str, src: str) -> str:
    """{p}feat(qid, question, norm, terms, specific, anchors)."""
    return f"""{p}f0 AS (SELECT qid, question, {S.norm('question')} AS n FROM {src}),
{p}f1 AS (SELECT qid, question, n, {S.stems('n')} AS st FROM {p}f0),
{p}f2 AS (SELECT qid, question, n, {S.top(S.distinct(f"list_filter(st, lambda t: NOT {S.in_list('t', K.QUERY_STOPWORDS)})"), 8)} AS terms FROM {p}f1),
{p}f3 AS (SELECT *, list_filter(terms, lambda t: length(t) >= 4 AND NOT {S.in_list('t', K.ANCHOR_STOPWORDS)}) AS g,
      list_filter(terms, lambda t: length(t) >= 4 AND NOT {S.in_list('t', K.SPECIFICITY_STOPWORDS)}) AS s2 FROM {p}f2),
{p}f4 AS (SELECT *, CASE WHEN len(g) > 0 THEN {S.top(S.longest_first('g'), 4)} ELSE s2[1:2] END AS specific FROM {p}f3),
{p}f5 AS (SELECT *, {S.longest_first('specific')} AS rk FROM {p}f4),
{p}feat {MAT} (SELECT qid, question, n AS norm, terms, specific, CASE WHEN len(list_filter(rk, lambda t: length(t) >= 8)) > 0
      THEN list_filter(rk, lambda t: length(t) >= 8)[1:2] ELSE rk[1:2] END AS anchors FROM {p}f5)"""


def calibrate_cte(p: str, src: str, asked: str | None = None) -> str:
    """{p}cand: gated and weighted clause candidates. ``asked`` maps qid to the profile used for numbers."""
    prof = f"{p}prof"
    num = "num"
    extra = ""
    if asked:
        prof = asked
        extra = (
            f"{p}pa AS (SELECT qid, clause_id AS tid, snippet AS text FROM {p}best), {S.match_cte(asked, p + 'pa', p + 'na')},\n"
        )
    join = f"LEFT JOIN {p}na m ON m.pair = b.qid || '#' || b.clause_id" if asked else ""
    num = "coalesce(m.score, 0)" if asked else "b.num"
    return f"""{features_cte(p, src)},
{extra}{p}h AS (SELECT b.qid, b.question, b.clause_id, b.snippet, b.code, b.document_id, b.clause_number, b.chapter_title, b.rerank, b.hybrid,
      b.dense_score AS sem, b.lexical_score, {num} AS numv, pr.is_numeric AS asked_numeric, f.terms, f.specific, f.anchors, {S.norm('b.snippet')} AS h
      FROM {p}best b JOIN {p}feat f USING (qid) JOIN {prof} pr ON pr.qid = b.qid {join}),
{p}k AS (SELECT *, {S.kw('terms', 'h')} AS k1, {S.kw('specific', 'h')} AS k2, {S.kw('anchors', 'h')} AS k3,
      coalesce(nullif(rerank, 0), nullif(hybrid, 0), nullif(sem, 0), nullif(lexical_score, 0), 0) AS base FROM {p}h),
{p}w AS (SELECT *, greatest(k1, k2, k3) AS kw, base * (0.35 + 0.65 * greatest(0, least(1, greatest(sem, k1, k2, k3)))) + k3 * 0.18 AS s0 FROM {p}k),
{p}z AS (SELECT *, CASE WHEN len(anchors) > 0 AND k3 <= 0 AND sem < 0.2 THEN s0 * 0.82 ELSE s0 END AS s1 FROM {p}w
      WHERE NOT (len(specific) > 0 AND k2 <= 0 AND sem < 0.18) AND NOT (len(anchors) > 0 AND k3 <= 0 AND sem < 0.14)
        AND NOT (sem < 0.02 AND kw < 0.16) AND base > 0),
{p}cand {MAT} (SELECT qid, clause_id, snippet, code, document_id, clause_number, chapter_title, round(CASE WHEN asked_numeric
      THEN s1 + numv * 0.24 - CASE WHEN numv <= 0.01 THEN 0.02 ELSE 0 END ELSE s1 END, 9) AS score,
      round(sem, 9) AS semantic, round(kw, 9) AS keyword, round(numv, 9) AS numeric FROM {p}z)"""


def hybrid_cte(p: str, src: str, dense_k=24, lex_k=24, rerank_n=40, top_k=8, asked: str | None = None, scope: str | None = None) -> str:
    return ",\n".join(
        [
            terms_cte(p, src), lexical_cte(p, lex_k, scope), dense_cte(p, src, dense_k, scope=scope), fused_cte(p), rerank_cte(p, src, rerank_n),
            suppress_cte(p, top_k), calibrate_cte(p, src, asked),
        ]
    )


BASE = f"""{S.CLAUSE}, {HAY}, {sparse_cte('cv', 'clause', 'clause_id', 'text')},
question AS (SELECT item_id AS qid, text AS question FROM benchmark)"""
