"""Queries of searches and routes inside scopes.

Every third question searches everything, the others a few documents or a whole category.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.operators import candidates as C
from clausespark.operators import lexical
from clausespark.operators.scope import Scopes
from clausespark.plans import retrieval_sql as P
from clausespark.plans import sql as S
from clausespark.plans.answer_queries import ROUTE_SQL, ROUTES, routed
from clausespark.plans.registry import query
from clausespark.plans.retrieval_queries import _discovery_sql, _library, _with_asked
from clausespark.sources import adapters as A

big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)

#: scoped(qid, clause_id): what each question may use.
_SCOPED = f"""{S.DOCUMENT}, picked AS (
   SELECT qid, code FROM question JOIN document ON qid % 3 = 1 AND document_id % 40 = qid % 40
   UNION SELECT qid, d.code FROM question JOIN documents o ON qid % 3 = 2 AND o.doc_id = qid % 20 JOIN document d ON d.category_code = o.source),
scoped {P.MAT} (SELECT qid, clause_id FROM question, clause WHERE qid % 3 = 0 UNION SELECT qid, clause_id FROM picked JOIN clause USING (code))"""


def library_scopes(spark, sf) -> Scopes:
    """Scopes of the library questions: every fortieth document, or the category of one document."""
    q, d = A.questions(spark, sf).select("qid"), A.documents(spark, sf)
    shared = q.where("qid % 3 = 1").select("qid", F.concat(F.lit("every-"), (F.col("qid") % 40).cast("string")).alias("scope"))
    # the questions of one category share its scope; a question whose document is missing has an empty one
    owner = d.select((F.col("document_id")).alias("owner"), "category_code")
    mine = q.where("qid % 3 = 2").withColumn("owner", F.col("qid") % 20).join(owner, "owner", "left")
    mine = mine.select("qid", F.concat(F.lit("category-"), F.coalesce("category_code", F.lit(""))).alias("scope"))
    every = d.select(F.concat(F.lit("every-"), (F.col("document_id") % 40).cast("string")).alias("scope"), "code")
    category = d.select(F.concat(F.lit("category-"), "category_code").alias("scope"), "code")
    return Scopes(shared.unionByName(mine), every.unionByName(category))


@query(
    "scoped_lexical",
    f"""WITH {P.BASE}, {_SCOPED}, {P.terms_cte('a', 'question')}, {P.lexical_cte('a', 24, 'scoped')}
    SELECT qid, clause_id, round(score, 6) AS score, coverage::BIGINT AS coverage, tf::BIGINT AS tf, rk AS rank FROM alex""",
)
def scoped_lexical(spark, sf):
    hits = lexical.retrieve(A.questions(spark, sf), A.clauses(spark, sf), scopes=library_scopes(spark, sf))
    return hits.select(
        "qid", "clause_id", r6(F.col("lexical_score")).alias("score"), big(F.col("coverage")).alias("coverage"),
        big(F.col("tf")).alias("tf"), F.col("lexical_rank").alias("rank"),
    )


@query(
    "scoped_dense",
    f"""WITH {P.BASE}, {_SCOPED}, {P.dense_cte('a', 'question', 24, scope='scoped')} SELECT qid, clause_id, round(score, 6) AS score, rk AS rank FROM adense""",
)
def scoped_dense(spark, sf):
    hits = C.dense_list(A.questions(spark, sf), A.clauses(spark, sf), K.DENSE_K, library_scopes(spark, sf))
    return hits.select("qid", "clause_id", r6(F.col("dense_score")).alias("score"), F.col("dense_rank").alias("rank"))


@query(
    "scoped_hybrid",
    f"""WITH RECURSIVE {P.BASE}, {_SCOPED}, {P.hybrid_cte('a', 'question', scope='scoped')}
    SELECT qid, clause_id, code, round(score, 6) AS score, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword FROM acand""",
)
def scoped_hybrid(spark, sf):
    found = C.hybrid(A.questions(spark, sf), A.clauses(spark, sf), scopes=library_scopes(spark, sf))
    return found.select("qid", "clause_id", "code", *[r6(F.col(c)).alias(c) for c in ("score", "semantic", "keyword")])


@query("scoped_discovery", _with_asked(_discovery_sql("scoped")).replace(f"{P.BASE},", f"{P.BASE}, {_SCOPED},", 1))
def scoped_discovery(spark, sf):
    c, q, s = C.indexed(A.clauses(spark, sf)), _library(spark, sf), library_scopes(spark, sf)
    d = C.discover(q, c, C.hybrid(q.select("qid", "question"), c, scopes=s), s, q.where("qid % 6 = 1"))
    return d.select("qid", "clause_id", r6(F.col("score")).alias("score"))


_GIVEN = f"""given0 AS (SELECT qid, unnest([{S.code('(qid % 7)')}, ' ' || lower({S.code('(qid % 7)')}), {S.code('(qid % 11)')}, ' ']) AS code, unnest([0, 1, 2, 3]) AS pos
   FROM question WHERE qid % 4 = 1),
given AS (SELECT qid, code, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rank FROM (
   SELECT qid, min_by(trim(code), pos) AS code, min(pos) AS pos FROM given0 WHERE trim(code) <> '' GROUP BY qid, lower(trim(code))))"""


@query(
    "explicit_route",
    f"""WITH {ROUTE_SQL}, {_GIVEN}
    SELECT qid, code, score, rank, selected FROM ({ROUTES}) WHERE qid % 4 <> 1 UNION ALL SELECT qid, code, NULL, rank, true FROM given""",
)
def explicit_route(spark, sf):
    q = A.questions(spark, sf).where("qid % 4 = 1")
    one, two = A.code_of(F.col("qid") % 7), A.code_of(F.col("qid") % 11)
    given = q.select("qid", F.posexplode(F.array(one, F.concat(F.lit(" "), F.lower(one)), two, F.lit(" "))).alias("pos", "code"))
    r = routed(spark, sf, given).where("rank <= 10")
    return r.select("qid", "code", r6(F.col("score")).alias("score"), "rank", "selected")
