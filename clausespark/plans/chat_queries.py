"""Queries over feedback, the answer cache and chat histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.operators import candidates as C
from clausespark.operators import chat, vector
from clausespark.operators import feedback as FB
from clausespark.plans import retrieval_sql as P
from clausespark.plans import sql as S
from clausespark.plans.registry import query
from clausespark.plans.text_queries import SRC_SQL, feedback_sources, source_ids_of
from clausespark.sources import adapters as A

big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)


def votes(spark, sf):
    return A.feedback_events(spark, sf).withColumn("source_ids", source_ids_of(feedback_sources()))


_V = f"""{S.FEEDBACK}, {SRC_SQL},
 fv AS (SELECT *, lower(replace(question, '  ', ' ')) AS nq, sha1('["' || array_to_string(list_sort(ids), '", "') || '"]') AS hash FROM fid),
 ver AS (SELECT nq AS normalized_question, hash AS source_hash, answer, count(*) AS verified_count, max(ts) AS updated_at, arg_min(question, (ts, event_id)) AS original_question,
   arg_max(code, (ts, event_id)) AS code, arg_max(clause_number, (ts, event_id)) AS clause_number, answer AS short_answer FROM fv WHERE vote = 'up' GROUP BY nq, hash, answer),
 rej AS (SELECT nq AS normalized_question, answer, count(*) AS rejected_count, max(ts) AS rejected_at, arg_max(code, (ts, event_id)) AS code,
   arg_max(reason, (ts, event_id)) FILTER (reason IS NOT NULL) AS reason, arg_max(ids, (ts, event_id)) AS ids FROM fv WHERE vote = 'down' GROUP BY nq, answer)"""


def verified(spark, sf):
    """Batch of the first half of the log merged with the second half, as two runs would do it."""
    v = votes(spark, sf).where("vote = 'up'")
    a, b = FB.verified_batch(v.where("event_id % 2 = 0")), FB.verified_batch(v.where("event_id % 2 = 1"))
    return a, b


@query("verified_upsert", f"WITH {_V} SELECT normalized_question, source_hash, answer, verified_count, updated_at, code, clause_number, short_answer FROM ver")
def verified_upsert(spark, sf):
    a, b = verified(spark, sf)
    u = FB.upsert(a, b, FB.VERIFIED_KEY, "verified_count")
    return u.select("normalized_question", "source_hash", "answer", "verified_count", "updated_at", "code", "clause_number", "short_answer")


@query("rejected_upsert", f"WITH {_V} SELECT normalized_question, answer, rejected_count, rejected_at, code, reason, {S.joined('ids')} AS ids FROM rej")
def rejected_upsert(spark, sf):
    v = votes(spark, sf).where("vote = 'down'")
    r = FB.upsert(FB.rejected_batch(v.where("event_id % 2 = 1")), FB.rejected_batch(v.where("event_id % 2 = 0")), FB.REJECTED_KEY, "rejected_count")
    return r.select("normalized_question", "answer", "rejected_count", "rejected_at", "code", "reason", F.array_join("source_ids", "|").alias("ids"))


_CQ = f"cq AS (SELECT event_id AS qid, lower('Q' || json_extract_string(props, '$.k') || ' savol') AS nq, CASE WHEN event_id % 2 = 0 THEN {S.code('(user_id % 7)')} ELSE '' END AS dc FROM events)"


@query(
    "cache_exact",
    f"""WITH {_V}, {_CQ}, j AS (SELECT qid, v.*, dc = '' OR code = dc AS fits FROM cq JOIN ver v ON v.normalized_question = cq.nq)
    SELECT qid, arg_max(answer, (verified_count, updated_at, answer, source_hash)) FILTER (fits) AS answer, arg_max(code, (verified_count, updated_at, answer, source_hash)) FILTER (fits) AS code,
      NOT bool_or(fits) AS blocked FROM j GROUP BY qid""",
)
def cache_exact(spark, sf):
    return FB.cache_exact(cache_questions(spark, sf), FB.verified_batch(votes(spark, sf).where("vote = 'up'")))


def cache_questions(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("qid"), X.normalize_text(F.concat(F.lit("Q"), F.get_json_object("props", "$.k"), F.lit("  savol"))).alias("normalized_question"),
        F.when(F.col("event_id") % 2 == 0, R.code_key(A.code_of(F.col("user_id") % 7))).otherwise("").alias("doc_key"),
    )


@query(
    "cache_semantic",
    """WITH vec AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM vec a, vec b
      WHERE b.vec_id % 2 = 0 AND (a.vec_id % 3 = 0 OR a.label = b.label)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM p) SELECT qid, id, round(score, 6) AS score FROM r WHERE rank = 1 AND score >= 0.9""",
)
def cache_semantic(spark, sf):
    v = A.vectors(spark, sf)
    scope = F.when(F.col("vec_id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array("label"))
    q = v.select(F.col("vec_id").alias("qid"), "vector", scope.alias("scope"))
    stored = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "vector", F.col("label").alias("key"))
    return FB.cache_semantic(q, stored, 64).withColumn("score", r6(F.col("score")))


@query(
    "cache_active",
    f"""WITH {_V}, {_CQ}, j AS (SELECT qid, v.*, dc = '' OR code = dc AS fits FROM cq JOIN ver v ON v.normalized_question = cq.nq WHERE verified_count > 1)
    SELECT qid, arg_max(answer, (verified_count, updated_at, answer, source_hash)) FILTER (fits) AS answer, NOT bool_or(fits) AS blocked FROM j GROUP BY qid""",
)
def cache_active(spark, sf):
    """The exact cache where answers verified only once are switched off."""
    v = FB.verified_batch(votes(spark, sf).where("vote = 'up'")).withColumn("is_active", F.col("verified_count") > 1)
    return FB.cache_exact(cache_questions(spark, sf), v).select("qid", "answer", "blocked")


@query(
    "negative_near",
    f"""WITH vec AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT a.vec_id AS qid, b.vec_id AS id, b.label FROM vec a, vec b
      WHERE b.vec_id % 2 = 0 AND a.vec_id % 2 = 1 AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.4)
    SELECT qid, lower(replace({S.code('(label % 7)')}, ' ', '')) AS code_key, round(least(0.58, sum(0.12 + least(0.28, (id % 4) * 0.05))), 6)::DOUBLE AS penalty FROM p GROUP BY 1, 2""",
)
def negative_near(spark, sf):
    """Penalties of questions that were never rejected word for word, from all rejections near enough (a low floor for these vectors)."""
    v = A.vectors(spark, sf)
    q = v.where("vec_id % 2 = 1").select(F.col("vec_id").alias("qid"), "vector", F.concat(F.lit("q"), "vec_id").alias("normalized_question"))
    k = F.col("vec_id")
    rejected = v.where("vec_id % 2 = 0").select(
        k.alias("reject_id"), F.concat(F.lit("r"), k).alias("normalized_question"), A.code_of(F.col("label") % 7).alias("code"), (1 + k % 4).alias("rejected_count"),
        F.array(F.concat(F.lit("s"), k)).alias("source_ids"), F.lit("a").alias("answer"), F.lit(None).cast("timestamp").alias("rejected_at"), "vector",
    )
    near = FB.near_rejections(q.select("qid", "vector"), rejected.select(F.col("reject_id").alias("id"), "vector"), 64, floor=0.4)
    docs, _ = FB.negative_signal(q.select("qid", "normalized_question"), rejected.drop("vector"), near)
    return docs.select("qid", "code_key", r6(F.col("penalty")).alias("penalty"))


@query(
    "doc_penalties",
    f"""WITH {_V} SELECT lower(replace(code, ' ', '')) AS code_key, round(least(0.58, sum(0.12 + least(0.28, (rejected_count - 1) * 0.05))), 6)::DOUBLE AS penalty FROM rej GROUP BY 1""",
)
def doc_penalties(spark, sf):
    r = FB.rejected_batch(votes(spark, sf).where("vote = 'down'"))
    return FB.doc_penalties(r).withColumn("penalty", r6(F.col("penalty")))


_NEG = f"""{_V}, nq AS (SELECT DISTINCT nq FROM fv),
 ns AS (SELECT n.nq AS qid, r.* FROM nq n JOIN rej r ON r.normalized_question = n.nq),
 nd AS (SELECT qid, lower(replace(code, ' ', '')) AS code_key, least(0.58, sum(0.12 + least(0.28, (rejected_count - 1) * 0.05))) AS penalty FROM ns GROUP BY 1, 2),
 nso AS (SELECT DISTINCT qid, unnest(ids) AS source_id FROM ns)"""


def negatives(spark, sf):
    v = votes(spark, sf).withColumn("normalized_question", X.normalize_text("question"))
    q = v.select(F.col("normalized_question").alias("qid"), "normalized_question").distinct()
    return FB.negative_signal(q, FB.rejected_batch(v.where("vote = 'down'").drop("normalized_question")))


@query("negative_signal", f"WITH {_NEG} SELECT qid, code_key, round(penalty, 6)::DOUBLE AS penalty, (SELECT count(*) FROM nso WHERE nso.qid = nd.qid) AS n_sources FROM nd")
def negative_signal(spark, sf):
    docs, sources = negatives(spark, sf)
    n = sources.groupBy("qid").agg(F.count(F.lit(1)).alias("n_sources"))
    return docs.join(n, "qid", "left").select("qid", "code_key", r6(F.col("penalty")).alias("penalty"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


@query(
    "apply_penalty",
    f"""WITH {_NEG}, it AS (SELECT event_id, nq AS qid, dk AS code_key, ids[1] AS source_id, (event_id % 100) / 100.0::DOUBLE AS score FROM fv),
    p AS (SELECT it.*, least(0.55, coalesce(penalty, 0) + CASE WHEN s.source_id IS NOT NULL THEN 0.16 ELSE 0 END) AS p FROM it LEFT JOIN nd USING (qid, code_key) LEFT JOIN nso s ON s.qid = it.qid AND s.source_id = it.source_id)
    SELECT event_id, round(CASE WHEN p > 0 THEN score * (1 - p) ELSE score END, 6) AS score FROM p""",
)
def apply_penalty(spark, sf):
    docs, sources = negatives(spark, sf)
    v = votes(spark, sf)
    it = v.select("event_id", X.normalize_text("question").alias("qid"), "code", F.get("source_ids", F.lit(0)).alias("source_id"), ((F.col("event_id") % 100) / 100).alias("score"))
    return FB.apply_penalties(it, docs, sources).select("event_id", r6(F.col("score")).alias("score"))


_VOTE = """lv AS (SELECT conv_id AS session_id, turn AS ord, CASE WHEN quality = 1 AND toxic = 0 THEN 'up' ELSE 'down' END AS vote
  FROM conversations JOIN labels ON doc_id = conv_id WHERE role = 'assistant')"""


def label_votes(spark, sf):
    l = A.table(spark, sf, "labels")
    m = A.messages(spark, sf).where("role = 'assistant'")
    vote = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), " UP ").otherwise("down")
    j = m.join(l, F.col("session_id") == F.col("doc_id"))
    return j.select("session_id", "ord", vote.alias("vote"), F.lit(" ").alias("reason"))


@query(
    "feedback_events",
    f"""WITH {S.MESSAGE}, {_VOTE} SELECT v.session_id, v.ord, v.vote, md5(u.content) AS question_md5, md5(a.content) AS answer_md5, NULL::VARCHAR AS reason
    FROM lv v JOIN message a USING (session_id, ord) ASOF JOIN (SELECT session_id, ord, content FROM message WHERE role = 'user') u ON u.session_id = v.session_id AND u.ord <= v.ord""",
)
def feedback_events(spark, sf):
    f = FB.feedback_events(label_votes(spark, sf), chat.asof_questions(A.messages(spark, sf)))
    return f.select("session_id", "ord", "vote", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"), "reason")


@query(
    "fifo_pairs",
    f"""WITH RECURSIVE {S.MESSAGE}, q AS (SELECT session_id, ord, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS k FROM message WHERE role = 'user'),
    m AS (SELECT session_id, ord, role, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS i FROM message WHERE role IN ('user', 'assistant')),
    w(session_id, i, asked, used, hit) AS (SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT FROM m UNION ALL
      SELECT w.session_id, m.i, asked + (role = 'user')::INT, used + (role = 'assistant' AND used < asked)::INT, CASE WHEN role = 'assistant' AND used < asked THEN m.ord END
      FROM w JOIN m ON m.session_id = w.session_id AND m.i = w.i + 1)
    SELECT q.session_id, q.ord AS question_ord, w.hit AS answer_ord FROM q LEFT JOIN w ON w.session_id = q.session_id AND w.used = q.k AND w.hit IS NOT NULL""",
)
def fifo_pairs(spark, sf):
    return chat.fifo_pairs(A.messages(spark, sf)).select("session_id", "question_ord", "answer_ord")


@query(
    "asof_question",
    f"""WITH {S.MESSAGE} SELECT a.session_id, a.ord, u.ord AS question_ord, md5(u.content) AS question_md5 FROM (SELECT * FROM message WHERE role = 'assistant') a
    ASOF LEFT JOIN (SELECT * FROM message WHERE role = 'user') u ON u.session_id = a.session_id AND u.ord <= a.ord""",
)
def asof_question(spark, sf):
    t = chat.asof_questions(A.messages(spark, sf))
    return t.select("session_id", "ord", "question_ord", F.md5("question").alias("question_md5"))


_PAIRED = """pairs AS (SELECT u.session_id, u.ord AS question_ord, (SELECT min(a.ord) FROM message a WHERE a.session_id = u.session_id AND a.role = 'assistant' AND a.ord > u.ord
   AND a.ord < coalesce((SELECT min(n.ord) FROM message n WHERE n.session_id = u.session_id AND n.role = 'user' AND n.ord > u.ord), 1000000000)) AS answer_ord FROM message u WHERE role = 'user')"""


@query("paired_assistant", f"WITH {S.MESSAGE}, {_PAIRED} SELECT * FROM pairs")
def paired_assistant(spark, sf):
    return chat.bounded_answers(A.messages(spark, sf))


@query(
    "followup_resolve",
    f"""WITH {S.MESSAGE}, la AS (SELECT session_id, max(ord) AS o FROM message WHERE role = 'assistant' GROUP BY session_id),
    pu AS (SELECT la.session_id, arg_max(content, ord) AS q FROM la JOIN message m ON m.session_id = la.session_id AND role = 'user' AND ord < o GROUP BY la.session_id)
    SELECT session_id, {S.code('session_id')} AS selected, {S.ends('q')} AS question FROM pu WHERE session_id % 3 <> 2 AND trim(q) <> ''""",
)
def followup_resolve(spark, sf):
    m = A.messages(spark, sf)
    own, other = A.code_of(F.col("session_id")), A.code_of(F.col("session_id") + 1)
    prompt = F.concat(F.lit("Aynan qaysi SHNQ kerak?\n1. "), own, F.lit("\n2. "), other)
    asked = m.withColumn("content", F.when(F.col("role") == "assistant", prompt).otherwise(F.col("content")))
    k = F.col("session_id") % 3
    replies = m.select("session_id").distinct().select(
        "session_id", F.when(k == 2, "rahmat").when(k == 1, "mana").otherwise(F.concat(F.lower(own), F.lit(" kerak"))).alias("reply"),
        F.when(k == 1, own).alias("document_code"),
    )
    return chat.followups(asked, replies)


_ROOM = "room AS (SELECT DISTINCT conv_id AS session_id, 'r' || (conv_id % 17) AS room FROM conversations WHERE conv_id % 2 = 0)"


def rooms(spark, sf):
    m = A.messages(spark, sf).select("session_id").distinct().where("session_id % 2 = 0")
    return m.select("session_id", F.concat(F.lit("r"), (F.col("session_id") % 17).cast("string")).alias("room"))


@query(
    "guest_usage",
    f"""WITH {S.MESSAGE}, {_ROOM} SELECT room, count(*) AS questions, count(*) >= 3 AS limited FROM message JOIN room USING (session_id) WHERE role = 'user' GROUP BY room""",
)
def guest_usage(spark, sf):
    return chat.usage(A.messages(spark, sf), rooms(spark, sf))


@query(
    "history_join",
    f"""WITH {S.MESSAGE} SELECT m.session_id, m.ord, coalesce(c_name, 'Mehmon') AS asked_by FROM message m LEFT JOIN customer ON c_custkey = session_id AND session_id % 2 = 0 WHERE role = 'user'""",
)
def history_join(spark, sf):
    m = A.messages(spark, sf).where("role = 'user'").withColumn("user_id", F.when(F.col("session_id") % 2 == 0, F.col("session_id")))
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return m.join(c, "user_id", "left").select("session_id", "ord", F.coalesce("c_name", F.lit("Mehmon")).alias("asked_by"))


@query(
    "qa_history",
    f"""WITH {S.MESSAGE}, {_PAIRED} SELECT p.session_id, question_ord, answer_ord, coalesce(c_name, 'Mehmon') AS asked_by, md5(m.content) AS question_md5 FROM pairs p
    JOIN message m ON m.session_id = p.session_id AND m.ord = question_ord LEFT JOIN customer ON c_custkey = p.session_id AND p.session_id % 2 = 0
    ORDER BY question_ord DESC, p.session_id LIMIT 300""",
)
def qa_history(spark, sf):
    p = chat.fifo_pairs(A.messages(spark, sf)).withColumn("user_id", F.when(F.col("session_id") % 2 == 0, F.col("session_id")))
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    j = p.join(c, "user_id", "left").orderBy(F.desc("question_ord"), "session_id").limit(300)
    return j.select("session_id", "question_ord", "answer_ord", F.coalesce("c_name", F.lit("Mehmon")).alias("asked_by"), F.md5("question").alias("question_md5"))


@query(
    "history_delete",
    f"""WITH {S.MESSAGE}, {_PAIRED}, {_VOTE}, d AS (SELECT * FROM pairs WHERE (session_id + question_ord) % 4 = 0),
    gone AS (SELECT session_id, question_ord AS ord FROM d UNION SELECT session_id, answer_ord FROM d WHERE answer_ord IS NOT NULL),
    l AS (SELECT * FROM message ANTI JOIN gone USING (session_id, ord)), v AS (SELECT * FROM lv ANTI JOIN gone USING (session_id, ord))
    SELECT 'message' AS kind, session_id, count(*) AS n FROM l GROUP BY session_id UNION ALL SELECT 'feedback', session_id, count(*) FROM v GROUP BY session_id
    UNION ALL SELECT 'session', session_id, 1 FROM (SELECT DISTINCT session_id FROM l)""",
)
def history_delete(spark, sf):
    m = A.messages(spark, sf)
    doomed = m.where("role = 'user' AND (session_id + ord) % 4 = 0").select("session_id", F.col("ord").alias("question_ord"))
    left, votes_left, sessions = chat.history_delete(m, label_votes(spark, sf), doomed)
    count = lambda df, k: df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "session_id", "n")
    return count(left, "message").unionByName(count(votes_left, "feedback")).unionByName(count(sessions, "session"))


@query(
    "session_rollup",
    f"""WITH {S.MESSAGE}, g AS (SELECT session_id, {S.squeeze("arg_min(content, ord) FILTER (role = 'user')")} AS t, count(*) AS n, max(ord) AS u FROM message GROUP BY session_id)
    SELECT session_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS title, n AS n_messages, u AS updated_at FROM g""",
)
def session_rollup(spark, sf):
    return chat.session_rollup(A.messages(spark, sf))


@query(
    "session_list",
    f"""WITH {S.MESSAGE}, {_ROOM}, g AS (SELECT session_id, count(*) AS n, max(ord) AS u FROM message GROUP BY session_id)
    SELECT room, session_id, u AS updated_at FROM g JOIN room USING (session_id) ORDER BY room, u DESC, session_id""",
)
def session_list(spark, sf):
    s = chat.session_rollup(A.messages(spark, sf)).join(rooms(spark, sf), "session_id")
    return s.select("room", "session_id", "updated_at").orderBy("room", F.desc("updated_at"), "session_id")


@query("transcript", f"WITH {S.MESSAGE} SELECT session_id, ord, role, md5(content) AS content_md5 FROM message ORDER BY session_id, ord")
def transcript(spark, sf):
    return A.messages(spark, sf).select("session_id", "ord", "role", F.md5("content").alias("content_md5")).orderBy("session_id", "ord")


@query(
    "user_erase",
    """WITH s AS (SELECT DISTINCT conv_id AS session_id FROM conversations), u AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 4)
    SELECT 'session' AS kind, session_id AS id, CASE WHEN session_id % 10 <> 4 THEN session_id END AS user_id FROM s UNION ALL SELECT 'user', c_custkey, c_custkey FROM u""",
)
def user_erase(spark, sf):
    from clausespark.operators import catalog

    users = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    sessions = A.messages(spark, sf).select("session_id", F.col("session_id").alias("user_id")).distinct()
    s, u = catalog.erase_users(sessions, users, users.where("user_id % 10 = 4"))
    return s.select(F.lit("session").alias("kind"), F.col("session_id").alias("id"), "user_id").unionByName(
        u.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "user_id")
    )


@query(
    "answer_log",
    f"""WITH {S.ITEM}, r AS (SELECT qid, clause_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS k FROM item WHERE kind = 'clause')
    SELECT qid, string_agg(clause_id, '|' ORDER BY k) AS top_clause_ids FROM r WHERE k <= 5 GROUP BY qid""",
)
def answer_log(spark, sf):
    from clausespark.operators import answering as Q

    t = Q.ranked(A.items(spark, sf).where("kind = 'clause'")).where("rank <= 5")
    g = t.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "clause_id"))).alias("c"))
    return g.select("qid", F.array_join(F.transform("c", lambda s: s["clause_id"]), "|").alias("top_clause_ids"))
