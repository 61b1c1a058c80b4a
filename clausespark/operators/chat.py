"""Chat histories: three pairing rules, follow-ups, usage, roll-ups and deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.operators.ordered import running

def fifo_pairs(messages: DataFrame) -> DataFrame:
    """Queue pairing per session: each answer takes the oldest waiting question, unanswered ones stay.

    An answer that finds the queue empty is dropped. With ``depth`` as questions minus answers so far,
    the answers dropped up to a row are max(0, -min depth); the rest match by rank.
    """
    u, a = F.col("role") == "user", F.col("role") == "assistant"
    step = F.when(u, 1).when(a, -1).otherwise(0)
    t = running(messages.where(u | a), "session_id", "ord", sums={"depth": step, "n_user": u.cast("int"), "n_answer": a.cast("int")})
    t = running(t, "session_id", "ord", mins={"low": F.col("depth")})
    t = t.withColumn("dropped", F.greatest(F.lit(0), -F.col("low")))
    kept = t.where(a).withColumn("rank", F.col("n_answer") - F.col("dropped"))
    # a dropped answer leaves the number of kept answers as it was: of equal ranks the first one is kept
    answers = kept.where("rank > 0").groupBy("session_id", "rank").agg(F.min_by(F.struct("ord", "content"), "ord").alias("m"))
    answers = answers.select("session_id", "rank", F.col("m.ord").alias("ord"), F.col("m.content").alias("content"))
    answers = answers.select("session_id", "rank", F.col("ord").alias("answer_ord"), F.col("content").alias("answer"))
    asked = t.where(u).select("session_id", F.col("n_user").alias("rank"), F.col("ord").alias("question_ord"), F.col("content").alias("question"))
    return asked.join(answers, ["session_id", "rank"], "left").drop("rank")


def asof_questions(messages: DataFrame) -> DataFrame:
    """Each answer with the last question at or before it in its session."""
    u = F.col("role") == "user"
    t = running(messages, "session_id", "ord", last={"q": F.when(u, F.struct(F.col("ord").alias("o"), F.col("content").alias("c")))})
    t = t.where(F.col("role") == "assistant")
    return t.select("session_id", "ord", F.col("content").alias("answer"), F.col("q.o").alias("question_ord"), F.col("q.c").alias("question"))


def bounded_answers(messages: DataFrame) -> DataFrame:
    """Each question with the first answer after it and before the next question."""
    u, a = F.col("role") == "user", F.col("role") == "assistant"
    t = running(messages, "session_id", "ord", following={"next_user": F.when(u, F.col("ord")), "next_answer": F.when(a, F.col("ord"))})
    t = t.where(u)
    inside = F.when(F.col("next_user").isNull() | (F.col("next_answer") < F.col("next_user")), F.col("next_answer"))
    return t.select("session_id", F.col("ord").alias("question_ord"), inside.alias("answer_ord"))


def followups(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies that pick a document after a clarification, with the question they continue.

    replies: session_id, reply, document_code (or null).
    """
    a, u = F.col("role") == "assistant", F.col("role") == "user"
    last = messages.where(a).groupBy("session_id").agg(F.max_by(F.struct("ord", "content"), "ord").alias("last_answer"))
    prior = messages.where(u).join(last.select("session_id", F.col("last_answer.ord").alias("_o")), "session_id").where("ord < _o")
    prior = prior.groupBy("session_id").agg(F.max_by("content", "ord").alias("prior_question"))
    stated = F.coalesce(F.get(R.doc_codes("document_code"), F.lit(0)), F.nullif(X.squeeze("document_code"), F.lit("")))
    picked = F.coalesce(stated, F.get(R.doc_codes("reply"), F.lit(0)))
    n = F.size(F.split(X.squeeze("reply"), " "))
    t = replies.join(last, "session_id").join(prior, "session_id").withColumn("selected", picked)
    offered = F.transform(R.doc_codes("last_answer.content"), F.lower)
    ok = (
        F.col("selected").isNotNull()
        & (R.looks_like_selection("reply") | (stated.isNotNull() & (n <= 6)))
        & R.looks_like_document_prompt("last_answer.content")
        & ((F.size(offered) == 0) | F.array_contains(offered, F.lower("selected")))
        & (F.trim("prior_question") != "")
    )
    return t.where(ok).select("session_id", "selected", X.squeeze_ends("prior_question").alias("question"))


def usage(messages: DataFrame, rooms: DataFrame, limit: int = K.GUEST_LIMIT) -> DataFrame:
    """Questions per guest room and whether its limit is reached. rooms: session_id, room."""
    q = messages.where(F.col("role") == "user").join(rooms, "session_id")
    return q.groupBy("room").agg(F.count(F.lit(1)).alias("questions")).withColumn("limited", F.col("questions") >= limit)


def session_rollup(messages: DataFrame) -> DataFrame:
    """Title from the first question, number of messages and last position per session."""
    u = F.col("role") == "user"
    g = messages.groupBy("session_id").agg(
        F.min_by(F.when(u, F.col("content")), F.when(u, F.col("ord"))).alias("first"), F.count(F.lit(1)).alias("n_messages"), F.max("ord").alias("updated_at")
    )
    return g.select("session_id", X.preview("first", 80).alias("title"), "n_messages", "updated_at")


def history_delete(messages: DataFrame, feedback: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, feedback and sessions left after deleting questions with their answers.

    doomed: session_id, question_ord. feedback: session_id, ord of the answer voted on, ...
    """
    pairs = bounded_answers(messages).join(doomed, ["session_id", "question_ord"])
    gone = pairs.select("session_id", F.col("question_ord").alias("ord")).unionByName(
        pairs.where("answer_ord IS NOT NULL").select("session_id", F.col("answer_ord").alias("ord"))
    )
    left = messages.join(gone, ["session_id", "ord"], "left_anti")
    votes = feedback.join(gone, ["session_id", "ord"], "left_anti")
    touched = pairs.select("session_id").distinct()
    empty = touched.join(left.select("session_id").distinct(), "session_id", "left_anti")
    sessions = messages.select("session_id").distinct().join(empty, "session_id", "left_anti")
    return left, votes, sessions
