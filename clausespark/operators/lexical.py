"""Lexical retrieval of clauses for a whole table of questions.

A term counts wherever it occurs as a substring, but terms consist of token characters only, so an
occurrence always lies inside one token of the text. The plan therefore works on distinct tokens:

1. the distinct tokens of the corpus are matched to the distinct terms by an equi-join on the
   substrings whose lengths occur among the terms;
2. tokens of the clauses that match any term are joined back and counted per (clause, term), the others are
   dropped where they are read;
3. every clause that a term touches is a candidate; for a top k, common terms are looked up only for clauses
   that rarer ones touch, as soon as the common ones alone could not bring a clause into the list.

No side is broadcast by hand: small ones are broadcast by size, large ones are shuffled.

A top k for at most ``BLOCK_ROWS`` questions has a second physical form, which gives the same rows: the terms
travel with the tasks, each clause finds its terms where it is read, and only its counts per term are shuffled, once,
to join rows of one clause_id. Every task then keeps a running top k per question, so pairs of question and clause
are neither shuffled nor written. Inside scopes a clause also carries the numbers of those that hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausespark import constants as K
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.operators import scope as SC
from clausespark.session import cut_lineage, ship_package

PRIORITY_WEIGHT, UNIQUE_WEIGHT = 3.0, 1.15
#: The most that counts of occurrences (1.0, 0.6) and full priority coverage (0.45) add to a score.
EXTRA_MOST = 2.05
#: Scores are rounded to nine digits; bounds leave more room than that.
SLACK = 1e-6
#: Questions whose terms travel with a task, cells of question and clause scored at once, and matched tokens a task keeps.
BLOCK_ROWS, CELLS = 2048, 1 << 21
KEPT_TOKENS, KEPT_LETTERS = 100_000, 64


def question_terms(questions: DataFrame, text: str = "question") -> DataFrame:
    """(qid, term, is_unique, is_priority, n_priority) of every question."""
    q = questions.select("qid", X.unique_terms(text).alias("u"), X.priority_terms(text).alias("p"))
    t = q.select("qid", "u", "p", F.explode(F.array_union("u", "p")).alias("term"))
    return t.select(
        "qid",
        "term",
        F.array_contains("u", F.col("term")).alias("is_unique"),
        F.array_contains("p", F.col("term")).alias("is_priority"),
        F.size("p").alias("n_priority"),
        F.size("u").alias("n_unique"),
    )


def clause_tokens(clauses: DataFrame) -> DataFrame:
    """(clause_id, token, n, n_text): tokens of chapter title and text, one row per occurrence; ``n_text`` is 1 in the text.

    Occurrences are summed per clause only once those that match a term are known, so the tokens of a whole
    corpus are never shuffled.
    """
    tok = lambda c: F.filter(X.extract_tokens(X.lexical_fold(c)), lambda t: F.length(t) > 2)
    title = F.transform(tok("chapter_title"), lambda t: F.struct(t.alias("token"), F.lit(0).alias("in_text")))
    body = F.transform(tok("text"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("in_text")))
    e = clauses.select("clause_id", F.explode(F.concat(title, body)).alias("t"))
    return e.select("clause_id", "t.token", F.lit(1).alias("n"), F.col("t.in_text").alias("n_text"))


def match_tokens(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, token, occ) for every token that contains a term."""
    lengths = terms.agg(F.collect_set(F.length("term")).alias("ls")).scalar()
    v = vocabulary.select("token", lengths.alias("ls"))

    def cuts(n):
        last = F.length("token") - n + 1
        spans = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("token"), i, n))
        return F.when(last >= 1, spans).otherwise(F.array().cast("array<string>"))

    pieces = F.array_distinct(F.flatten(F.transform("ls", cuts)))
    e = v.select("token", F.explode(pieces).alias("term"))
    return e.join(terms, "term").select("term", "token", X.occurrences(F.col("token"), F.col("term")).alias("occ"))


def term_hits(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(clause_id, term, tf, text_tf) for the distinct terms of a question table."""
    # written, so that the planner knows how few tokens match and need not shuffle the postings to find them
    matched = cut_lineage(match_tokens(terms.select("term").distinct(), postings.select("token").distinct()))
    j = postings.join(matched, "token")
    return j.groupBy("clause_id", "term").agg(
        F.sum(F.col("n") * F.col("occ")).alias("tf"), F.sum(F.col("n_text") * F.col("occ")).alias("text_tf")
    )


def _gather(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """Counts per question and touched clause; ``hits`` joins on whatever columns both sides share."""
    on = ["term", "clause_id"] if "clause_id" in terms.columns else ["term"]
    return terms.join(hits, on).groupBy("qid", "clause_id").agg(
        F.sum(F.when(F.col("is_unique"), F.col("tf")).otherwise(0)).alias("tf"),
        F.sum(F.col("is_unique").cast("int")).alias("coverage"),
        F.sum(F.when(F.col("is_priority"), F.col("tf")).otherwise(0)).alias("p_tf"),
        F.sum(F.col("is_priority").cast("int")).alias("p_coverage"),
        F.max("n_priority").alias("n_priority"),
    )


def score_candidates(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """Scores of all clauses that any term touches: (qid, clause_id, score, coverage, tf)."""
    return _scores(_gather(terms, hits))


def top_scored(terms: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of ``score_candidates`` per question, and others, without joining common terms to every clause.

    Each term has an upper bound of what it adds. The rarest terms alone give partial scores, and the k-th best
    of these is a floor. Terms are then taken from rare to common until those left could not lift an untouched
    clause to the floor. The partial sums of the terms taken are kept; the terms left are looked up only for
    clauses that they could still lift to the k-th best partial score.
    """
    count = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("is_unique"), UNIQUE_WEIGHT).otherwise(0.0) + F.when(F.col("is_priority"), PRIORITY_WEIGHT).otherwise(0.0)
    t = terms.join(count, "term").withColumn("bound", bound)
    rare_first = Window.partitionBy("qid").orderBy("n", "term")  # the few terms of one question
    left = F.sum("bound").over(rare_first.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("left", left).withColumn("lead", left * 2 > F.sum("bound").over(Window.partitionBy("qid")))
    t = cut_lineage(t)
    led = cut_lineage(_gather(t.where("lead"), hits))
    t = t.join(_floor(led, k), "qid", "left")
    needed = F.col("lead") | F.col("floor").isNull() | (F.col("left") + EXTRA_MOST + SLACK >= F.col("floor"))
    t = cut_lineage(t.withColumn("taken", needed).drop("floor"))
    taken = cut_lineage(_added(led, _gather(t.where("taken AND NOT lead"), hits)))
    rest = t.where("NOT taken")
    open_ = cut_lineage(rest.groupBy("qid").agg(F.sum("bound").alias("most")))
    # a question without terms left has exact scores already; of the others only what can reach the floor is looked up
    full = _floor(taken, k).join(open_.select("qid", "most"), "qid", "left")
    reach = F.col("p_coverage") * PRIORITY_WEIGHT + F.col("coverage") * UNIQUE_WEIGHT + F.col("most") + EXTRA_MOST
    reach = F.when(F.col("most").isNull(), _score()).otherwise(reach)
    live = taken.join(full, "qid", "left").where(F.col("floor").isNull() | (reach + SLACK >= F.col("floor")))
    live = cut_lineage(live.drop("most", "floor").join(open_, "qid", "left").withColumn("asks", F.col("most").isNotNull()).drop("most"))
    more = live.where("asks").select("qid", "clause_id").join(rest, "qid")
    return _scores(_added(live.drop("asks"), _gather(more, hits)))


def _added(one: DataFrame, two: DataFrame) -> DataFrame:
    """The sums of disjoint terms, put together."""
    sums = [F.sum(c).alias(c) for c in ("tf", "coverage", "p_tf", "p_coverage")]
    return one.unionByName(two).groupBy("qid", "clause_id").agg(*sums, F.max("n_priority").alias("n_priority"))


def _floor(sums: DataFrame, k: int) -> DataFrame:
    """(qid, floor): the k-th best score so far, for questions with so many."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "clause_id")
    return _scores(sums).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).where(F.col("r") == k).select("qid", F.col("score").alias("floor"))


def _score() -> Column:
    return (
        F.col("p_coverage") * PRIORITY_WEIGHT
        + F.col("coverage") * UNIQUE_WEIGHT
        + F.least(F.lit(1.0), F.log1p("p_tf") * 0.45)
        + F.least(F.lit(0.6), F.log1p("tf") * 0.18)
        + F.when((F.col("n_priority") > 0) & (F.col("p_coverage") == F.col("n_priority")), 0.45).otherwise(0.0)
    )


def _scores(g: DataFrame) -> DataFrame:
    s = g.where(F.col("tf") > 0)
    s = s.where(~((F.col("n_priority") > 0) & (F.col("p_coverage") <= 0) & (F.col("coverage") < 2)))
    return s.select("qid", "clause_id", F.round(_score(), 9).alias("score"), "coverage", "tf")


def top_clauses(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "clause_id")
    r = scored.withColumn("lexical_rank", F.row_number().over(w).cast("bigint")).where(F.col("lexical_rank") <= k)
    return r.withColumnRenamed("score", "lexical_score")


def matches(
    questions: DataFrame, clauses: DataFrame, postings: DataFrame | None = None, scopes: SC.Scopes | None = None
) -> tuple[DataFrame, DataFrame]:
    """Terms of the questions and their hits, as written tables.

    With scopes a term is a pair of scope and term, so that counts, bounds and hits are those inside the scope.
    """
    postings = cut_lineage(clause_tokens(clauses)) if postings is None else postings  # read twice
    if scopes is None:
        terms = cut_lineage(question_terms(questions))
        return terms, cut_lineage(term_hits(postings, terms))
    terms = cut_lineage(scopes.keyed(question_terms(questions)))
    everywhere = term_hits(postings, terms.where(F.col("within") == SC.EVERYTHING)).withColumn("within", F.lit(SC.EVERYTHING))
    inside = scoped_hits(postings, terms.where(F.col("within") != SC.EVERYTHING), SC.homes(clauses, "clause_id"), scopes)
    pair = lambda df: df.withColumn("term", F.struct("within", "term")).drop("within")
    return pair(terms), cut_lineage(pair(everywhere.unionByName(inside)))


def scoped_hits(postings: DataFrame, terms: DataFrame, homes: DataFrame, scopes: SC.Scopes) -> DataFrame:
    """Hits of (within, term) pairs inside their scopes: (within, term, clause_id, tf, text_tf).

    Only hits are joined to the scopes, never postings. A clause's hits are repeated once per distinct scope
    that holds it and asks for the term, not once per question.
    """
    wanted = cut_lineage(terms.select("within", "term").distinct())
    members = cut_lineage(scopes.rows().join(wanted.select("within").distinct(), "within", "left_semi"))
    held = homes.join(members.select("code_key").distinct(), "code_key", "left_semi")
    found = term_hits(postings, wanted)
    seen = found.join(held, "clause_id").join(members, "code_key")
    return seen.join(wanted, ["within", "term"], "left_semi").select("within", "term", "clause_id", "tf", "text_tf")


def retrieve(
    questions: DataFrame, clauses: DataFrame, k: int = K.LEXICAL_K,
    postings: Callable[[], DataFrame] | None = None, scopes: SC.Scopes | None = None,
) -> DataFrame:
    """Lexical list of a question table: (qid, clause_id, lexical_score, coverage, tf, lexical_rank).

    ``postings`` gives the ``clause_tokens`` that several searches share; only more than ``BLOCK_ROWS`` questions need them.
    """
    asked = questions.select("qid", X.unique_terms("question").alias("u"), X.priority_terms("question").alias("p"))
    asked = asked if scopes is None else scopes.keyed(asked)
    head = asked.limit(BLOCK_ROWS + 1).collect()
    if len(head) <= BLOCK_ROWS:
        return top_clauses(_top_in_place(asked, Asked.of(head), clauses, k, scopes), k)
    terms, hits = matches(questions, clauses, postings() if postings else None, scopes)
    return top_clauses(top_scored(terms, hits, k), k)


class Asked(NamedTuple):
    """Terms of a block of questions and, one row per question and term in the order of terms, what asks for them."""

    qids: list
    terms: list[str]
    scopes: list[str]
    starts: np.ndarray
    question: np.ndarray
    unique: np.ndarray
    priority: np.ndarray
    n_priority: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, head: list) -> Asked:
        """From rows (qid, u, p) and ``within``, if there are scopes; rows of one qid add up, as they do in ``question_terms`` and ``_gather``."""
        qids: dict = {}
        scopes = {SC.EVERYTHING: 0}
        rows = []
        for r in head:
            no, u, p = qids.setdefault(r["qid"], len(qids)), r["u"] or [], r["p"] or []
            within = scopes.setdefault(r["within"], len(scopes)) if "within" in r else 0
            rows += [(t, no, t in u, t in p, len(p), within) for t in dict.fromkeys([*u, *p])]
        rows.sort()
        terms = sorted({r[0] for r in rows})
        numbers = np.array([r[1:] for r in rows], dtype=np.int64).reshape(-1, 5)
        starts = np.searchsorted(np.array([r[0] for r in rows], dtype=object), np.array([*terms], dtype=object)) if rows else np.zeros(0, dtype=np.int64)
        return cls(list(qids), terms, list(scopes), np.r_[starts, len(rows)].astype(np.int64), *numbers.T)

    def together(self) -> int:
        """How many clauses are scored at once."""
        return max(1, CELLS // max(1, len(self.qids), len(self.scopes)))

    def sums(self, block: Block, held: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
        """Matrices of clauses and questions: tf, coverage, p_tf, p_coverage, n_priority.

        ``held`` has the scopes of clauses, as (place in the block, number of the scope). A question with a scope
        counts a clause once per row that lies in it, as ``scoped_hits`` does.
        """
        m, n = len(block.ids), len(self.qids)
        sizes = self.starts[block.term + 1] - self.starts[block.term]
        row = np.repeat(self.starts[block.term] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        clause, tf, times = np.repeat(block.clause, sizes), np.repeat(block.tf, sizes), 1
        if held is not None:
            rows = np.bincount(held[0] * len(self.scopes) + held[1], minlength=m * len(self.scopes)).reshape(m, -1)
            rows[:, 0] = 1
            times = rows[clause, self.within[row]]
            clause, tf, row, times = (x[times > 0] for x in (clause, tf, row, times))
        cell = clause * n + self.question[row]
        total = lambda values: np.bincount(cell, weights=values * times, minlength=m * n).reshape(m, n)
        unique, priority = self.unique[row], self.priority[row]
        most = np.zeros(m * n)
        np.maximum.at(most, cell, self.n_priority[row])
        return [*map(total, (tf * unique, unique, tf * priority, priority)), most.reshape(m, n)]


class Block(NamedTuple):
    """Clauses, each once and in the order of their ids, their counts ``tf`` of the terms they hold, and the rows they come from."""

    ids: list
    clause: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    rows: list
    owner: np.ndarray


def blocks(batches: Iterator[pd.DataFrame], together: int, *more: str) -> Iterator[Block]:
    """Blocks of at most ``together`` clauses of a ``found_terms`` table; ``rows`` holds the columns ``more`` of each row."""
    ids, terms, counts, rows, owner = [], [], [], [], []

    def block() -> Block:
        clause = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        return Block(ids[:], clause, np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float64), rows[:], np.array(owner, dtype=np.int64))

    for frame in batches:
        for clause, t, n, *row in zip(*(frame[c] for c in ("clause_id", "term", "tf", *more))):
            if ids and (clause == ids[-1] or clause is None and ids[-1] is None):
                both, at = np.unique(np.r_[terms[-1], t], return_inverse=True)
                terms[-1], counts[-1] = both, np.bincount(at, weights=np.r_[counts[-1], n], minlength=len(both))
            else:
                if len(ids) >= together:
                    yield block()
                    for kept in (ids, terms, counts, rows, owner):
                        kept.clear()
                ids.append(clause)
                terms.append(t)
                counts.append(n)
            rows.append(row)
            owner.append(len(ids) - 1)
    if ids:
        yield block()


class _Matches(dict):
    """Terms inside a token and how often each, as two lists; a bounded number of tokens is kept."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}
        self.lengths = sorted({len(t) for t in terms})

    def __missing__(self, token: str) -> tuple[list[int], list[int]]:
        found = {token[i:i + n] for n in self.lengths for i in range(len(token) - n + 1)} & self.at.keys()
        out = [self.at[t] for t in found], [token.count(t) for t in found]
        if len(token) <= KEPT_LETTERS:
            if len(self) >= KEPT_TOKENS:
                self.clear()
            self[token] = out
        return out


SUMS = ("tf", "coverage", "p_tf", "p_coverage", "n_priority")


class Best:
    """Running top k of clauses per list, one for each question, by score and then by clause_id, with the sums the score is made of."""

    sums: tuple[str, ...] = SUMS

    def __init__(self, asked: Asked, k: int, lists: int | None = None):
        self.asked, self.k = asked, k
        none = np.empty((0, len(self.sums)))
        self.best: list[tuple[np.ndarray, list, np.ndarray]] = [(np.empty(0), [], none)] * (len(asked.qids) if lists is None else lists)

    def add(self, block: Block, held: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        sums = self.asked.sums(block, held)
        tf, coverage, p_tf, p_coverage, most = sums
        score = p_coverage * PRIORITY_WEIGHT + coverage * UNIQUE_WEIGHT + np.minimum(1.0, np.log1p(p_tf) * 0.45) + np.minimum(0.6, np.log1p(tf) * 0.18)
        score = np.round(score + np.where((most > 0) & (p_coverage == most), 0.45, 0.0), 9)
        score[~counted(*sums)] = -1.0
        for j in np.flatnonzero((score >= 0).any(axis=0)):
            self.merge(j, block.ids, score[:, j], [x[:, j] for x in sums])

    def merge(self, j: int, ids: list, score: np.ndarray, sums: list[np.ndarray]) -> None:
        """Take clauses ``ids`` into a list; those with a score below zero are none of it."""
        scores, names, kept = self.best[j]
        least = scores[-1] if len(scores) == self.k else 0.0
        at = np.flatnonzero(score >= least)
        if len(at):
            # clauses come in the order of their ids, so a stable sort leaves ties in that order
            at = at[np.argsort(-score[at], kind="stable")[:self.k]]
            scores, names = np.r_[scores, score[at]], [*names, *[ids[i] for i in at]]
            kept = np.r_[kept, np.stack([x[at] for x in sums], axis=1)]
            top = sorted(range(len(names)), key=lambda i: (-scores[i], names[i] is not None, names[i]))[:self.k]
            self.best[j] = scores[top], [names[i] for i in top], kept[top]

    def frame(self) -> pd.DataFrame:
        sums = np.concatenate([b[2] for b in self.best]).astype(np.int64) if self.best else np.empty((0, len(self.sums)), dtype=np.int64)
        no = np.repeat(np.arange(len(self.best)), np.array([len(b[1]) for b in self.best], dtype=np.int64))
        ids = pd.Series([i for b in self.best for i in b[1]], dtype=object)
        return pd.DataFrame({"no": no, "clause_id": ids} | dict(zip(self.sums, sums.T)))


def counted(tf, coverage, p_tf, p_coverage, most) -> np.ndarray:
    """The pairs that ``_scores`` leaves."""
    return (tf > 0) & ~((most > 0) & (p_coverage <= 0) & (coverage < 2))


def long_tokens(column: str) -> Column:
    return F.filter(X.extract_tokens(X.lexical_fold(column)), lambda t: F.length(t) > 2)


def found_terms(clauses: DataFrame, terms: list[str], every: bool = False) -> DataFrame:
    """(clause_id, term, tf, ...): the numbers of the terms inside the ``tokens`` of each clause, and how often; other columns stay.

    Clauses without a term are left out, unless ``every`` is set.
    """
    ship_package(clauses.sparkSession)
    others = [f for f in clauses.schema.fields if f.name != "tokens"]
    schema = T.StructType([*others, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("term", "tf"))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matched = _Matches(terms)
        for batch in batches:
            tokens = batch.column("tokens")
            owner, words = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False), tokens.flatten().dictionary_encode()
            lists = [matched[w] for w in words.dictionary.to_pylist()]
            flat = lambda k: np.array([x for one in lists for x in one[k]], dtype=np.int64)
            sizes = np.array([len(one[0]) for one in lists], dtype=np.int64)
            places, counts, first = flat(0), flat(1), np.cumsum(sizes) - sizes
            # the matches of each token, one after the other, then summed per clause and term
            word = words.indices.to_numpy(zero_copy_only=False)
            n = sizes[word]
            at = np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cells, back = np.unique(np.repeat(owner, n).astype(np.int64) * max(1, len(terms)) + places[at], return_inverse=True)
            tf = np.bincount(back, weights=counts[at], minlength=len(cells))
            ends = np.searchsorted(cells // max(1, len(terms)), np.arange(len(tokens) + 1)).astype(np.int32)
            packed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
            columns = [batch.column(f.name) for f in others] + [packed(cells % max(1, len(terms))), packed(tf)]
            out = pa.RecordBatch.from_arrays(columns, names=schema.names)
            yield out if every else out.filter(pa.array(np.diff(ends) > 0))

    return clauses.mapInArrow(find, schema)


def dealt(found: DataFrame) -> DataFrame:
    """Rows of one clause_id follow each other in one partition."""
    return found.repartition("clause_id").sortWithinPartitions("clause_id")


def _top_in_place(questions: DataFrame, asked: Asked, clauses: DataFrame, k: int, scopes: SC.Scopes | None) -> DataFrame:
    """The rows of ``score_candidates`` that can be among the best ``k`` of their question."""
    spark, kind = clauses.sparkSession, clauses.schema["clause_id"].dataType.simpleString()
    scoped = scopes is not None and len(asked.scopes) > 1
    read = clauses.select("clause_id", F.concat(long_tokens("chapter_title"), long_tokens("text")).alias("tokens"), *([R.code_key("code").alias("code_key")] if scoped else []))
    found = found_terms(read, asked.terms, scoped)
    if scoped:
        # terms meet the scopes, not texts; a row in a scope counts there even if another row of its clause holds the terms
        found = found.join(SC.held(scopes, asked.scopes), "code_key", "left").drop("code_key")
        found = found.withColumn("held", F.when(F.col("clause_id").isNotNull(), F.col("held"))).where(F.col("held").isNotNull() | (F.size("term") > 0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(asked, k)
        for block in blocks(batches, asked.together(), *(["held"] if scoped else [])):
            if not scoped:
                best.add(block)
                continue
            held = [() if row[0] is None else row[0] for row in block.rows]
            place = np.repeat(block.owner, [len(h) for h in held])
            best.add(block, (place, np.array([x for h in held for x in h], dtype=np.int64)))
        yield best.frame()

    sums = dealt(found).mapInPandas(score, f"no int, clause_id {kind}, " + ", ".join(f"{c} bigint" for c in SUMS))
    return _scores(sums.join(numbered(spark, asked.qids, questions.schema["qid"].dataType), "no"))


def numbered(spark: SparkSession, qids: list, kind: T.DataType) -> DataFrame:
    """(no, qid) of a block of questions."""
    return spark.createDataFrame([(i, q) for i, q in enumerate(qids)], T.StructType([T.StructField("no", T.IntegerType()), T.StructField("qid", kind)]))


def containing(clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """Clauses that contain any term of a question, ignoring case: distinct (qid, clause_id).

    Questions are numbered, and a token carries those that ask for it as the bits of whole numbers, 64 questions
    each. A clause has the bits of its tokens, so what is shuffled grows with clauses and not with pairs.
    """
    asked = cut_lineage(terms.select("qid").distinct()).withColumn("no", F.monotonically_increasing_id())
    asked = cut_lineage(asked.select("qid", F.shiftright("no", 6).alias("block"), (F.col("no") % 64).cast("int").alias("bit")))
    postings = cut_lineage(text_tokens(clauses))  # read twice
    matched = cut_lineage(match_tokens(terms.select("term").distinct(), postings.select("token").distinct()))
    of_term = terms.select("qid", "term").distinct().join(asked, F.equal_null(terms["qid"], asked["qid"])).groupBy("term", "block").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    )
    of_token = matched.join(of_term, "term").groupBy("token", "block").agg(F.bit_or("bits").alias("bits"))
    hits = postings.join(cut_lineage(of_token), "token").groupBy("clause_id", "block").agg(F.bit_or("bits").alias("bits"))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("bits"), i) == 1)
    pairs = hits.select("clause_id", "block", F.explode(set_bits).alias("bit"))
    return pairs.join(asked, ["block", "bit"]).select("qid", "clause_id")


def text_tokens(clauses: DataFrame) -> DataFrame:
    """(clause_id, token): the distinct tokens of each clause's text."""
    tok = F.filter(X.extract_tokens(X.lexical_fold("text")), lambda t: F.length(t) > 2)
    return clauses.select("clause_id", F.explode(F.array_distinct(tok)).alias("token"))
