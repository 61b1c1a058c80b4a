"""Hard negatives of anchor embeddings by Fagin's threshold algorithm on integer scores.

Components become whole numbers, so scores are exact. The rows are laid out by label and dominant component and
cut into blocks of ``BLOCK`` rows; anchors are cut into groups of ``GROUP``. A task holds one block with one sorted
list of rows per dimension, and a group. An anchor reads the lists from their large end where its own component is
positive, from the small end where it is negative, and not at all where it is zero. Rows met for the first
time are looked up and scored whole. No row that is still unseen can score more than the threshold, the sum over
the lists of the anchor's component times the value last read, so an anchor stops as soon as the threshold is
strictly below the k-th score that every one of its windows has, or below the window itself. The best of a block
are merged with those of the others by an aggregate-like ranking per anchor and window.

One search finds the positives among the rows of the anchor's label (a single window without bounds), the next
the negatives among the others: the window of a positive of score p holds the scores s with
``LEAST`` p <= 100 s <= ``MOST`` p. Anchors are the stated query set and meet every block of other labels; the work
grows with anchors times rows, in tasks of bounded size.

Defined cases: rows with a null vec_id or label, a null vector, or any null or non-finite component take no part,
nor do rows whose squared length passes 2**55, as scores would not fit a long; of rows with one vec_id the one of
the smallest label, then vector, counts; missing components of shorter vectors are 0; an anchor without
another row of its label has no positives, and a window may be empty: neither gives rows; an empty table gives
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausespark.llm.common import ordered_positions
from clausespark.session import Scratch, cut_lineage, ship_package

SCALE = 256
ANCHORS, SHIFTED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95
BLOCK, GROUP = 4096, 2048
#: Rows read per list before the threshold is first looked at; four times as many each time after.
FIRST_READ = 8
EXACT = 2.0**52
LARGEST = 2.0**55


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: shifted labels, whole components."""
    whole = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    t = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    scaled = F.transform("embedding", lambda v: v.cast("double") * SCALE)
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    t = t.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("x"))
    t = t.filter(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(F.abs(v) + 1, F.lit(2.0))) <= LARGEST)
    t = t.select("vec_id", "label", F.transform("x", lambda v: F.floor(v).cast("int")).alias("q"))
    return t.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("s")).select("vec_id", "s.label", "s.q")


def laid_out(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` with the number of their block of ``size``, in an order that keeps labels and similar rows together."""
    most = F.array_max(F.transform("q", lambda v: F.abs(v)))
    t = rows.withColumn("__peak", F.array_position(F.transform("q", lambda v: F.abs(v)), most))
    t = t.withColumn("__side", F.get("q", F.greatest(F.col("__peak").cast("int") - 1, F.lit(0))))
    t = ordered_positions(t, [F.col("label"), F.col("__peak"), F.col("__side"), F.col("vec_id")], pos="__pos")
    return cut_lineage(t.withColumn(name, F.floor(F.col("__pos") / size)).drop("__pos", "__peak", "__side"))


class Lists:
    """The rows of one block, with a list of them per dimension, ascending."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, axis=0)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of rows that hold the best k allowed ones of every window low <= score <= high, and of others."""
        n = len(self.rows)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, dtype=bool)
        places, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=self.rows.dtype)]
        if not len(up) and not len(down):  # every score is 0
            return np.flatnonzero(allowed), np.zeros(int(allowed.sum()), dtype=self.rows.dtype)
        read, upto = 0, min(FIRST_READ, n)
        threshold = anchor[up] @ self.values[-1, up] + anchor[down] @ self.values[0, down]
        if (threshold < low).all():
            return places[0], scores[0]
        while True:
            met = np.zeros(n, dtype=bool)
            met[self.order[n - upto:n - read, up]] = True
            met[self.order[read:upto, down]] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            new = new[allowed[new]]
            places.append(new)
            scores.append(self.rows[new] @ anchor)
            if upto == n or seen.all():
                break
            threshold = anchor[up] @ self.values[n - upto, up] + anchor[down] @ self.values[upto - 1, down]
            got = np.concatenate(scores)
            if all(threshold < max(a, kth(got, a, b, k)) for a, b in zip(low, high)):
                break
            read, upto = upto, min(4 * upto, n)
        return np.concatenate(places), np.concatenate(scores)


def kth(scores: np.ndarray, low: float, high: float, k: int) -> float:
    """The k-th best of the scores in a window; minus infinity if it has fewer."""
    inside = scores[(scores >= low) & (scores <= high)]
    return np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else -np.inf


def matrix(vectors: pd.Series, wide: int) -> np.ndarray:
    out = np.zeros((len(vectors), wide), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _search(rows: pd.DataFrame, anchors: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    """(anchor_id, window, vec_id, score): the best k rows of a block for every window of every anchor."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    if len(rows) and len(anchors):
        rows = rows.sort_values("vec_id", ignore_index=True)
        wide = max(rows["q"].map(len).max(), anchors["q"].map(len).max())
        x, a = matrix(rows["q"], wide), matrix(anchors["q"], wide)
        if max((x.astype(float) ** 2).sum(axis=1).max(), (a.astype(float) ** 2).sum(axis=1).max()) <= EXACT:
            x, a = x.astype(float), a.astype(float)  # all sums are whole numbers that doubles hold
        lists, ids, labels = Lists(x), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        for anchor, own, label, windows in zip(a, anchors["vec_id"], anchors["label"], anchors["windows"]):
            allowed = (labels == label) & (ids != own) if same else labels != label
            if not allowed.any():
                continue
            windows = np.asarray(windows, dtype=np.int64)
            if same:
                low, high = np.full(1, -np.inf), np.full(1, np.inf)
            else:
                low, high = -(-LEAST * windows // 100), MOST * windows // 100
                windows, low, high = windows[low <= high], low[low <= high], high[low <= high]
            if not len(windows):
                continue
            places, scores = lists.search(anchor, allowed, low, high, k)
            for w, lo, hi in zip(windows, low, high):
                inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                if len(inside):
                    best = inside[np.lexsort((places[inside], -scores[inside]))[:k]]
                    out.append((np.full(len(best), own), np.full(len(best), w), ids[places[best]], scores[best].astype(np.int64)))
    columns = [np.concatenate(c) if out else np.zeros(0, dtype=np.int64) for c in (zip(*out) if out else [()] * 4)]
    return pd.DataFrame(dict(zip(("anchor_id", "window", "vec_id", "score"), columns)))


def best(blocks: DataFrame, groups: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, window, rank, vec_id, score): the k best rows of every window over all paired blocks."""
    left = blocks.join(pairs, "block").groupBy("block", "group")
    right = groups.join(pairs, "group").select("block", "group", "vec_id", "label", "q", "windows").groupBy("block", "group")
    found = left.cogroup(right).applyInPandas(lambda a, b: _search(a, b, same, k), "anchor_id long, window long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label)."""
    ship_package(vectors.sparkSession)
    with Scratch(vectors.sparkSession) as scratch:
        rows = cut_lineage(quantised(vectors))
        blocks = laid_out(rows, block, "block")
        groups = laid_out(rows.filter(F.col("vec_id") % ANCHORS == 0), group, "group")
        held = cut_lineage(blocks.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n")).drop("n"))
        pairs = groups.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).drop("n").join(held, "label").select("block", "group").distinct()
        one = groups.withColumn("windows", F.array(F.lit(0).cast("long")))
        good = best(blocks, one, cut_lineage(pairs), True, positives)
        good = cut_lineage(good.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        wanted = good.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
        asking = cut_lineage(groups.join(wanted, "vec_id"))
        every = held.agg(F.coalesce(F.max("block"), F.lit(-1))).scalar()
        pairs = asking.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(every >= 0).select("group", F.explode(F.sequence(F.lit(0).cast("long"), every)).alias("block"))
        bad = best(blocks, asking, cut_lineage(pairs), False, negatives)
        bad = bad.select("anchor_id", F.col("window").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = good.join(bad, ["anchor_id", "positive_score"])
        return scratch.keep(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


ORACLE = """WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3"""
