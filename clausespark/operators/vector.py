"""Exact nearest neighbours for whole tables of question vectors.

Scoring is a block matrix product inside tasks; Spark partitions the work and picks the final
top k. Two physical forms give the same rows:

* few questions (counted first, at most ``BLOCK_ROWS``): the question block travels with the task
  closure and the stored vectors are scanned in place, without a shuffle;
* more questions: both sides are cut into hash blocks of bounded size, block pairs meet by an
  equi-join on the pair number, and each pair is scored on its own.

Every task keeps a running top k per question, so memory is bounded whatever the data holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausespark import constants as K

BLOCK_ROWS = 2048
SLICE_ROWS = 200_000
#: Slices of a search without a k, whose pairs stay in the task until its block is done.
OPEN_SLICE_ROWS = 8192
SCORE_DIGITS = 9


def _matrix(frame: pd.DataFrame, dim: int) -> np.ndarray:
    """Unit-length rows from dense ``vector`` or sparse ``idx``/``w`` columns."""
    out = np.zeros((len(frame), dim))
    if "idx" in frame:
        for i, (idx, w) in enumerate(zip(frame["idx"], frame["w"])):
            out[i, idx] = w
    else:
        for i, v in enumerate(frame["vector"]):
            if v is not None and len(v) == dim:
                out[i] = v
    norm = np.sqrt((out * out).sum(axis=1))
    norm[norm == 0] = 1.0
    return out / norm[:, None]


def _groups(questions: pd.DataFrame) -> list[tuple[object, np.ndarray]]:
    """Questions by scope: (scope or None for everything, positions)."""
    if "within" in questions:
        keys = [w or None for w in questions["within"]]
    elif "scope" in questions:
        keys = [None if s is None or len(s) == 0 else frozenset(s) for s in questions["scope"]]
    else:
        keys = [None] * len(questions)
    at: dict[object, list[int]] = {}
    for i, key in enumerate(keys):
        at.setdefault(key, []).append(i)
    return [(key, np.array(rows)) for key, rows in at.items()]


def _open_rows(frame: pd.DataFrame):
    """Function from a scope to the positions of the stored rows it allows."""
    every = np.arange(len(frame))
    if "scopes" in frame:
        lists = [() if s is None else s for s in frame["scopes"]]
        held: dict[str, list[int]] = {}
        for i, names in enumerate(lists):
            for name in names:
                held.setdefault(name, []).append(i)
        return lambda scope: every if scope is None else np.array(held.get(scope, []), int)
    keys = frame["key"].to_numpy() if "key" in frame else None
    return lambda scope: every if scope is None else np.flatnonzero(np.isin(keys, list(scope)))


class TopK:
    """Running top k per question; ties go to the smaller id."""

    def __init__(self, questions: pd.DataFrame, dim: int, k: int):
        self.qid = questions["qid"].to_numpy()
        self.q = _matrix(questions, dim)
        self.k, self.dim = k, dim
        self.groups = _groups(questions)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, object))] * len(self.qid)
        self.floor = np.full(len(self.qid), -np.inf)

    def add(self, frame: pd.DataFrame, allowed: np.ndarray | None = None) -> None:
        """Take stored rows in; ``allowed`` says for each of them and each question whether they may meet, in the place of scopes."""
        ids = frame["id"].to_numpy(dtype=object)
        order = np.argsort(ids, kind="stable")
        frame, ids = frame.iloc[order], ids[order]
        stored = _matrix(frame, self.dim)
        if allowed is not None:
            for j, (row, at) in enumerate(zip(np.round(self.q @ stored.T, SCORE_DIGITS), allowed[order].T)):
                self._merge(j, row[at], ids[at])
            return
        open_rows = _open_rows(frame)
        for scope, asking in self.groups:
            rows = open_rows(scope)
            if len(rows):
                whole = len(rows) == len(ids)
                scores = np.round(self.q[asking] @ (stored if whole else stored[rows]).T, SCORE_DIGITS)
                for j, row in zip(asking, scores):
                    self._merge(j, row, ids if whole else ids[rows])

    def _merge(self, j: int, row: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero(row >= self.floor[j])
        if len(at) == 0:
            return
        # ids ascend, so a stable sort by falling score leaves ties in id order
        at = at[np.argsort(-row[at], kind="stable")[: self.k]]
        s = np.concatenate([self.best[j][0], row[at]])
        i = np.concatenate([self.best[j][1], ids[at]])
        top = sorted(range(len(s)), key=lambda x: (-s[x], i[x]))[: self.k]
        self.best[j] = (s[top], i[top])
        if len(top) == self.k:
            self.floor[j] = s[top][-1]

    def frame(self) -> pd.DataFrame:
        sizes = [len(b[0]) for b in self.best]
        return pd.DataFrame(
            {
                "qid": np.repeat(self.qid, sizes),
                "id": np.concatenate([b[1] for b in self.best]) if sizes else [],
                "score": np.concatenate([b[0] for b in self.best]) if sizes else [],
            }
        )


def rank(df: DataFrame, k: int) -> DataFrame:
    """Top k per question with a 1-based rank; the limit is applied before the shuffle as well."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def top_k(
    questions: DataFrame,
    stored: DataFrame,
    k: int,
    dim: int,
    block_rows: int = BLOCK_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Cosine top k of every question over all stored vectors: (qid, id, score, rank).

    questions: qid, vector or (idx, w), optionally scope (allowed keys, empty = all) or within (a scope's
    name, empty = all). stored: id, vector or (idx, w), with key for the first and scopes (names of the
    scopes that hold the row) for the second. Questions of one scope are scored together, and only against
    the rows it allows.
    """
    out = T.StructType(
        [
            T.StructField("qid", questions.schema["qid"].dataType),
            T.StructField("id", stored.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return rank(_scored(questions, stored, lambda head: TopK(head, dim, k), block_rows, slice_rows, out), k)


def above(questions: DataFrame, stored: DataFrame, floor: float, dim: int, block_rows: int = BLOCK_ROWS, slice_rows: int = OPEN_SLICE_ROWS) -> DataFrame:
    """All (qid, id, score) with a cosine of at least ``floor``, however many a question has."""
    out = T.StructType([T.StructField("qid", questions.schema["qid"].dataType), T.StructField("id", stored.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return _scored(questions, stored, lambda head: _Above(head, dim, floor), block_rows, slice_rows, out)


class _Above:
    """Pairs at or above a floor; they leave the task batch by batch."""

    def __init__(self, questions: pd.DataFrame, dim: int, floor: float):
        self.qid, self.q, self.dim, self.least = questions["qid"].to_numpy(), _matrix(questions, dim), dim, floor
        self.found: list[pd.DataFrame] = []

    def add(self, frame: pd.DataFrame) -> None:
        scores = np.round(self.q @ _matrix(frame, self.dim).T, SCORE_DIGITS)
        j, i = np.nonzero(scores >= self.least)
        self.found.append(pd.DataFrame({"qid": self.qid[j], "id": frame["id"].to_numpy()[i], "score": scores[j, i]}))

    def frame(self) -> pd.DataFrame:
        found, self.found = self.found, []
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"qid": self.qid[:0], "id": [], "score": []})


def _scored(questions, stored, scorer, block_rows, slice_rows, out) -> DataFrame:
    """Rows of a scorer per block of questions, over all stored vectors."""
    head = questions.limit(block_rows + 1).toPandas()
    if len(head) > block_rows:
        return _block_pairs(questions, stored, scorer, block_rows, slice_rows, out)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if head.empty:
            return
        found = scorer(head)
        for frame in batches:
            if len(frame):
                found.add(frame)
                if isinstance(found, _Above):
                    yield found.frame().astype({"score": "float64"})
        yield found.frame().astype({"score": "float64"})

    return stored.mapInPandas(scan, out)


def _block_pairs(questions, stored, scorer, block_rows, slice_rows, out) -> DataFrame:
    """Score hash blocks of questions against hash slices of vectors, one pair per group.

    Both sides may come from one table and share its columns, which a cogroup then hands over once only, so
    the columns of the stored side get names of their own.
    """
    nq = max(1, -(-questions.count() // block_rows))
    nv = max(1, -(-stored.count() // slice_rows))
    q = questions.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(nq)))
    q = q.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(nv - 1)), lambda s: F.col("_b") * nv + s)))
    v = stored.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(nv)))
    v = v.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(nq - 1)), lambda b: b * nv + F.col("_s"))))
    v = v.drop("_s").withColumnsRenamed({c: f"_v_{c}" for c in stored.columns})

    names = stored.columns

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        top, right = scorer(left), right.rename(columns={f"_v_{c}": c for c in names})
        for at in range(0, len(right) if len(left) else 0, 10_000):
            top.add(right.iloc[at : at + 10_000])
        return top.frame().astype({"score": "float64"})

    return q.drop("_b").groupBy("pair").cogroup(v.groupBy("pair")).applyInPandas(score, out)


def dense_candidates(questions: DataFrame, stored: DataFrame, k: int = K.DENSE_K, dim: int = K.HASH_DIM) -> DataFrame:
    """Dense list of a question table: (qid, clause_id, dense_score, dense_rank)."""
    hits = top_k(questions, stored, k, dim)
    return hits.select("qid", F.col("id").alias("clause_id"), F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))


def mean_pool(vectors: DataFrame, key: str = "key") -> DataFrame:
    """Unit-length mean of the vectors of each key; vectors of another length than the first are skipped.

    Averaging is per position, so partial aggregation carries the load of a large key.
    """
    from clausespark.functions.vectors import unit

    dims = vectors.groupBy(key).agg(F.min_by(F.size("vector"), "ord").alias("dim"))
    kept = vectors.join(dims, key).where(F.size("vector") == F.col("dim"))
    cells = kept.select(key, F.posexplode("vector").alias("pos", "value"))
    means = cells.groupBy(key, "pos").agg(F.avg("value").alias("m"))
    packed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms"))
    return packed.select(key, unit(F.transform("ms", lambda s: s["m"])).alias("vector"))
