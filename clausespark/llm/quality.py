"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One score s = w . x is shared by all grades; ordered thresholds cut it: P(grade <= k) = sigmoid(threshold_k - s).
x marks which hashed tokens a whole text holds: its words, its runs of punctuation, and coarse classes of
letter case, symbol share, repeated lines and repeated words. The expected grade ranks documents; the tail
probability, that of the highest grade, selects them.

The grade of a labelled document is 0 if it is toxic, else 1, or 2 if its quality is good; of contradicting
labels the worst counts. At most ``SAMPLE`` labelled documents outside the held-out quarter, those with the smallest
hash of doc_id, are learned from; their token numbers, not their texts, come to the driver.

Defined cases: a null text is empty and has no tokens but the classes; documents without a label are scored
like others; with no labelled document every score is null and nothing is selected; repeated rows get equal
results; an empty table gives an empty result; added columns replace input columns of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import own_columns, unit_hash
from clausespark.llm.language_id import held_out
from clausespark.session import ship_package

BUCKETS = 1 << 18
GRADES = 3
SAMPLE = 8000
EPOCHS, BATCH, RATE, SHRINK = 15, 64, 0.2, 2e-3
#: Buckets that fewer documents of the sample hold keep the weight 0; rare ones would only be learned by heart.
LEAST_DOCUMENTS = 5
SELECT_FROM = 0.5
TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens_of(text: str) -> list[int]:
    """Distinct hash buckets of a whole text."""
    found = {t.lower() for t in TOKEN.findall(text)}
    words, lines = text.split(), [line for line in text.split("\n") if line]
    n = max(1, len(text))
    level = lambda x: min(9, int(x * 10))
    found |= {
        f"\0upper{level(sum(map(str.isupper, text)) / n)}", f"\0symbol{level(5 * sum(text.count(c) for c in '!|$%#*&@') / n)}",
        f"\0lines{level(1 - len(set(lines)) / max(1, len(lines)))}", f"\0words{level(1 - len(set(words)) / max(1, len(words)))}", f"\0length{len(words).bit_length()}",
    }
    return sorted({zlib.crc32(t.encode()) % BUCKETS for t in found})


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray  # ordered thresholds between the grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """(n, grades) from scores."""
        below = _sigmoid(self.cuts - score[:, None])
        return np.diff(np.c_[np.zeros(len(score)), below, np.ones(len(score))], axis=1)

    def score(self, tokens: list[np.ndarray]) -> np.ndarray:
        return _sums(self.weights, tokens)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sums(weights: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(t) for t in tokens])
    totals = np.r_[0, np.cumsum(weights[np.concatenate(tokens)], dtype=np.float64)]
    ends = np.cumsum(sizes)
    return totals[ends] - totals[ends - sizes]


def gradients(score: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Derivatives of the negative log likelihood by each score and by the cuts, and its sum."""
    at = np.c_[np.full(len(score), -np.inf), np.tile(cuts, (len(score), 1)), np.full(len(score), np.inf)]
    rows = np.arange(len(score))
    low, high = _sigmoid(at[rows, grade] - score), _sigmoid(at[rows, grade + 1] - score)
    low[grade == 0], high[grade == len(cuts)] = 0, 1
    p = np.maximum(high - low, 1e-9)
    slope_low, slope_high = low * (1 - low), high * (1 - high)
    by_cut = np.zeros(len(cuts) + 2)
    np.add.at(by_cut, grade, slope_low / p)
    np.add.at(by_cut, grade + 1, -slope_high / p)
    return (slope_high - slope_low) / p, by_cut[1:-1], float(-np.log(p).sum())


def train(tokens: list[np.ndarray], grade: np.ndarray, grades: int = GRADES, seed: int = 0) -> Model | None:
    """Stochastic gradients with a step per weight (AdaGrad); the cuts stay in order. None without rows.

    Weights shrink by a constant at each step, so tokens that do not pull one way consistently stay at 0.
    """
    if not len(tokens):
        return None
    held = np.bincount(np.concatenate(tokens), minlength=BUCKETS) >= min(LEAST_DOCUMENTS, len(tokens))
    common = [t[held[t]] for t in tokens]
    share = np.cumsum(np.bincount(grade, minlength=grades))[:-1] / len(grade)
    cuts = np.maximum.accumulate(np.log((share + 0.01) / (1.01 - share))) + np.arange(grades - 1) * 1e-3
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    cut_seen = np.full(grades - 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(tokens)), max(1, len(tokens) // BATCH)):
            batch = [common[i] for i in rows]
            by_score, by_cut, _ = gradients(_sums(w, batch), grade[rows], cuts)
            used, place = np.unique(np.concatenate(batch), return_inverse=True)
            g = np.bincount(place, np.repeat(by_score, [len(t) for t in batch])) / len(rows)
            seen[used] += g * g
            step = RATE / np.sqrt(seen[used])
            moved = w[used] - step * g
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * SHRINK, 0)
            by_cut = by_cut / len(rows)
            cut_seen += by_cut * by_cut
            cuts = np.maximum.accumulate(cuts - RATE * by_cut / np.sqrt(cut_seen) + np.arange(grades - 1) * 1e-6)
    return Model(w.astype(np.float32), cuts)


def hashed(texts: DataFrame) -> DataFrame:
    """(doc_id, tokens) of whole texts."""
    ship_package(texts.sparkSession)

    @F.pandas_udf("array<int>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([tokens_of(x or "") for x in column])

    return texts.select("doc_id", tokens("text").alias("tokens"))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade), the worst grade of each labelled document."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    chosen = graded(labels).where(~held_out()).withColumn("u", unit_hash("doc_id", seed=7)).orderBy("u", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    rows = hashed(texts).join(chosen.select("doc_id", "grade"), "doc_id").orderBy("doc_id").collect()  # at most ``sample``
    return train([np.array(r["tokens"], dtype=np.int64) for r in rows], np.array([r["grade"] for r in rows], dtype=np.int64))


def rate(docs: DataFrame, model: Model | None, select_from: float = SELECT_FROM) -> DataFrame:
    """``docs`` with expected_grade (0 to 2), top_probability and selected."""
    out = ("expected_grade", "top_probability", "selected")
    kept = own_columns(docs, *out)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(*kept, none.alias(out[0]), none.alias(out[1]), F.lit(False).alias(out[2]))
    ship_package(docs.sparkSession)

    @F.pandas_udf("struct<expected: double, top: double>")
    def grades(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            p = model.probabilities(model.score([np.array(tokens_of(x or ""), dtype=np.int64) for x in column])) if len(column) else np.zeros((0, GRADES))
            yield pd.DataFrame({"expected": p @ np.arange(p.shape[1]), "top": p[:, -1]})

    t = docs.select(*kept, grades("text").alias("__g"))
    return t.select(*kept, F.col("__g.expected").alias(out[0]), F.col("__g.top").alias(out[1]), (F.col("__g.top") >= select_from).alias(out[2]))
