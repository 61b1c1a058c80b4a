"""Vector functions: hashing-trick embeddings, cosine and normalisation."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausespark import constants as K
from clausespark.functions.text import _col, let


def hash_bucket(token: Column) -> Column:
    """sha256(token) modulo 384 without big integers.

    384 = 128 * 3: the residue modulo 128 is in the last byte. 16 = 1 modulo 3, so the residue modulo 3 is
    that of the digit sum, which follows from how many digits leave 1 and how many leave 2. The two combine
    by the Chinese remainder theorem.
    """

    def combine(digest: Column) -> Column:
        low = F.conv(F.substring(digest, 63, 2), 16, 10).cast("int") % 128
        ones = F.length(F.translate(digest, "0369cf258be", ""))
        twos = F.length(F.translate(digest, "0369cf147ad", ""))
        # 128 leaves 2 modulo 3 and 2 is its own inverse
        return low + F.lit(128) * F.pmod(F.lit(2) * (ones + F.lit(2) * twos - low), F.lit(3))

    return let(F.sha2(token, 256), combine)


def hash_vector(text: Column | str) -> Column:
    """Sparse unit vector as a struct of parallel arrays (idx, w); both empty for blank text."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def weigh(sorted_: Column) -> Column:
        idx = F.array_distinct(sorted_)
        # in a sorted list the run of a value ends where the next one starts
        starts = F.concat(F.transform(idx, lambda d: F.array_position(sorted_, d)), F.array((F.size(sorted_) + 1).cast("bigint")))
        counts = let(starts, lambda st: F.transform(idx, lambda _, i: (F.get(st, i + 1) - F.get(st, i)).cast("double")))
        return F.struct(idx.alias("idx"), counts.alias("n"))

    def scale(p: Column) -> Column:
        norm = F.sqrt(F.aggregate(p["n"], F.lit(0.0), lambda a, c: a + c * c))
        return let(
            F.struct(p.alias("p"), norm.alias("norm")),
            lambda s: F.struct(
                s["p"]["idx"].alias("idx"), F.transform(s["p"]["n"], lambda c: c / s["norm"]).alias("w")
            ),
        )

    return let(let(F.array_sort(F.transform(words, hash_bucket)), weigh), scale)


_WORDS = re.compile(r"\w+")
_CACHE_WORDS, _CACHE_LETTERS = 100_000, 64


class _Buckets(dict):
    """Buckets of words already seen, bounded in number and length of words."""

    def __missing__(self, word: str) -> int:
        b = int.from_bytes(hashlib.sha256(word.encode("utf-8")).digest(), "big") % K.HASH_DIM
        if len(word) <= _CACHE_LETTERS:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = b
        return b


@F.pandas_udf(T.StructType([T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(T.DoubleType()))]))
def hash_vectors(texts: pd.Series) -> pd.DataFrame:
    """``hash_vector`` for whole columns of long texts, in Arrow batches.

    Words repeat, so each worker process keeps the buckets of words it has seen, up to a bound. Texts are counted
    in groups of ``_COUNTED`` words or a little more, so a batch of long texts needs no more memory than a short one.
    """
    bucket = _seen_buckets().__getitem__
    idx: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    at: list[int] = []
    sizes: list[int] = []
    for text in texts:
        before = len(at)
        at.extend(map(bucket, _WORDS.findall((text or "").lower())))
        sizes.append(len(at) - before)
        if len(at) >= _COUNTED:
            _count(at, sizes, idx, weights)
    _count(at, sizes, idx, weights)
    return pd.DataFrame({"idx": idx, "w": weights})


_COUNTED = 200_000


def _count(at: list[int], sizes: list[int], idx: list[np.ndarray], weights: list[np.ndarray]) -> None:
    """Append (idx, w) of the texts whose buckets lie one after the other in ``at``, and empty the lists."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys, n = np.unique(owner * K.HASH_DIM + np.asarray(at, dtype=np.int64), return_counts=True)
    owner = keys // K.HASH_DIM
    norm = np.sqrt(np.bincount(owner, weights=n * n, minlength=len(sizes)))
    ends = np.searchsorted(owner, np.arange(1, len(sizes)))
    idx.extend(np.split((keys % K.HASH_DIM).astype(np.int32), ends) if sizes else [])
    weights.extend(np.split(n / norm[owner], ends) if sizes else [])
    at.clear()
    sizes.clear()


def _seen_buckets(store: _Buckets = _Buckets()) -> _Buckets:  # noqa: B008
    """The word cache of this worker process."""
    return store


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two (idx, w) structs."""
    return let(
        F.map_from_arrays(b["idx"], b["w"]),
        lambda m: F.aggregate(
            F.arrays_zip(a["idx"].alias("idx"), a["w"].alias("w")),
            F.lit(0.0),
            lambda acc, x: acc + x["w"] * F.coalesce(F.try_element_at(m, x["idx"]), F.lit(0.0)),
        ),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two double arrays; 0 for empty or unequal lengths, a zero norm counts as one."""
    x, y = _col(a), _col(b)
    norm = lambda v: F.sqrt(dot(v, v))
    one = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    ok = (F.size(x) > 0) & (F.size(x) == F.size(y))
    return F.when(ok, dot(x, y) / (one(x) * one(y))).otherwise(0.0)


def unit(vector: Column) -> Column:
    n = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda v: v / F.when(n == 0, 1.0).otherwise(n))


DIM = K.HASH_DIM
