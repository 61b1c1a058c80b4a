"""Near-duplicate embeddings by spherical-cap filters from structured random product codes.

A filter is a direction on the sphere: one code word from each of ``PARTS`` small random codebooks, put side by
side, after a rotation by random signs and a Hadamard transform that spreads every vector over its parts. A
vector falls into every filter whose inner product with it is at least ``HEIGHT``; which filters these are is
list-decoded from the code, part by part, following only prefixes that the best words of the remaining parts
can still lift over the threshold. A vector that no filter of a code catches goes to its best ones. There are
``CODES`` independent codes. Vectors that are near each other fall into mostly the same filters, so the vectors
of one label and filter are compared and the cosines of those pairs are verified in double precision.

Vectors that are equal, label by label, are one entry with a count. The entries of a (label, filter) are cut into
tiles of ``TILE`` rows in an order along one random direction, so near ones lie together; a pair of tiles is
compared only if its stretches on that line are close enough for the cosine, which is exact. A pair that
shares several filters is counted in the smallest of them only, so links are counted where they are found; what
leaves a task is a count per vector and a forest of links, never the pairs of a group.

The search is approximate: pairs of cosine 0.98 or more are found unless they share no filter. For random pairs
in 64 dimensions at exactly 0.98, the hardest ones, 0.999 were found, with 15 filters a vector.

Defined cases: vectors that are null, zero or hold a null or a non-finite component, and those of a null label,
link with nothing and name themselves; vectors of unequal length are not compared; rows with equal vectors are
linked with each other, also if they share a vec_id; a null vec_id takes part but never names a component, except where no vec_id
in it is set, when it is null; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import join_counted, ordered_positions
from clausespark.llm.gray_index import Forest, components
from clausespark.session import Scratch, cut_lineage, ship_package

COSINE = 0.98
CODES, PARTS, WORDS = 6, 2, 64
#: Least inner product, in standard deviations of that of a random unit vector.
HEIGHT = 3.2
#: A vector that no filter of a code reaches that high takes those of at least this share of its best.
NEARLY = 0.95
TILE = 1024
#: Vectors decoded at a time.
SLICE = 2048
SEED = 13


class Code:
    """A random product code for vectors of one length."""

    def __init__(self, dim: int, number: int = 0, parts: int = PARTS, words: int = WORDS, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, number])
        self.wide = max(parts, 1 << (dim - 1).bit_length())
        self.signs = rng.choice([-1.0, 1.0], (2, self.wide))
        words = min(words, 4 ** (self.wide // parts))
        book = rng.standard_normal((parts, words, self.wide // parts))
        self.book = book / np.linalg.norm(book, axis=2, keepdims=True) / np.sqrt(parts)
        self.parts, self.words, self.first = parts, words, number * words ** parts

    def rotate(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors, padded, after two rounds of random signs and a Hadamard transform."""
        x = np.pad(x, ((0, 0), (0, self.wide - x.shape[1])))
        for signs in self.signs:
            x, h = x * signs, 1
            while h < self.wide:
                x = x.reshape(len(x), -1, 2, h)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), -1)
                h *= 2
            x = x / np.sqrt(self.wide)
        return x

    def decode(self, x: np.ndarray, height: float = HEIGHT) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters at least ``height`` deviations up; of a row without any, those near its best."""
        y = self.rotate(x).reshape(len(x), self.parts, -1)
        scores = np.einsum("npd,pwd->npw", y, self.book)
        ahead = np.cumsum(scores.max(axis=2)[:, ::-1], axis=1)[:, ::-1]  # best of this part and the later ones
        ahead = np.c_[ahead, np.zeros(len(x))]
        least = np.minimum(height / np.sqrt(self.wide), ahead[:, 0] * NEARLY)
        row, word, score = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for p in range(self.parts):
            reach = score[:, None] + scores[row, p] + ahead[row, p + 1][:, None]
            i, w = np.nonzero(reach >= least[row][:, None])
            row, word, score = row[i], word[i] * self.words + w, score[i] + scores[row[i], p, w]
        return row, word + self.first


def filters(x: np.ndarray, codes: list[Code], height: float = HEIGHT) -> list[np.ndarray]:
    """The filters of each unit vector, ascending."""
    out: list[np.ndarray] = []
    for s in range(0, len(x), SLICE):
        found = [c.decode(x[s:s + SLICE], height) for c in codes]
        row, number = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((number, row))
        out += np.split(number[order].astype(np.int32), np.flatnonzero(np.diff(row[order])) + 1)
    return out


def line(dim: int) -> np.ndarray:
    """A random unit vector."""
    v = np.random.default_rng([SEED, dim]).standard_normal(dim)
    return v / np.linalg.norm(v)


def units(vectors: list, dtype=np.float64) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so nothing overflows."""
    x = np.stack([np.asarray(v, dtype=dtype) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: str, label: str) -> Column:
    whole = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    some = F.exists(vector, lambda v: F.coalesce(v != 0, F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & whole & some, F.lit(False))


def decoded(entries: DataFrame, height: float) -> DataFrame:
    """(e, at, filters): the filters of each entry (e, vector) in ascending order, and its place on a random line."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, list[Code]] = {}
        for f in frames:
            dims = f["vector"].map(len).to_numpy()
            for dim in np.unique(dims).tolist():
                own = f[dims == dim]
                if dim not in codes:
                    codes[dim] = [Code(dim, k) for k in range(CODES)]
                x = units(own["vector"].tolist())
                yield pd.DataFrame({"e": own["e"].to_numpy(), "at": x @ line(dim), "filters": filters(x, codes[dim], height)})

    return entries.select("e", "vector").mapInPandas(read, "e long, at double, filters array<int>")


def _compare(frames: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    """Rows (pair, filter, side, e, copies, filters, vector), pair by pair, to (e, other, n): links counted per entry, and one link in ``other``."""
    held: list[pd.DataFrame] = []
    for f in frames:
        held.append(f)
        f = pd.concat(held, ignore_index=True)
        last = (f["pair"] == f["pair"].iloc[-1]).to_numpy()
        if not last.all():
            yield from _pairs(f[~last], cosine)
        held = [f[last]]
    if held and len(held[0]):
        yield from _pairs(held[0], cosine)


def _pairs(f: pd.DataFrame, cosine: float) -> Iterator[pd.DataFrame]:
    dims = f["vector"].map(len).to_numpy()
    for dim in np.unique(dims):
        yield from _equal_length_pairs(f[dims == dim], cosine)


def _equal_length_pairs(f: pd.DataFrame, cosine: float) -> Iterator[pd.DataFrame]:
    pair, side = f["pair"].to_numpy(), f["side"].to_numpy()
    x, e, copies = units(f["vector"].tolist()), f["e"].to_numpy(), f["copies"].to_numpy(dtype=np.int64)
    here, lists = f["filter"].to_numpy(), f["filters"].to_numpy()
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(starts, np.r_[starts[1:], len(pair)]):
        inside = side[a] == 0 and side[b - 1] == 0
        one = np.arange(a, b) if inside else np.arange(a, b)[side[a:b] == 1]
        two = one if inside else np.arange(a, b)[side[a:b] == 2]
        if not len(one) or not len(two):
            continue
        i, j = np.nonzero(x[one] @ x[two].T >= cosine)
        if inside:
            i, j = i[i < j], j[i < j]
        i, j = one[i], two[j]
        if not len(i):
            continue
        forest = Forest(b - a)
        forest.join(i - a, j - a)
        first = smallest_shared(lists, i, j) == here[a]  # else the pair is counted in another filter
        n = np.zeros(b - a, dtype=np.int64)
        np.add.at(n, i[first] - a, copies[j[first]])
        np.add.at(n, j[first] - a, copies[i[first]])
        root = forest.root
        out.append((e[a:b], e[a:b][root], n))
    if out:
        t = pd.DataFrame({"e": np.concatenate([o[0] for o in out]), "other": np.concatenate([o[1] for o in out]), "n": np.concatenate([o[2] for o in out])})
        yield t[(t["n"] > 0) | (t["e"] != t["other"])]


def smallest_shared(lists: np.ndarray, i: np.ndarray, j: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """The smallest number that the ascending lists of i and j share."""
    used, place = np.unique(np.r_[i, j], return_inverse=True)
    wide = max(len(lists[k]) for k in used)
    table = np.full((len(used), wide), -1, dtype=np.int64)
    for k, u in enumerate(used):
        table[k, :len(lists[u])] = lists[u]
    i, j = place[:len(i)], place[len(i):]
    out = np.empty(len(i), dtype=np.int64)
    for s in range(0, len(i), block):
        a, b = table[i[s:s + block]], table[j[s:s + block]]
        least = np.full(len(a), np.iinfo(np.int64).max)
        for c in range(wide):
            v = a[:, c]
            hit = (v >= 0) & (b == v[:, None]).any(axis=1)
            least = np.where(hit, np.minimum(least, v), least)
        out[s:s + block] = least
    return out


def links(entries: DataFrame, cosine: float = COSINE, height: float = HEIGHT, tile: int = TILE) -> DataFrame:
    """(e, other, n) of ``entries`` (e, label, vector, copies): partial counts of links and links that join the components."""
    ship_package(entries.sparkSession)
    found = cut_lineage(decoded(entries, height))
    keys = found.join(entries.select("e", "label", F.size("vector").alias("dim")), "e")
    keys = keys.select("e", "at", "label", "dim", F.explode("filters").alias("filter"))
    group = F.concat_ws(":", F.col("label").cast("string"), F.col("dim").cast("string"), F.col("filter").cast("string"))
    t = ordered_positions(keys.select("e", "at", "filter", group.alias("g")), [F.col("g"), F.col("at"), F.col("e")])
    t = cut_lineage(t.select("e", "at", "filter", "g", F.floor(F.col("pos") / tile).alias("tile")))
    tiles = t.groupBy("g", "tile").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("rows"))
    tiles = cut_lineage(tiles)
    several = tiles.groupBy("g").agg(F.sum("rows").alias("n")).filter("n > 1").select("g")
    inside = tiles.filter("rows > 1").select("g", F.col("tile").alias("a"), F.col("tile").alias("b"))
    # tiles of one group in order: those whose stretches come nearer than vectors of the cosine can lie apart
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    x, y = tiles.alias("x"), tiles.alias("y")
    across = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.tile") < F.col("y.tile")) & (F.col("y.lo") <= F.col("x.hi") + F.lit(reach)))
    across = across.select(F.col("x.g").alias("g"), F.col("x.tile").alias("a"), F.col("y.tile").alias("b"))
    pairs = inside.union(across).join(several, "g", "left_semi").select("g", F.concat_ws("|", "g", "a", "b").alias("pair"), F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("tile"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("tile"), F.lit(1).alias("side")), F.struct(F.col("b").alias("tile"), F.lit(2).alias("side"))))).alias("s"))
    pairs = pairs.select("g", "pair", "s.tile", "s.side")
    asked = t.join(pairs, ["g", "tile"]).select("pair", "filter", "side", "e")
    whole = asked.join(entries.select("e", "copies", "vector").join(found.select("e", "filters"), "e"), "e")
    whole = whole.repartition("pair").sortWithinPartitions("pair", "side")
    return whole.select("pair", "filter", "side", "e", "copies", "filters", "vector").mapInPandas(lambda f: _compare(f, cosine), "e long, other long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, height: float = HEIGHT, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of (vec_id, embedding, label)."""
    with Scratch(vectors.sparkSession) as scratch:
        t = vectors.select("vec_id", "label", F.col("embedding").alias("vector"))
        ok = usable("vector", "label")
        alone = t.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        # equal vectors are one entry, named by two hashes; -0.0 and 0.0 are equal
        plain = F.transform("vector", lambda v: F.when(v == 0, F.abs(v)).otherwise(v))
        t = t.filter(ok).withColumn("vector", plain).withColumns({f"k{k}": F.xxhash64(F.lit(k), "label", "vector") for k in (1, 2)})
        rows = cut_lineage(t.select("vec_id", "k1", "k2"))
        entries = t.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
        entries = cut_lineage(ordered_positions(entries, [F.col("k1"), F.col("k2")], pos="e"))
        found = cut_lineage(links(entries, cosine, height, tile))
        counts = found.groupBy("e").agg(F.sum("n").alias("n"))
        roots = components(found.select("e", "other").filter("e <> other"), "e", "other").withColumnRenamed("node", "e")
        names = entries.select("e", "k1", "k2", "copies", "least").join(counts, "e", "left").join(roots, "e", "left").withColumn("root", F.coalesce("root", "e"))
        names = cut_lineage(names)
        least = names.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("__n"))
        names = join_counted(names, least, "root", "__n", ["e"])
        key = F.concat_ws(":", F.hex("k1"), F.hex("k2"))
        info = names.select(key.alias("key"), "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        linked = join_counted(rows.select("vec_id", key.alias("key")), info, "key", "copies", ["vec_id"])
        out = linked.select("vec_id", "n_links", "component_id").union(alone)
        return scratch.keep(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
