"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's 3-word shingles. Two fingerprints that
differ in at most three of 64 bits agree in one of four 16-bit blocks, so only fingerprints that share a block
value are compared. Sorted by (block, value, Gray rank), neighbours differ in few bits. Runs of eight
fingerprints get a parent that stores the bits all of them share (a mask and a pattern), eight parents get one
in turn, and so on. A search goes down pairs of nodes; the bits in which two patterns differ under both masks
are a lower bound for everything below, and a pair whose bound exceeds the radius is dropped as a whole.

The sorted list is cut into tiles of ``TILE`` rows, one index each. A block value of more rows spans tiles; for
it the nodes of the tiles themselves form the upper level: pairs of tiles are pruned by the same bound and only
the rest are searched. So no task depends on how many fingerprints share a value. Searches join what they link
in a local forest and emit at most one link per fingerprint, which keeps groups of near copies from giving all
their pairs. Components of the links are found by alternating stars, each round a written table.

Defined cases: a text of one or two words is one shingle; a text without words, or null, has fingerprint 0,
linked like any other; equal texts have equal fingerprints, so a group of copies is one entry; null doc_ids
take part but never name a component, which is null only if no doc_id in it is set; repeated rows come out
repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import ascii_lower, join_counted, ordered_positions, own_columns, split_words
from clausespark.llm.votes import hex16, tally
from clausespark.session import cut_lineage, ship_package

SPACES = r"\x20\x09-\x0D"
SHINGLE = 3
RADIUS = 3
TILE = 1 << 15
FAN = 8
SLICE = 1 << 14


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each run of ``size`` words, of the whole list if it is shorter; empty if there are none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(size)])))
    return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, copies): one row per distinct doc_id and text, ``copies`` input rows each."""
    t = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), split_words(ascii_lower(F.col("text")), SPACES).alias("__w"))
    t = t.select("doc_id", "text_hash", F.posexplode_outer(shingle_hashes(F.col("__w"))).alias("__pos", "__h0"))
    return tally(t, ["doc_id", "text_hash"]).withColumnRenamed("fp0", "fp")


def gray_rank(bits: Column) -> Column:
    """Place of a bit pattern in the reflected Gray sequence: the prefix parities of its bits."""
    for s in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, s))
    return bits


class Forest:
    """Components of the rows of one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            np.minimum.at(self.root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while not np.array_equal(above := self.root[self.root], self.root):
                self.root = above


class Index:
    """Trees of shared bits over fingerprints sorted by (group, Gray rank), one tree per group."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.levels = [(fp, fp, group, np.arange(len(fp)), np.ones(len(fp), dtype=np.int64))]
        while True:
            low, high, group, _, _ = self.levels[-1]
            begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[begins, len(group)])
            if (sizes == 1).all():
                return
            place = np.arange(len(group)) - np.repeat(begins, sizes)
            starts = np.flatnonzero(place % FAN == 0)
            self.levels.append((np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts), group[starts], starts, np.diff(np.r_[starts, len(group)])))

    def roots(self, level: int) -> np.ndarray:
        """Nodes of a level that are alone in their group, though the level below is not."""
        _, _, group, _, sizes = self.levels[level]
        single = np.r_[True, group[1:] != group[:-1]] & np.r_[group[1:] != group[:-1], True]
        return np.flatnonzero(single & (sizes > 1))

    def search(self, radius: int, forest: Forest, pairs: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Link all fingerprints within the radius below the given (level, nodes, nodes)."""
        work = [(level, a[i:i + SLICE], b[i:i + SLICE]) for level, a, b in pairs for i in range(0, len(a), SLICE)]
        grid_a, grid_b = np.repeat(np.arange(FAN), FAN), np.tile(np.arange(FAN), FAN)
        while work:
            level, a, b = work.pop()
            _, _, _, starts, sizes = self.levels[level]
            low, high = self.levels[level - 1][:2]
            ok = (grid_a < sizes[a][:, None]) & (grid_b < sizes[b][:, None])
            ok &= (a != b)[:, None] | (grid_a < grid_b if level == 1 else grid_a <= grid_b)
            row, cell = np.nonzero(ok)
            a, b = starts[a[row]] + grid_a[cell], starts[b[row]] + grid_b[cell]
            shared = ~((low[a] ^ high[a]) | (low[b] ^ high[b]))
            near = np.bitwise_count((low[a] ^ low[b]) & shared) <= radius
            a, b = a[near], b[near]
            if level == 1:
                forest.join(a, b)
            else:
                work += [(level - 1, a[i:i + SLICE], b[i:i + SLICE]) for i in range(0, len(a), SLICE)]


def _links(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows (part, other, side, rank, fp) of whole parts to links (a, b): inside side 0 of a part, or between its sides 1 and 2."""
    columns = [[f[c].to_numpy() for c in ("part", "other", "side", "rank", "fp")] for f in frames if len(f)]
    if not columns:
        return
    part, other, side, rank, fp = (np.concatenate(c).astype(np.int64) for c in zip(*columns))
    order = np.lexsort((rank.view(np.uint64), side, other, part))
    part, other, side, fp = part[order], other[order], side[order], fp[order].view(np.uint64)
    number = np.cumsum(np.r_[False, (part[1:] != part[:-1]) | (other[1:] != other[:-1])])
    index, forest = Index(fp, number * 4 + side), Forest(len(fp))
    equal = np.unique(fp, return_inverse=True)[1]
    first = np.full(equal.max() + 1, len(fp))
    np.minimum.at(first, equal, np.arange(len(fp)))
    forest.join(np.arange(len(fp)), first[equal])  # a fingerprint comes once for each of its blocks
    pairs = []
    for level in range(1, len(index.levels)):
        roots = index.roots(level)
        roots = roots[index.levels[level][2][roots] % 4 == 0]
        pairs.append((level, roots, roots))
    top = len(index.levels) - 1
    group = index.levels[top][2]
    ones, twos = np.flatnonzero(group % 4 == 1), np.flatnonzero(group % 4 == 2)
    _, i, j = np.intersect1d(group[ones] // 4, group[twos] // 4, return_indices=True)
    if top:
        pairs.append((top, ones[i], twos[j]))
    else:  # each part is one fingerprint on either side
        near = np.bitwise_count(fp[ones[i]] ^ fp[twos[j]]) <= radius
        forest.join(ones[i][near], twos[j][near])
    index.search(radius, forest, pairs)
    linked = np.flatnonzero(fp != fp[forest.root])
    yield pd.DataFrame({"a": fp[linked].view(np.int64), "b": fp[forest.root[linked]].view(np.int64)}).drop_duplicates()


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``radius`` bits (3 at most)."""
    ship_package(fps.sparkSession)
    blocks = F.array(*[F.shiftrightunsigned("fp", 16 * b).bitwiseAND(F.lit(0xFFFF)) + (b << 16) for b in range(4)])
    t = fps.select("fp", gray_rank(F.col("fp")).alias("rank"), F.explode(blocks).alias("block"))
    t = ordered_positions(t, [F.col("block"), F.col("rank")], pos="pos").withColumn("tile", F.floor(F.col("pos") / tile))
    t = cut_lineage(t.select("block", "tile", "rank", "fp"))
    part = F.shiftleft("tile", 18) + F.col("block")
    inside = t.select(part.alias("part"), F.lit(-1).cast("long").alias("other"), F.lit(0).alias("side"), "rank", "fp", "tile")
    # blocks that span tiles: the nodes of the tiles are the upper level
    nodes = t.groupBy("block", "tile").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"))
    spanning = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("block")
    span = cut_lineage(nodes.join(spanning, "block"))
    x, y = span.alias("x"), span.alias("y")
    shared = F.bitwise_not(F.col("x.low").bitwiseXOR(F.col("x.high")).bitwiseOR(F.col("y.low").bitwiseXOR(F.col("y.high"))))
    near = F.bit_count(F.col("x.low").bitwiseXOR(F.col("y.low")).bitwiseAND(shared)) <= radius
    pairs = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.tile") < F.col("y.tile"))).filter(near)
    ends = F.array(*[F.struct(F.col(f"{s}.tile").alias("tile"), F.lit(k).alias("side")) for k, s in ((1, "x"), (2, "y"))])
    pairs = pairs.select(F.col("x.block").alias("block"), (F.shiftleft("x.tile", 18) + F.col("x.block")).alias("part"), F.col("y.tile").alias("other"), F.explode(ends).alias("e"))
    across = t.join(pairs.select("block", "part", "other", "e.tile", "e.side"), ["block", "tile"]).select("part", "other", "side", "rank", "fp")
    search = lambda frames: _links(frames, radius)
    found = inside.repartition("tile").drop("tile").mapInPandas(search, "a long, b long")
    found = found.union(across.repartition("part", "other").mapInPandas(search, "a long, b long"))
    return found.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) with the smallest node of each component, by alternating large and small stars until only stars are left.

    Edges that are stars around their smallest node already take no round.
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v), u > v, has one smaller neighbour at most, which has none itself."""
    ends = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _classes(docs: DataFrame, radius: int, tile: int) -> DataFrame:
    """(doc_id, text_hash, fp, copies, root, component_id) per distinct doc_id and text."""
    t = cut_lineage(fingerprints(docs))
    fps = cut_lineage(t.groupBy("fp").agg(F.sum("copies").alias("n"), F.min("doc_id").alias("least")))
    roots = components(links(fps, radius, tile))
    fps = fps.join(roots, fps["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    names = fps.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.min("least").alias("component_id"))
    fps = join_counted(fps.drop("least"), names, "root", "members", ["fp"])
    return join_counted(t, fps, "fp", "n", ["doc_id", "text_hash"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id): one row per input row; component_id is the smallest reachable doc_id."""
    t = _classes(docs, radius, tile).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return t.select("doc_id", "text_hash", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def text_links(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) of text hashes: every text of a component to the smallest hash in it."""
    t = _classes(docs, radius, tile).select("root", F.col("text_hash").alias("a")).distinct()
    least = t.groupBy("root").agg(F.count(F.lit(1)).alias("__n"), F.min("a").alias("b"))
    return join_counted(t, least, "root", "__n", ["a"]).select("a", "b").filter("a <> b")


def keep_one(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``docs`` with one row per component: that of its smallest doc_id (of its smallest text hash if none is set)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("copies").alias("__copies"))
    stay = _classes(docs, radius, tile).groupBy("root").agg(F.min(order).alias("s")).select("s.__id", "s.__hash", "s.__copies")
    kept = own_columns(docs)
    t = docs.select(*kept, F.xxhash64("text").alias("__h"))
    t = t.join(cut_lineage(stay), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
    once, repeated = t.filter("__copies = 1"), t.filter("__copies > 1").dropDuplicates(["doc_id", "__h"])
    return once.unionByName(repeated).select(*kept)
