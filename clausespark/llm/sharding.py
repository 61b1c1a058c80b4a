"""Sharding by minimax contiguous partition.

Rows of equal text are an atomic group. Groups are ordered by their smallest doc_id; a running sum of bytes
gives each group an end on one line, and a shard is an interval between two ends. The smallest capacity for
which a greedy walk needs no more than the given number of shards is found by binary search, and the line is
cut for that capacity. Where the capacity leaves room, each cut goes to the end nearest to an equal share of
what is left, as long as the rest still fits, so no shard stays needlessly empty.

The walk asks only for the last end at or before a place. It is answered from a summary: the line in
``BINS`` equal bins with count, first and last end of each. An answer inside a bin is bounded from both sides;
as long as the bounds disagree, the bins that matter are cut finer by another aggregate. The driver never
holds more than about ``BINS`` summary rows per round, whatever the number of groups.

Everything is worked out on (text key, doc_id, count) and joined to the rows once, at the end.

Defined cases: null texts are one group of rows of 16 bytes, text_crc32 null; null doc_ids sort first; equal
rows tie and may swap slots; fewer groups than shards leave the last shards empty; an empty table gives an
empty result. Added columns replace input columns of the same
name; input columns that start with two underscores are not carried along.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausespark.llm.common import join_counted, ordered_positions, own_columns
from clausespark.session import Scratch, cut_lineage

SHARDS = 40
BINS = 16384
ROW_BYTES = 16
#: Rows of one doc_id and text up to which they are told apart in one task.
REPEATED = 1024


class Ends:
    """Places of group ends on the line, known as exactly as they were asked for."""

    def __init__(self, groups: DataFrame, end: str, bins: int = BINS):
        self.groups, self.end, self.bins = groups, end, bins
        self.total = groups.agg(F.max(end)).first()[0] or 0
        self.items: list[tuple[int, int, int, int]] = []  # first end, last end, count, width of the bin
        self.touched: set[int] = set()
        if self.total:
            self._fetch(groups, max(1, -(-self.total // bins)))

    def _fetch(self, rows: DataFrame, width: int) -> None:
        by = F.floor(F.col(self.end) / F.lit(width)) if width > 1 else F.col(self.end)
        got = rows.groupBy(by.alias("b")).agg(F.min(self.end), F.max(self.end), F.count(F.lit(1))).collect()
        self.items = sorted(self.items + [(r[1], r[2], r[3], width) for r in got])
        self.firsts = [x[0] for x in self.items]

    def refine(self) -> None:
        """Cut the bins that answers fell into finer, to about ``bins`` new ones altogether."""
        asked = [self.items[i] for i in self.touched]
        share = max(2, self.bins // len(asked))
        self.items = [x for i, x in enumerate(self.items) if i not in self.touched]
        exact = sum(x[2] for x in asked) <= self.bins
        for width in {x[3] for x in asked}:
            ids = [x[0] // width for x in asked if x[3] == width]
            rows = self.groups.filter(F.floor(F.col(self.end) / F.lit(width)).isin(ids))
            self._fetch(rows, 1 if exact else max(1, width // share))
        self.touched = set()

    def last(self, place: int, hopeful: bool = False) -> int:
        """The last end at or before ``place``, 0 if there is none; not below or, if hopeful, not above the true one."""
        i = bisect_right(self.firsts, place) - 1
        if i < 0:
            return 0
        first, last, n, _ = self.items[i]
        if place >= last:
            return last
        if n > 2:
            self.touched.add(i)
            return place if hopeful else first
        return first

    def after(self, place: int) -> int:
        """The first end behind ``place``; inside an unresolved bin its last end."""
        i = bisect_right(self.firsts, place) - 1
        if i >= 0 and place < self.items[i][1]:
            if self.items[i][2] > 2:
                self.touched.add(i)
            return self.items[i][1]
        return self.items[i + 1][0] if i + 1 < len(self.items) else self.total

    def touch_between(self, low: int, high: int) -> None:
        """Mark the unresolved bins that meet a stretch of the line."""
        for i in range(max(0, bisect_right(self.firsts, low) - 1), bisect_right(self.firsts, high)):
            if self.items[i][2] > 2 and self.items[i][1] > low:
                self.touched.add(i)


def _fits(ends: Ends, capacity: int, shards: int, start: int = 0, hopeful: bool = False) -> bool:
    for _ in range(shards):
        if start + capacity >= ends.total:
            return True
        stop = ends.last(start + capacity, hopeful)
        if stop <= start:
            return False
        start = stop
    return start >= ends.total


def _least(ends: Ends, shards: int, hopeful: bool) -> int:
    low, high = -(-ends.total // shards), ends.total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _fits(ends, mid, shards, hopeful=hopeful) else (mid + 1, high)
    return low


def least_capacity(ends: Ends, shards: int) -> int:
    """The smallest capacity with which a greedy walk needs at most ``shards`` intervals."""
    while True:
        low, high = _least(ends, shards, True), _least(ends, shards, False)
        if low == high:
            ends.touched = set()
            return low
        ends.touched, a, b = set(), 0, 0
        for _ in range(shards):  # every walk with a capacity between the two stops in these stretches
            ends.touch_between(min(a + low, ends.total), min(b + high, ends.total))
            a, b = ends.last(a + low), ends.last(b + high, True)
        ends.refine()


def balanced_cuts(ends: Ends, shards: int, capacity: int) -> list[int]:
    """Ends at which the shards stop, none above ``capacity``, each as near to an even share of the rest as it can be."""
    while True:
        ends.touched, cuts, start = set(), [], 0
        for left in range(shards, 0, -1):
            if start >= ends.total:
                break
            aim = start + (ends.total - start) / left
            options = {ends.last(int(aim)), ends.after(int(aim)), ends.last(start + capacity)}
            options = [e for e in options if start < e <= start + capacity and _fits(ends, capacity, left - 1, e)]
            if not options:
                break
            start = min(options, key=lambda e: (abs(e - aim), e))
            cuts.append(start)
        if not ends.touched:
            return cuts
        ends.refine()


def shard(docs: DataFrame, shards: int = SHARDS, bins: int = BINS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot (place within the shard) and grown_shard (null under this law).

    ``keep`` names the input columns to carry along, doc_id among them; all by default.
    """
    out = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = own_columns(docs, *out) if keep is None else keep
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    t = docs.withColumns({"size": length + ROW_BYTES, "text_crc32": F.crc32(F.col("text").cast("binary"))})
    key = F.concat_ws(":", F.hex(F.xxhash64("text")), F.hex("text_crc32"), F.octet_length("text"))
    t = t.withColumn("__key", F.when(F.col("text").isNull(), F.lit("null")).otherwise(key)).select(*kept, "size", "text_crc32", "__key")
    with Scratch(docs.sparkSession) as scratch:
        # rows of equal doc_id and text are interchangeable: one class each, which takes as many places in turn
        classes = cut_lineage(t.groupBy("__key", "doc_id").agg(F.count(F.lit(1)).alias("__m"), F.sum("size").alias("__bytes")))
        groups = classes.groupBy("__key").agg(F.sum("__m").alias("__n"), F.count(F.lit(1)).alias("__classes"), F.sum("__bytes").alias("__bytes"), F.min("doc_id").alias("__least"))
        order = [F.col("__least").asc_nulls_first(), F.col("__key").asc()]
        groups = cut_lineage(ordered_positions(groups, order, {"__end": "__bytes", "__rows": "__n"}, "__place"))
        ends = Ends(groups, "__end", bins)
        cuts = balanced_cuts(ends, shards, least_capacity(ends, shards)) if ends.total else []
        stops = F.array(*[F.lit(c) for c in cuts[:-1]]).cast("array<bigint>")
        groups = groups.withColumn("shard", F.size(F.filter(stops, lambda c: c < F.col("__end"))))
        begins = groups.groupBy("shard").agg(F.min(F.col("__rows") - F.col("__n")).alias("__begin"))  # at most one row per shard
        classes = join_counted(classes, groups.select("__key", "__classes", "__place", "shard"), "__key", "__classes", ["doc_id"])
        classes = ordered_positions(classes, [F.col("__place"), F.col("doc_id").asc_nulls_first()], {"__upto": "__m"}, "__pos", ["__key", "doc_id", "__m", "shard"])
        classes = classes.join(F.broadcast(begins), "shard")
        classes = scratch.keep(classes.select("__key", F.col("doc_id").alias("__id"), "__m", "shard", (F.col("__upto") - F.col("__m") - F.col("__begin")).alias("__from")))
    t = t.join(classes.withColumnRenamed("__key", "__k"), (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    same = Window.partitionBy("__key", "doc_id").orderBy(F.lit(1))
    few = t.filter(F.col("__m") <= REPEATED).withColumn("__nth", F.row_number().over(same) - 1)
    out_columns = {"slot": F.col("__from") + F.col("__nth"), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    if classes.filter(F.col("__m") > REPEATED).isEmpty():
        return few.withColumns(out_columns).select(*kept, *out)
    many = ordered_positions(t.filter(F.col("__m") > REPEATED), [F.col("__key"), F.col("doc_id")], pos="__at")
    first = many.groupBy("__key", "doc_id").agg(F.min("__at").alias("__first")).select(F.col("__key").alias("__k"), F.col("doc_id").alias("__id"), "__first")
    many = many.drop("__k", "__id").join(first, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    many = many.withColumn("__nth", F.col("__at") - F.col("__first"))
    return few.withColumns(out_columns).select(*kept, *out).union(many.withColumns(out_columns).select(*kept, *out))
