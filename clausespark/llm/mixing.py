"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Whole copies of all its documents are certain as far as they fit; the
words still missing are drawn: a document's rank is the odds of a uniform random number divided by its
inclusion odds, and the smallest ranks are taken until the words are used up (Rosen's Pareto sampling, with a
size fixed in words). Inclusion odds are proportional to a size measure, a power of the word count; a
constant factor in the odds does not change the order, so the cut itself calibrates the probabilities.

Ranks are cut without sorting a source. Each source has about one rank bucket per ``BUCKET_ROWS`` documents;
the sums of the buckets show which one holds the cut, and only that bucket is ordered by row. In it, documents
are taken in rank order and those that do not fit are passed over. If room is left, the buckets behind the cut
are summed again over the documents that still fit, which gives the next cut, until no document left fits.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; documents of size
0 have no words to take (taken 0; copies as the certain ones); a null doc_id and repeated doc_ids are ranked by
a hash of doc_id and text, so repeated rows tie and which of them is taken makes no difference; an empty table
gives an empty result. Added columns replace input columns of the same name; input columns that
start with two underscores are not carried along.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark.llm.common import own_columns, unit_hash
from clausespark.session import cut_lineage, ship_package

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BUCKET_ROWS = 1000
SIZE_POWER = 0.5
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, ...) with ``target``: ``share`` of all sizes by repeating weights, at most ``most`` times a source.

    A source is capped if the level (words per weight) of those left lies above its cap per weight. With the
    sources ordered by cap per weight, the level is the first one that the next source does not cap.
    The table has one row per source, the product of an aggregate, and is put in order in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("__w", F.element_at(wheel, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    t = t.withColumn("__cap", F.col("source_size") * F.lit(float(most))).withColumn("__r", F.col("__cap") / F.col("__w"))
    by = Window.orderBy("__r", F.col("source").isNull(), F.col("source"))
    below, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    t = t.withColumn("__level", (total - F.coalesce(F.sum("__cap").over(below), F.lit(0.0))) / F.sum("__w").over(rest))
    t = t.withColumn("__at", F.min(F.when(F.col("__level") <= F.col("__r"), F.struct("__r", "__level"))).over(whole)["__level"])
    target = F.when(F.col("__at").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__at") * F.col("__w")))
    return t.withColumn("target", target).drop("__w", "__cap", "__r", "__level", "__at")


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, size_power: float = SIZE_POWER) -> DataFrame:
    """``docs`` with size, source_size, target (of the row's source), copies and taken (words: copies times size)."""
    out = ("size", "source_size", "target", "copies", "taken")
    kept = own_columns(docs, *out)
    t = docs.select(*kept).withColumn("size", word_count(F.col("text")))
    # odds of the random number over odds of inclusion, relative to those of a document of average measure
    u = unit_hash("doc_id", F.xxhash64("text"), seed=seed)
    measure = F.pow(F.greatest(F.col("size"), F.lit(1)).cast("double"), F.lit(float(size_power)))
    t = t.withColumns({"__odds": u / (1 - u), "__m": measure})
    sums = t.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n"), F.avg("__m").alias("__avg"))
    sums = cut_lineage(source_targets(sums, weights, share, most))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    sources = sums.withColumn("__s", key).drop("source")
    t = t.withColumn("__s", key).join(sources, "__s")
    t = t.withColumn("__rank", F.col("__odds") / (F.col("__m") / F.col("__avg")))
    t = t.withColumn("__bucket", F.floor(F.col("__rank") / (1 + F.col("__rank")) * F.ceil(F.col("__n") / BUCKET_ROWS)))
    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0))
    t = t.withColumns({"__certain": certain, "__left": F.floor(F.col("target") - certain * F.col("source_size") + 1e-6)})

    passes, edge = fill(cut_lineage(t.select("__s", "__left", "__bucket", "__rank", "size")))
    t = t.join(passes, "__s", "left")
    at_cut = F.coalesce(F.exists("__passes", lambda p: p["cut"] == F.col("__bucket")), F.lit(False))
    reached = lambda p: (F.col("__bucket") > p["after"]) & (p["cut"].isNull() | (F.col("__bucket") < p["cut"])) & (F.col("size") <= p["room"]) & (F.col("size") > 0)
    sure = t.filter(~at_cut).withColumn("__drawn", F.coalesce(F.exists("__passes", reached), F.lit(False)))
    tied = Window.partitionBy("__s", "__bucket", "__rank", "size").orderBy(F.lit(1))
    edges = t.filter(at_cut).join(edge, ["__s", "__bucket", "__rank", "size"], "left")
    edges = edges.withColumn("__drawn", F.coalesce(F.row_number().over(tied) <= F.col("__drawn_rows"), F.lit(False))).drop("__drawn_rows")
    t = sure.unionByName(edges)
    t = t.withColumn("copies", (F.col("__certain") + F.col("__drawn").cast("int")).cast("int"))
    t = t.withColumn("taken", F.col("copies") * F.col("size"))
    return t.select(*kept, *out)


def fill(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is drawn of ``rows`` (__s, __left, __bucket, __rank, size) in rank order, documents that do not fit passed over.

    First (__s, __passes), the array of (after, cut, room) of each source: of the buckets between after and cut
    (all, if null) every document of at most room words is drawn. Then (__s, __bucket, __rank, size,
    __drawn_rows) of the buckets that hold a cut.
    """
    ship_package(rows.sparkSession)

    @F.pandas_udf("array<boolean>")
    def fitting(sizes: pd.Series, room: pd.Series) -> pd.Series:
        out = []
        for row, left in zip(sizes, room):
            drawn = []
            for n in row:
                drawn.append(bool(n <= left))
                left -= n * drawn[-1]
            out.append(drawn)
        return pd.Series(out)

    before = Window.partitionBy("__s").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    state = rows.filter("__left > 0").select("__s", F.lit(-1).cast("long").alias("after"), F.col("__left").cast("long").alias("room")).distinct()
    every, edges = None, None
    while True:
        state = cut_lineage(state)
        fits = rows.join(state, "__s").filter((F.col("__bucket") > F.col("after")) & (F.col("size") <= F.col("room")) & (F.col("size") > 0))
        sums = fits.groupBy("__s", "after", "room", "__bucket").agg(F.sum("size").alias("sum"))
        sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        cut = F.min(F.when(F.col("before") + F.col("sum") > F.col("room"), F.struct(F.col("__bucket").alias("cut"), (F.col("room") - F.col("before")).alias("start"))))
        cuts = cut_lineage(sums.groupBy("__s", "after", "room").agg(cut.alias("c")).select("__s", "after", "room", "c.cut", "c.start"))
        held = fits.drop("after", "room").join(cuts.select("__s", F.col("cut").alias("__bucket"), "start"), ["__s", "__bucket"])
        held = held.groupBy("__s", "__bucket", "start").agg(F.array_sort(F.collect_list(F.struct("__rank", "size"))).alias("row"))
        held = held.withColumn("drawn", fitting("row.size", "start"))
        taken = held.select("__s", "__bucket", "start", F.explode(F.arrays_zip("row", "drawn")).alias("x"))
        taken = taken.select("__s", "__bucket", "start", "x.row.*", F.col("x.drawn").cast("int").alias("n"))
        edge = cut_lineage(taken.groupBy("__s", "__bucket", "start", "__rank", "size").agg(F.sum("n").alias("__drawn_rows")))
        every = cuts if every is None else every.union(cuts)
        edges = edge if edges is None else edges.union(edge)
        left = edge.groupBy("__s", F.col("__bucket").alias("after"), "start").agg(F.sum(F.col("size") * F.col("__drawn_rows")).alias("words"))
        state = left.select("__s", "after", (F.col("start") - F.col("words")).alias("room")).filter("room > 0")
        if cuts.filter("cut IS NOT NULL").isEmpty():
            break
    passes = every.groupBy("__s").agg(F.collect_list(F.struct("after", "cut", "room")).alias("__passes"))
    return cut_lineage(passes), edges.drop("start").filter("__drawn_rows > 0")


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` say; rows of none go."""
    return mixed.filter("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__i")
