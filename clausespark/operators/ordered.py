"""Running values over long ordered groups.

A group is cut into blocks of consecutive positions. Windows run inside one (group, block) pair, block
totals are combined over the short list of blocks, and both are added up. No task ever holds a whole
group, so one group may carry any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark.session import cut_lineage

BLOCK = 8192


def _windows(key: str, pos: str):
    local = Window.partitionBy(key, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return local, before


def dense_positions(df: DataFrame, key: str, order: list[str], name: str = "pos") -> DataFrame:
    """0-based position of every row within its key, without gathering a key in one task.

    Rows are range-partitioned and sorted by key and order, so a large key spreads over partitions. The
    row number inside each partition plus the sizes of the partitions before give a global number, and the
    smallest one of a key turns it into a position.
    """
    ids = F.monotonically_increasing_id()
    t = df.orderBy(key, *order).withColumn("_part", F.shiftright(ids, 33)).withColumn("_row", ids.bitwiseAND(F.lit((1 << 33) - 1)))
    t = cut_lineage(t)
    sizes = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    t = t.join(starts, "_part").withColumn("_g", F.col("_start") + F.col("_row"))
    first = t.groupBy(key).agg(F.min("_g").alias("_first"))
    return t.join(first, key).withColumn(name, F.col("_g") - F.col("_first")).drop("_part", "_row", "_start", "_g", "_first")


def running(
    df: DataFrame, key: str, pos: str, sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None, following: dict[str, Column] | None = None, block: int = BLOCK,
) -> DataFrame:
    """Add running sums, running minima, last and next non-null values per key, up to and including each row.

    ``pos`` is an integer position, so a block holds at most ``block`` rows of a key. ``following``
    looks at later rows only.
    """
    sums, mins, last, following = sums or {}, mins or {}, last or {}, following or {}
    t = df.withColumn("_block", F.floor(F.col(pos) / block))
    t = t.withColumns({f"_v_{n}": c for d in (sums, mins, last, following) for n, c in d.items()})
    local, before = _windows(key, pos)
    ahead = Window.partitionBy(key, "_block").orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    after = Window.partitionBy(key).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    v = lambda n: F.col(f"_v_{n}")
    aggs = [F.sum(v(n)).alias(f"_b_{n}") for n in sums] + [F.min(v(n)).alias(f"_b_{n}") for n in mins]
    aggs += [F.max_by(v(n), F.when(v(n).isNotNull(), F.col(pos))).alias(f"_b_{n}") for n in last]
    aggs += [F.min_by(v(n), F.when(v(n).isNotNull(), F.col(pos))).alias(f"_b_{n}") for n in following]
    blocks = t.groupBy(key, "_block").agg(*aggs)
    carried = {f"_c_{n}": F.sum(f"_b_{n}").over(before) for n in sums}
    carried |= {f"_c_{n}": F.min(f"_b_{n}").over(before) for n in mins}
    carried |= {f"_c_{n}": F.last(f"_b_{n}", ignorenulls=True).over(before) for n in last}
    carried |= {f"_c_{n}": F.first(f"_b_{n}", ignorenulls=True).over(after) for n in following}
    blocks = blocks.withColumns(carried).drop(*[f"_b_{n}" for d in (sums, mins, last, following) for n in d])
    out = {n: F.sum(v(n)).over(local) for n in sums} | {n: F.min(v(n)).over(local) for n in mins}
    out |= {n: F.last(v(n), ignorenulls=True).over(local) for n in last}
    out |= {n: F.first(v(n), ignorenulls=True).over(ahead) for n in following}
    j = t.withColumns(out).join(blocks, [key, "_block"])
    merged = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums}
    merged |= {n: F.least(F.col(n), F.col(f"_c_{n}")) for n in mins}
    merged |= {n: F.coalesce(n, f"_c_{n}") for n in list(last) + list(following)}
    j = j.withColumns(merged)
    return j.drop("_block", *[c for n in (*sums, *mins, *last, *following) for c in (f"_v_{n}", f"_c_{n}")])
