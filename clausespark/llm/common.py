"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_KEYS = 256


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str) -> Column:
    """Maximal runs of characters outside ``separators`` (a regex class); a null text has no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), lambda w: w != "")


def unit_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A value strictly between 0 and 1 that depends on the columns and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def own_columns(df: DataFrame, *replaced: str) -> list[str]:
    """Columns to carry along: all but those an operator replaces and those that start with two underscores, which it uses itself."""
    return [c for c in df.columns if c.lower() not in replaced and not c.startswith("__")]


def row_key() -> Column:
    """A string that rows of equal doc_id and text share."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")))


def ordered_positions(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None, pos: str = "pos", carry: list[str] | None = None) -> DataFrame:
    """0-based place of every row in one global order, plus running sums up to and including the row.

    ``sums`` maps new columns to summed ones. Rows are range-partitioned and sorted; places and sums inside a
    partition are raised by the totals of the partitions before, of which there is one row each. Equal rows
    may lie in any order among themselves. No task holds more than one range. ``carry`` names the columns to
    keep once the rows are in order; all by default.
    """
    sums = sums or {}
    ids = F.monotonically_increasing_id()
    t = df.orderBy(*order).withColumns({"__part": F.shiftright(ids, 33), "__row": ids.bitwiseAND(F.lit((1 << 33) - 1))})
    t = cut_lineage(t if carry is None else t.select(*carry, "__part", "__row"))
    totals = t.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = {"__first": F.coalesce(F.sum("__n").over(before), F.lit(0))}
    carried |= {f"__c_{n}": F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)) for n in sums}
    totals = totals.withColumns(carried).select("__part", *carried)
    if sums:
        here = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        t = t.withColumns({n: F.sum(c).over(here) for n, c in sums.items()})
    t = t.join(totals, "__part").withColumns({pos: F.col("__first") + F.col("__row")} | {n: F.col(n) + F.col(f"__c_{n}") for n in sums})
    return t.drop("__part", "__row", *carried)


def join_counted(rows: DataFrame, lookup: DataFrame, key: str, count: str, spread: list[str]) -> DataFrame:
    """Left join of ``rows`` with one ``lookup`` row per key, where a few keys may hold most of the rows.

    ``count`` is a lookup column with the rows per key. A key with over 1/HOT_KEYS of all counted rows is hot,
    so at most HOT_KEYS keys are; only these are broadcast, and their rows are spread over the other join's
    partitions by ``spread`` in place of the key. Null keys match nothing.
    """
    values = [c for c in lookup.columns if c not in (key, count)]
    total = lookup.agg(F.sum(count)).scalar()
    hot = lookup.filter(F.col(count) * HOT_KEYS > total).select(key, F.struct(*values).alias("__hot"))
    t = rows.join(F.broadcast(hot), key, "left")
    spreader = F.xxhash64(*spread, F.lit(1)).cast(dict(rows.dtypes)[key])
    t = t.withColumn("__k", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spreader))
    cold = lookup.select(F.col(key).alias("__k"), F.struct(*values).alias("__cold"))
    t = t.join(cold, "__k", "left")
    found = F.when(F.col("__hot").isNotNull(), F.col("__hot")).when(F.col(key).isNotNull(), F.col("__cold"))
    return t.withColumn("__v", found).select(*[F.col(c) for c in rows.columns], *[F.col("__v")[c].alias(c) for c in values])
