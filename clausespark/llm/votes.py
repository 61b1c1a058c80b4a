"""Bitwise votes of 64-bit hashes, as sums inside an aggregate.

Bits j and j + 32 of a hash are counted in the two halves of one long, so 32 sums count all 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = (1 << 32) + 1


def vote_sums(hash_: Column, weight: Column | None = None, prefix: str = "__b") -> list[Column]:
    """Aggregates that count, or add up the weights of, the hashes with each bit set (each count below 2**32)."""
    def lane(j: int) -> Column:
        bits = F.shiftrightunsigned(hash_, j).bitwiseAND(F.lit(LANES)) if j else hash_.bitwiseAND(F.lit(LANES))
        return F.sum(bits if weight is None else bits * weight).alias(f"{prefix}{j}")

    return [lane(j) for j in range(32)]


def majority(total: Column, prefix: str = "__b") -> Column:
    """The 64 bits whose count is over half of ``total``; 0 if there were no votes."""
    bits = F.lit(0).cast("bigint")
    for j in range(32):
        low = F.col(f"{prefix}{j}").bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(F.col(f"{prefix}{j}"), 32)
        for place, count in ((j, low), (j + 32, high)):
            one = 1 << place if place < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(count * 2 > total, F.lit(one)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def hex16(bits: Column) -> Column:
    """16 lowercase hex digits of a long read as unsigned."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def tally(terms: DataFrame, key: list[str], words: int = 1, weight: str | None = None) -> DataFrame:
    """(key, fp0.. fp{words-1}, copies) from exploded rows (key, __pos, __h0.., [weight]) of whole texts.

    Rows with an equal key must come from equal texts. Counting is kept apart per task, where it cannot
    overflow, and copies of a text, which all give the same fingerprint, are added up afterwards.
    """
    t = terms.withColumn("__task", F.spark_partition_id())
    total = F.count("__h0") if weight is None else F.sum(weight)
    sums = [s for i in range(words) for s in vote_sums(F.col(f"__h{i}"), None if weight is None else F.col(weight), f"__b{i}_")]
    first = F.count(F.when(F.coalesce(F.col("__pos"), F.lit(0)) == 0, 1)).alias("__copies")  # every row has one first term, or none at all
    t = t.groupBy(*key, "__task").agg(*sums, total.alias("__total"), first)
    t = t.select(*key, *[majority(F.col("__total"), f"__b{i}_").alias(f"fp{i}") for i in range(words)], "__copies")
    t = t.withColumns({f"fp{i}": F.coalesce(f"fp{i}", F.lit(0).cast("bigint")) for i in range(words)})
    return t.groupBy(*key).agg(*[F.first(f"fp{i}").alias(f"fp{i}") for i in range(words)], F.sum("__copies").alias("copies"))
