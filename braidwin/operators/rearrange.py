"""Expansion by weight, offsets, block sizes, compaction, permutation and pairing by place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwin.operators.position import hash_range, ranges_of, running, with_pos

#: Positions in a range of these.
STRETCH = 1 << 16


def expand(df: DataFrame, weight: str) -> DataFrame:
    """Every row ``weight`` times, with copy from 0; none for a weight that is null or below 1."""
    return df.where(F.col(weight) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(weight).cast("long") - 1)))


def offsets(df: DataFrame, weight: str, order: Sequence[str]) -> DataFrame:
    """``df`` with slot, the sum of the weights before the row in ``order``: where its copies begin after ``expand``."""
    upto = running(df, list(order), {"slot": F.coalesce(F.col(weight), F.lit(0))}, ranges_of(df, order[0])[0])
    return upto.withColumn("slot", F.col("slot") - F.coalesce(F.col(weight), F.lit(0)))


def distributed(df: DataFrame, weight: str, order: Sequence[str]) -> DataFrame:
    """Every row at each of its slots."""
    return expand(offsets(df, weight, order), weight).withColumn("slot", F.col("slot") + F.col("copy")).drop("copy")


def block_sizes(r: DataFrame, s: DataFrame) -> DataFrame:
    """(key, height, width, pairs) of the keys that both streams have: the join's size without the join."""
    left = r.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("height"))
    right = s.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("width"))
    return left.join(right, "key").withColumn("pairs", F.col("height") * F.col("width"))


def output_size(r: DataFrame, s: DataFrame) -> DataFrame:
    """One row: pairs, the number of rows of the join."""
    return block_sizes(r, s).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def compact(df: DataFrame, mark: Column) -> DataFrame:
    """The marked rows."""
    return df.where(mark)


def compact_stable(df: DataFrame, mark: Column, order: Sequence[str]) -> DataFrame:
    """All rows with place: the marked ones first, either kind in ``order``."""
    marked = df.withColumn("_m", F.coalesce(mark, F.lit(False)).cast("int"))
    # Positions have no gaps: ranges of equal width are of equal size, and need no look at the rows, which would make them anew.
    bucket = F.coalesce(F.floor(F.col("pos") / STRETCH), F.lit(-1)) if order[0] == "pos" else ranges_of(df, order[0])[0]
    counted = running(marked, list(order), {"_front": F.col("_m"), "_back": 1 - F.col("_m")}, bucket)
    n = marked.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_total"))
    return counted.join(F.broadcast(n)).withColumn("place", F.when(F.col("_m") == 1, F.col("_front") - 1).otherwise(F.col("_total") + F.col("_back") - 1)).drop("_m", "_front", "_back", "_total")


def shuffled(df: DataFrame, seed: int, unique: Sequence[str], name: str = "place") -> DataFrame:
    """``df`` with a place that is a random permutation of 0..n-1, the same for the same seed and rows."""
    lot = df.withColumn("_lot", F.xxhash64(F.lit(seed), *unique))
    return with_pos(lot, ["_lot", *unique], hash_range(lot, "_lot"), name).drop("_lot")


def reseated(df: DataFrame, columns: Sequence[str], seed: int, pos: str = "pos") -> DataFrame:
    """``df`` with the values of ``columns`` permuted over its rows, the others left in place."""
    moved = shuffled(df.select(pos, *columns), seed, [pos], "_to").drop(pos).withColumnRenamed("_to", pos)
    return df.drop(*columns).join(moved, pos).select(df.columns)


def zipped(left: DataFrame, right: DataFrame, order: tuple[Sequence[str], Sequence[str]]) -> DataFrame:
    """Row i of one beside row i of the other, each in its own order, as far as both go; ``place`` is i."""
    a = with_pos(left, order[0], name="place")
    b = with_pos(right, order[1], name="place")
    return a.join(b, "place")


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` sorted as a whole (a range shuffle and a sort in each range)."""
    return df.orderBy(*order)


def is_sorted(df: DataFrame, column: str) -> DataFrame:
    """One row: sorted, whether no row in the order of pos has a lesser ``column`` than the row before it."""
    before = df.select((F.col("pos") + 1).alias("pos"), F.col(column).alias("_before"))
    return df.join(before, "pos").agg((F.count_if(F.col(column) < F.col("_before")) == 0).alias("sorted"))


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is not below ``n`` (1 for n < 2), exact for 0 <= n <= 2**62."""
    m = F.greatest(n.cast("long"), F.lit(1).cast("long")) - 1
    return F.when(m == 0, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(m)).cast("int")))


def previous_power_of_two(n: Column) -> Column:
    """The greatest power of two below ``n`` (0 for n < 2)."""
    m = F.greatest(n.cast("long"), F.lit(1).cast("long")) - 1
    return F.when(m == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (F.length(F.bin(m)) - 1).cast("int")))
