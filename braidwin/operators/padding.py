"""Results padded to sizes that don't depend on the data, by dummy rows, and the removal of these.

Dummies have null columns and is_dummy true. Only sizes are hidden this way; Spark's memory accesses are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwin.operators.joins import Side


def merge_size(a: Side, b: Side, k: Column) -> Column:
    """Rows that the three merges of batch k scan: one result for each."""
    new_r, new_s = F.least(a.filled(k) + a.batch, F.lit(a.rows)) - a.filled(k), F.least(b.filled(k) + b.batch, F.lit(b.rows)) - b.filled(k)
    return (a.window + new_s) + (b.window + new_r) + (new_r + new_s)


def product_size(a: Side, b: Side, k: Column) -> Column:
    """Every row of a batch with every one of the other."""
    return F.lit(a.batch * b.batch) + 0 * k


def batch_sizes(result: DataFrame, batches: int, size: Column) -> DataFrame:
    """(k, matches, emitted, dummies): for every batch its rows, the padded size, and the difference (not below 0)."""
    spark = result.sparkSession
    every = spark.range(batches).withColumnRenamed("id", "k")
    counted = every.join(result.groupBy("k").agg(F.count("*").alias("matches")), "k", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return counted.withColumn("emitted", F.greatest(size, F.col("matches")).cast("long")).withColumn("dummies", F.col("emitted") - F.col("matches"))


def pad(result: DataFrame, batches: int, size: Column) -> DataFrame:
    """``result`` with is_dummy, and dummies up to ``size`` (an expression of k) for every batch."""
    missing = batch_sizes(result, batches, size).where("dummies > 0")
    # A row a batch is little, its dummies are not: dealt to all partitions before they are made, which adaptive plans leave so
    # (by a hash of k: by k itself the rows are dealt already, in partitions that are then put together).
    missing = missing.repartition(int(result.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("k"))
    dummies = missing.select("k", F.explode(F.sequence(F.lit(1).cast("long"), "dummies")).alias("_n"))
    blank = [F.col("k") if c == "k" else F.lit(None).cast(result.schema[c].dataType).alias(c) for c in result.columns]
    return result.withColumn("is_dummy", F.lit(False)).unionByName(dummies.select(*blank, F.lit(True).alias("is_dummy")))


def pad_probes(result: DataFrame, probes: DataFrame, window: int) -> DataFrame:
    """(probe, matches, emitted): a full scan of a window gives ``window`` rows for every probing row, whatever it finds.

    ``result`` and ``probes`` have a column probe.
    """
    found = result.groupBy("probe").agg(F.count("*").alias("matches"))
    return probes.select("probe").join(found, "probe", "left").select("probe", F.coalesce("matches", F.lit(0)).alias("matches"), F.lit(window).cast("long").alias("emitted"))


def trim(padded: DataFrame) -> DataFrame:
    """The rows that are no dummies."""
    return padded.where(~F.col("is_dummy")).drop("is_dummy")


def pad_to_power_of_two(df: DataFrame) -> DataFrame:
    """``df`` with is_dummy, and dummies until the number of rows is a power of two."""
    n = df.count()
    missing = (1 << max(0, n - 1).bit_length()) - n
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.withColumn("is_dummy", F.lit(False)).unionByName(df.sparkSession.range(missing).select(*blank, F.lit(True).alias("is_dummy")))


def count_dummies(padded: DataFrame) -> DataFrame:
    # By a filter, so that the rows that are none by their plan aren't made again for this.
    return padded.where("is_dummy").agg(F.count("*").alias("dummies"))
