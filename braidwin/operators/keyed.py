"""Ordered-map operations on a stream: point lookup, rank, successor, counts of a key, the oldest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwin.operators.position import range_of, ranges_of, running


def lookup(df: DataFrame, key, ts) -> DataFrame:
    """The rows of one key and time."""
    return df.where((F.col("key") == key) & (F.col("ts") == ts))


def key_counts(df: DataFrame) -> DataFrame:
    """(key, n) of every key; null keys aren't counted."""
    return df.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"))


def ranked(df: DataFrame) -> DataFrame:
    """``df`` with rank, the number of rows before this one in the order (key, ts, pos). Keys and times must not be null."""
    return running(df, ["key", "ts", "pos"], {"rank": F.lit(1)}, ranges_of(df, "key", then="ts")[0]).withColumn("rank", F.col("rank") - 1)


def rank_of_key(df: DataFrame) -> DataFrame:
    """(key, rank): the number of rows of lesser keys. Counted by key before the running sum."""
    counts = key_counts(df)
    return running(counts, ["key"], {"upto": F.col("n")}, ranges_of(counts, "key")[0]).select("key", (F.col("upto") - F.col("n")).alias("rank"))


def successor(df: DataFrame) -> DataFrame:
    """``df`` with next_ts, the time of the next row of the same key.

    A key's rows are looked at by ranges of time; the last of a range finds the first of the key's next range in a table of
    one row for each key and range.
    """
    rows = df.withColumn("_range", range_of(df, "ts", then="pos"))
    firsts = rows.groupBy(F.col("key").alias("_key"), F.col("_range").alias("_r")).agg(F.min("ts").alias("_first"))
    firsts = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy("_key").orderBy("_r"))).drop("_first")
    own = rows.withColumn("_own", F.lead("ts").over(Window.partitionBy("key", "_range").orderBy("ts", "pos")))
    out = own.join(firsts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return out.select(*df.columns, F.coalesce("_own", "_after").alias("next_ts"))


def evicted(df: DataFrame, n: int) -> DataFrame:
    """The oldest ``n`` rows, in the order (ts, key, pos)."""
    return df.orderBy("ts", "key", "pos").limit(n)


def extract_min(df: DataFrame) -> DataFrame:
    """The oldest row."""
    return evicted(df, 1)


def window_at(df: DataFrame, seen: int, window: int) -> DataFrame:
    """The rows in the window after ``seen`` rows: all but those that were retired."""
    return df.where((F.col("pos") >= seen - window) & (F.col("pos") < seen))


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """``df`` without the rows of the keys and times in ``gone``."""
    return df.join(gone.select("key", "ts").distinct(), ["key", "ts"], "left_anti")


def ring(df: DataFrame, window: int) -> DataFrame:
    """``df`` with in_ring, the number of rows of the same key among the last ``window`` rows up to this one.

    A row leaves the count of its key when the row ``window`` places later has come: both are counted in one running sum by key
    and stretch of positions. A stretch begins with what the one before has in the ring at its end, which come as rows too.
    """
    width = max(16 * window, 1 << 16)
    pos, own = F.col("pos"), F.floor(F.col("pos") / width)
    event = lambda stretch, at, n, real: F.struct(stretch.alias("stretch"), at.alias("at"), F.lit(n).alias("n"), F.lit(real).alias("real"))
    carried = F.when(pos % width >= width - window, event(own + 1, pos, 1, False))
    events = df.withColumn("_e", F.explode(F.array_compact(F.array(event(own, pos, 1, True), carried, event(F.floor((pos + window) / width), pos + window, -1, False)))))
    count = F.sum("_n").over(Window.partitionBy("key", "_stretch").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    counted = events.withColumns({"_stretch": F.col("_e.stretch"), "_at": F.col("_e.at"), "_n": F.col("_e.n")}).withColumn("in_ring", count)
    return counted.where("_e.real").select(*df.columns, "in_ring")
