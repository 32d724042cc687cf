"""Streams out of tables and text files, and into text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwin.functions.scalar import time_ns
from braidwin.operators.position import hash_range, with_pos
from braidwin.sources.generators import arrival_times


def stream(df: DataFrame, key: str | Column, order: Sequence[str], ts: str | Column | None = None, payload: str | Column | None = None) -> DataFrame:
    """(ts, key, payload, pos) of a table, in ``order`` (total). ts: nanoseconds, or a time column's name; None: the position.

    payload: any column; None: the key.
    """
    key = F.col(key) if isinstance(key, str) else key
    payload = key if payload is None else F.col(payload) if isinstance(payload, str) else payload
    at = time_ns(F.col(ts)) if isinstance(ts, str) else ts
    rows = with_pos(df, order)
    return rows.select((F.col("pos") if at is None else at).alias("ts"), key.alias("key"), payload.alias("payload"), "pos")


def read_keys(spark: SparkSession, path: str, rate: int, seed: int = 1) -> DataFrame:
    """A stream from a text file of one positive integer a line: payload is the key, keys in random order, times by ``rate``.

    Lines that are no positive integer are left out.
    """
    keys = spark.read.text(path).select(F.expr("try_cast(trim(value) as bigint)").alias("key"), F.monotonically_increasing_id().alias("_line")).where("key > 0")
    lots = keys.withColumn("_lot", F.xxhash64(F.lit(seed), "_line"))
    lots = with_pos(lots, ["_lot", "_line"], hash_range(lots, "_lot"))
    return arrival_times(lots.select("key", F.col("key").alias("payload"), "pos"), rate, seed)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A stream from the text that ``write_dump`` writes."""
    rows = spark.read.text(path).where("not startswith(value, '#')").select(F.split("value", " ").alias("v"))
    part = F.split(F.col("v")[0], r"\.")
    rows = rows.select((part[0].cast("long") * 1_000_000_000 + part[1].cast("long")).alias("ts"), F.col("v")[1].cast("long").alias("key"), F.col("v")[2].cast("long").alias("payload"))
    return with_pos(rows, ["ts", "key", "payload"])


def write_dump(df: DataFrame, path: str) -> None:
    """One line a row, ``seconds.nanoseconds key payload`` (nine digits of nanoseconds), in files whose names are in the order of time.

    The first file begins with the header ``#TS, KEY, VAL``.
    """
    ns = F.pmod("ts", F.lit(1_000_000_000).cast("long"))
    line = F.concat_ws(" ", F.concat(F.floor(F.col("ts") / 1_000_000_000).cast("string"), F.lit("."), F.lpad(ns.cast("string"), 9, "0")), F.col("key").cast("string"), F.col("payload").cast("string"))
    head = df.sparkSession.range(1).select(F.lit("#TS, KEY, VAL").alias("value"), F.lit(-1).cast("long").alias("pos"))
    df.select(line.alias("value"), "pos").unionByName(head).orderBy("pos").select("value").write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Appends the rows of a run's figures to a CSV folder."""
    metrics.write.mode("append").option("header", True).csv(path)
