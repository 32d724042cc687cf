"""Times, bucket numbers and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ns(sec: Column, nsec: Column) -> Column:
    return sec.cast("long") * 1_000_000_000 + nsec.cast("long")


def time_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a date or timestamp."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def time_code(ns: Column) -> Column:
    """A time of less than 2,048 s in 32 bits: 11 for the seconds, 21 for the fraction; else null."""
    sec, rest = F.floor(ns / 1_000_000_000), F.pmod(ns, F.lit(1_000_000_000).cast("long"))
    code = sec * 2097152 + F.floor(rest * 2097152 / 999_999_999)
    return F.when((ns >= 0) & (sec < 2048), code)


def bucket(key: Column, buckets: int, skip: int = 0) -> Column:
    """The hash bucket of a key: its low bits (``buckets`` is a power of two) without the lowest ``skip``."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    return F.shiftright(key.cast("long").bitwiseAND(F.lit(buckets - 1).cast("long")), skip)


def megabytes(n: Column) -> Column:
    return n / (1024 * 1024)


def choose(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)
