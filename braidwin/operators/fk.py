"""Primary-key joins: the check of the key's uniqueness, and the scan that carries the last R row of a key forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _with_next(r: DataFrame, within: int) -> DataFrame:
    """``r`` with _next, the position at which the key comes again, if that is less than ``within`` positions later (else null, or farther).

    Positions are cut into stretches many times as long as ``within``; the first rows of a stretch are also looked at in the
    one before. So a frequent key is as many groups as there are stretches, and nothing is joined.
    """
    width = max(16 * within, 1 << 16)
    own = F.floor(F.col("pos") / width)
    before = F.when((F.col("pos") % width < within) & (own > 0), F.struct((own - 1).alias("at"), F.lit(True).alias("ghost")))
    dealt = r.withColumn("_to", F.explode(F.array_compact(F.array(F.struct(own.alias("at"), F.lit(False).alias("ghost")), before)))).withColumns({"_at": F.col("_to.at"), "_ghost": F.col("_to.ghost")})
    following = F.lead("pos").over(Window.partitionBy("key", "_at").orderBy("pos"))
    return dealt.withColumn("_next", following).where(~F.col("_ghost")).drop("_to", "_at", "_ghost")


def duplicate_keys(r: DataFrame, within: int | None = None) -> DataFrame:
    """(key, pos) of rows whose key came before, less than ``within`` positions earlier (None: ever)."""
    rows = r.where(F.col("key").isNotNull()).select("key", "pos")
    if within is None:
        first = rows.groupBy(F.col("key").alias("_key")).agg(F.min("pos").alias("_first"))
        return rows.join(first, (F.col("key") == F.col("_key")) & (F.col("pos") > F.col("_first"))).select("key", "pos")
    return _with_next(rows, within).where(F.col("_next") - F.col("pos") < within).select("key", F.col("_next").alias("pos"))


def require_unique(r: DataFrame, within: int | None = None, duplicates: str = "raise") -> DataFrame:
    """``r`` if its keys are unique; else an error, or with ``duplicates="latest"`` without the rows whose key comes again less
    than ``within`` positions later (None: ever)."""
    if duplicates == "latest":
        if within is None:
            last = r.groupBy(F.col("key").alias("_key")).agg(F.max("pos").alias("_last"))
            return r.join(last, F.col("key").eqNullSafe(F.col("_key")) & (F.col("pos") == F.col("_last")), "left_semi")
        return _with_next(r, within).where(F.coalesce(F.col("_next") - F.col("pos") >= within, F.lit(True))).drop("_next")
    if duplicates != "raise":
        raise ValueError(f"duplicates: 'raise' or 'latest', not {duplicates!r}")
    found = duplicate_keys(r, within).first()
    if found:
        raise ValueError(f"key {found.key} comes more than once in a window of R (again at position {found.pos})")
    return r


def tagged(r: DataFrame, s: DataFrame) -> DataFrame:
    """Both streams as one, with side R or S."""
    return r.withColumn("side", F.lit("R")).unionByName(s.withColumn("side", F.lit("S")))


def last_seen(r: DataFrame, s: DataFrame) -> DataFrame:
    """Each S row with the R row of its key (of several the last in arrival): what a scan in the order (key, side, pos) carries forward.

    In that order all R rows of a key come before its S rows, so the last one is a maximum, which is combined before the
    shuffle; the S rows of a frequent key can be split among tasks.
    """
    last = r.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("pos", "ts", "payload")).alias("last_r"))
    rows = s.join(last, F.col("key") == F.col("_key"))
    return rows.select(
        F.col("last_r.ts").alias("r_ts"), F.col("key").alias("r_key"), F.col("last_r.payload").alias("r_payload"), F.col("ts").alias("s_ts"), F.col("key").alias("s_key"), F.col("payload").alias("s_payload"),
        F.col("last_r.pos").alias("r_pos"), F.col("pos").alias("s_pos"))
