"""Connected components of an edge list by alternating large-star and small-star steps, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwin.llm.common import written

_SALTS = 8


def _with_min(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) and, as m, the least v of each u.

    The minimum is combined before the shuffle; the join is salted, as one hub may stand in a large part of all pairs.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS)).cast("int")).join(least, ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    found = _with_min(both).where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
    return found.where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = _with_min(down).select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return found.where("a != b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge that is not its component's least node; roots themselves have no row.

    ``edges`` has columns a and b of one orderable type; loops, repeated edges and nulls are ignored. An empty edge list
    has no rows. Every round's edges are written to the shared folder, so no state is kept on an executor; nothing but two
    sums a round reaches the driver.
    """
    now = written(edges.select("a", "b").where("a != b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        digest = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if digest[0] == 0 or tuple(digest) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(digest)
        now = written(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"no convergence after {rounds} rounds")
