"""Joins by micro-batch in ``foreachBatch``: every trigger brings the next rows of both streams.

Rows have side (R or S), ts, key, payload and seq, which orders a side's rows within a trigger. What a batch needs of the past
is the last ``window`` rows of each side. Batch k writes them to ``<state>/k`` and reads those of the batch before, which it
leaves as they are; its result goes to ``<out>/batch=k``, written over if the batch is run again. A restart therefore neither
loses nor repeats a row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwin.operators import joins

MODES = ("delta", "snapshot", "rect", "static")
STREAM = "side string, ts long, key long, payload long, seq long"
#: A stream of files has about so many triggers, and more where one would have more rows of a side than these.
TRIGGERS, TRIGGER_ROWS = 8, 500_000
_STATE = "side string, ts long, key long, payload long, pos long"


class BatchJoin:
    """``stream.writeStream.foreachBatch(BatchJoin(...)).start()``

    mode static: no rows fill the windows first, every batch's rows join the other side's window and new rows. The others: the
    first ``window`` rows of a side are taken in silence, whichever triggers they come in; a batch is the rest of a trigger.

    ``batch`` (delta only): a trigger has any number of batches of so many rows a side, all whole but those that end a stream, and
    the result's k counts these from 0. Their number, not that of the triggers, then grows with the input.
    """

    def __init__(self, out: str, state: str, window: tuple[int, int], mode: str = "delta", batch: tuple[int, int] | None = None) -> None:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
        if min(window) < 1:
            raise ValueError("windows must be positive")
        if batch and (mode != "delta" or min(batch) < 1):
            raise ValueError("batches within a trigger are for mode delta, and must be positive")
        self.batch = batch
        self.out, self.state, self.window, self.mode = out, state, dict(zip("RS", window, strict=True)), mode

    def __call__(self, batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(_STATE).parquet(f"{self.state}/{k - 1}") if k else spark.createDataFrame([], _STATE)
        seen = {r.side: r.n for r in old.groupBy("side").agg((F.max("pos") + 1).alias("n")).collect()}
        # A trigger is a batch: as many rows as one task can sort.
        place = F.row_number().over(Window.partitionBy("side").orderBy("seq")) - 1
        start = F.when(F.col("side") == "R", F.lit(seen.get("R", 0))).otherwise(F.lit(seen.get("S", 0)))
        new = batch.select("side", "ts", "key", "payload", (place + start).cast("long").alias("pos"))
        fill = F.lit(0) if self.mode == "static" else F.when(F.col("side") == "R", self.window["R"]).otherwise(self.window["S"])
        rows = old.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.col("pos") >= fill))
        # Rows that fill the window are old when they come; what they push out of it was there before.
        low = {side: seen.get(side, 0) - self.window[side] for side in "RS"}
        r, s = (rows.where((F.col("side") == side) & (F.col("fresh") | (F.col("pos") >= low[side]))).drop("side") for side in "RS")
        n = {x.side: x.n for x in rows.groupBy("side").agg((F.max("pos") + 1).alias("n")).collect()}
        result = self.by_count(r, s, n) if self.batch else self.joined(r, s).withColumn("k", F.lit(k).cast("long"))
        if self.mode == "snapshot" and not rows.where("fresh").limit(1).count():
            result = result.limit(0)  # only the windows were filled
        result.write.mode("overwrite").parquet(f"{self.out}/batch={k}")
        keep = F.when(F.col("side") == "R", F.col("pos") >= n.get("R", 0) - self.window["R"]).otherwise(F.col("pos") >= n.get("S", 0) - self.window["S"])
        rows.where(keep).drop("fresh").write.mode("overwrite").parquet(f"{self.state}/{k}")

    def by_count(self, r: DataFrame, s: DataFrame, n: dict[str, int]) -> DataFrame:
        """The trigger's batches by position. Only a stream that has ended has fewer rows by now than these, so its length is known."""
        a, b = (joins.Side(self.window[side], size, n.get(side, 0)) for side, size in zip("RS", self.batch, strict=True))
        return joins.delta_of(r.where("fresh"), s.where("fresh"), r.drop("fresh"), s.drop("fresh"), a, b)

    def joined(self, r: DataFrame, s: DataFrame) -> DataFrame:
        if self.mode == "rect":
            r, s = self._contributing(r, s), self._contributing(s, r)
        pairs = joins.joined_by_batch(r.withColumn("k", F.lit(0)), s.withColumn("k", F.lit(0)))
        if self.mode in ("delta", "static"):
            pairs = pairs.where("r_fresh or s_fresh")
        return pairs.select(joins.PAIR_COLUMNS)

    @staticmethod
    def _contributing(rows: DataFrame, other: DataFrame) -> DataFrame:
        touched = other.where("fresh").select("key").distinct().withColumn("touched", F.lit(True))
        return rows.join(touched, "key", "left").where("fresh or touched").drop("touched")


def scratch(spark) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or of its own where that is unset, which only one machine (tests) may do."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="braidwin-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def as_files(r: DataFrame, s: DataFrame, cuts: list[tuple[int, int]], folder: str, reader: SparkSession | None = None) -> DataFrame:
    """Two streams as a streaming one of a file a trigger: the rows up to the first positions of ``cuts`` (R, S), then to the next, and all the rest.

    ``reader``: the session whose settings the streaming query has. The streams are computed once and dealt by trigger; a trigger's file, which is written in one task, is then made of its own rows alone.
    """
    spark = r.sparkSession
    trigger = lambda n: F.array_size(F.filter(F.array(*[F.lit(cut[n]).cast("long") for cut in cuts]), lambda c: c <= F.col("pos")))
    sided = [df.withColumns({"side": F.lit(side), "_trigger": trigger(n) if cuts else F.lit(0)}) for n, (df, side) in enumerate(((r, "R"), (s, "S")))]
    rows = sided[0].unionByName(sided[1])
    rows = rows.select("side", "ts", F.col("key").cast("long").alias("key"), F.col("payload").cast("long").alias("payload"), F.col("pos").cast("long").alias("seq"), "_trigger")
    rows.repartition("_trigger").write.partitionBy("_trigger").parquet(f"{folder}-dealt")
    dealt = spark.read.schema(f"{STREAM}, _trigger int").parquet(f"{folder}-dealt")
    for n in range(len(cuts) + 1):
        dealt.where(F.col("_trigger") == n).drop("_trigger").coalesce(1).write.mode("append").parquet(folder)
    return (reader or spark).readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(folder)


def batches_a_trigger(batches: int, size: int) -> int:
    """How many of ``batches`` of ``size`` rows come in one trigger: an eighth of them, but no more than half a million rows."""
    return max(1, min(-(-batches // TRIGGERS), TRIGGER_ROWS // size))


def read_result(spark, out: str) -> DataFrame:
    """All batches' results."""
    return spark.read.parquet(out).drop("batch")
