"""Shared helpers: shared-folder tables, row keys, and byte-level views of batches of texts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker looks at together (one longer text is looked at alone).
CHUNK_BYTES = 2 << 20
#: Rows and bytes of a batch between Spark and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset, which only one machine (tests) may do."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="braidwin-")
        spark.sparkContext.setCheckpointDir(at)
        return shared_dir(spark)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` as a Parquet table in the shared folder, removed by ``remove`` or when the JVM ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"braidwin-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = hpath
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes what ``written`` gave, once all that is made of it is written itself (so nothing lost has to be made of it again)."""
    for df in tables:
        df._written.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df._written, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle of both sides and a merge at every size: what is measured on little is what much costs."""
    return df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(col: str = "text") -> Column:
    """With doc_id, the key of a row: rows of equal doc_id and text are judged alike and each keeps its own result row."""
    return F.xxhash64(text_of(col))


def held_out(col: str = "doc_id") -> Column:
    """True for the third of the rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def with_columns(df: DataFrame, **types: str) -> T.StructType:
    """The schema of ``df`` and further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in types.items())])


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size: rows may be long texts, of which both sides hold a batch in memory.

    This lowers the session's limits of a batch, where they are higher; results do not depend on them.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives memory that is free back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or of one row."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def text_chunks(batches: Iterator[pa.RecordBatch], col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with their texts as UTF-8 bytes (null: empty)."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(col).cast(pa.binary()).to_pylist()]
        for lo, hi in chunks(np.fromiter(map(len, texts), np.int64, len(texts)), limit):
            yield batch.slice(lo, hi - lo), texts[lo:hi]


_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i <= n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _B), ("down", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans ``buf[start:end]``: equal bytes, equal hash, wherever they stand."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(mask.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


#: Lower-cases A-Z and makes every other ASCII byte but 0-9 and a-z a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array, its words' starts and ends, and where each text's words begin (one more entry than texts).

    Words are runs of ASCII letters and digits and of bytes over 127; A-Z count as a-z.
    """
    buf = np.frombuffer(b" ".join(texts).translate(WORD_TABLE), np.uint8)
    starts, ends = spans(buf != 32)
    first = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    return buf, starts, ends, np.searchsorted(starts, first)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin."""
    buf, starts, ends, cuts = word_spans(texts)
    return span_hashes(buf, starts, ends), cuts


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of equal ``key`` (no nulls) of a partition that is sorted by it, each whole; one group at a time is kept."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if rest and keys[lo] != last:
                yield pa.Table.from_batches(rest)
                rest = []
            last = keys[lo]
            rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield pa.Table.from_batches(rest)
