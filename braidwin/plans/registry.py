"""The selectable algorithms: each is one of the window joins with its own windows, batches, prefill and padding."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwin.functions import crypto
from braidwin.operators import fk, joins, padding
from braidwin.plans.config import JoinConfig


@dataclass(frozen=True)
class Algorithm:
    """mode: eager, delta, rect or snapshot. lockstep: batches of one row. extra_window: what the window has beyond the given one,
    in batches; extra_prefill: rows that the prefill takes beyond the window. pad: how the result is padded, if it is."""

    mode: str
    fk: bool = False
    lockstep: bool = False
    extra_window: int = 0
    extra_prefill: int = 0
    pad: str = ""
    encrypted: bool = False


ALGORITHMS = {
    "SHJ": Algorithm("eager"),
    "SHJ-L0": Algorithm("eager", encrypted=True),
    "SHJ-L1": Algorithm("eager"),
    "SHJ-L2": Algorithm("eager"),
    "SHJ-L3": Algorithm("delta", extra_window=1),
    "SHJ-L4": Algorithm("delta", extra_window=1, pad="product"),
    "FK-EPHI-L2": Algorithm("snapshot", fk=True, extra_window=-1),
    "FK-MERG-L2": Algorithm("eager", fk=True),
    "FK-MERG-L3": Algorithm("delta", fk=True),
    "FK-MERG-L4": Algorithm("delta", fk=True, pad="merge"),
    "FK-SORT-L2": Algorithm("delta", fk=True, lockstep=True),
    "FK-SORT-L3": Algorithm("delta", fk=True),
    "FK-SORT-L4": Algorithm("delta", fk=True, pad="merge"),
    "NLJ-L4": Algorithm("eager", extra_prefill=1, pad="probe"),
    "NFK-JOIN-L2": Algorithm("rect", lockstep=True),
    "NFK-JOIN-L3": Algorithm("rect"),
}
#: Those that run without an enclave; any other name then means the first.
OUTSIDE = ("SHJ", "SHJ-L0")


def resolve(config: JoinConfig) -> tuple[str, Algorithm, JoinConfig]:
    """The algorithm and the settings that it works with; errors for what it refuses."""
    name = config.alg
    if config.no_sgx and name not in OUTSIDE:
        name = "SHJ"
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}: one of {', '.join(ALGORITHMS)}")
    if name == "SHJ-L0" and not config.no_sgx:
        raise ValueError("SHJ-L0 runs outside of the enclave only: set no_sgx")
    alg = ALGORITHMS[name]
    if alg.fk and not config.fk_join:
        raise ValueError(f"{name} joins a primary key with foreign keys only: set fk_join")
    if alg.mode != "eager":
        batch = (1, 1) if alg.lockstep else config.batch
        if min(batch) < 1:
            raise ValueError("batches must be positive")
        config = replace(config, r_batch=batch[0], s_batch=batch[1], r_window=config.r_window + alg.extra_window * batch[0], s_window=config.s_window + alg.extra_window * batch[1])
        if min(config.window) < 1:
            raise ValueError(f"{name} needs windows larger than its batches")
    return name, alg, config


def encrypted(df: DataFrame) -> DataFrame:
    """A stream with key and payload (unsigned 32-bit integers) as deterministic ciphertexts.

    Dealt by position after that: a join reads its streams several times, the shuffle's output is reused, so nothing is
    encrypted twice.
    """
    return df.withColumns({"key": crypto.encrypt_int(F.col("key")), "payload": crypto.encrypt_int(F.col("payload"))}).repartition("pos")


def run(r: DataFrame, s: DataFrame | None, config: JoinConfig) -> DataFrame:
    """The algorithm's matches. ``self_join``: R takes the place of S (with a copy of its own, so nothing is stamped twice)."""
    _, alg, config = resolve(config)
    if config.self_join:
        s = r
    if s is None:
        raise ValueError("S is needed unless self_join is set")
    if alg.fk:
        # Two rows of a key matter if some window and batch can have both.
        r = fk.require_unique(r, config.r_window + max(config.r_batch, 1), config.duplicates)
    rows = None
    if alg.encrypted:
        rows = (r.count(), s.count())
        r, s = encrypted(r), encrypted(s)
    if alg.mode == "eager":
        return joins.eager(r, s, config.window, (config.r_window + alg.extra_prefill, config.s_window + alg.extra_prefill), rows)
    return {"delta": joins.delta, "rect": joins.rect, "snapshot": joins.snapshot}[alg.mode](r, s, config.window, config.batch)


def sizes(r: DataFrame, s: DataFrame, result: DataFrame, config: JoinConfig) -> DataFrame | None:
    """For a padding algorithm that works by batch, (k, matches, emitted, dummies); else None."""
    _, alg, config = resolve(config)
    if alg.pad not in ("merge", "product"):
        return None
    a, b = joins.sides(r, s, config.window, config.batch)
    size = {"merge": padding.merge_size, "product": padding.product_size}[alg.pad](a, b, F.col("k"))
    return padding.batch_sizes(result, max(a.batches, b.batches, 0), size)


def padded(r: DataFrame, s: DataFrame, config: JoinConfig) -> DataFrame:
    """The matches with is_dummy, padded as the algorithm pads; without padding none is a dummy."""
    _, alg, settings = resolve(config)
    result = run(r, s, config)
    if alg.pad in ("merge", "product"):
        a, b = joins.sides(r, s, settings.window, settings.batch)
        size = {"merge": padding.merge_size, "product": padding.product_size}[alg.pad](a, b, F.col("k"))
        return padding.pad(result, max(a.batches, b.batches, 0), size)
    result = result.withColumn("is_dummy", F.lit(False))
    if alg.pad == "probe":
        # A new row scans the other stream's whole window: what does not match is a dummy.
        prefill = (settings.r_window + 1, settings.s_window + 1)
        scanned = r.where(F.col("pos") >= prefill[0]).count() * settings.s_window + s.where(F.col("pos") >= prefill[1]).count() * settings.r_window
        missing = max(0, scanned - result.count())
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema.fields if f.name != "is_dummy"]
        return result.unionByName(r.sparkSession.range(missing).select(*blank, F.lit(True).alias("is_dummy")))
    return result
