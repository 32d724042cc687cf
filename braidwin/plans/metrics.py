"""Figures of a run."""

from __future__ import annotations

import time
from collections.abc import Sequence
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwin.plans import registry
from braidwin.plans.config import JoinConfig

SCHEMA = "algorithm string, matches long, emitted long, input_tuples long, time_us long, throughput_mrec_s double"


def matches_by_tuple(result: DataFrame, by: str = "r_pos") -> DataFrame:
    """(<by>, matches) of a join's result: counted in every task before the shuffle."""
    return result.groupBy(by).agg(F.count("*").alias("matches"))


def measured(r: DataFrame, s: DataFrame | None, config: JoinConfig) -> DataFrame:
    """One row (SCHEMA): matches without, emitted with dummies; input tuples without those that fill the windows; the time of the
    join and its count."""
    name, _, settings = registry.resolve(config)
    other = r if settings.self_join else s
    n_r, n_s = r.count(), other.count()
    tuples = n_r - settings.r_window + n_s - settings.s_window
    began = time.perf_counter()
    result = registry.run(r, s, config)
    matches = result.count()
    us = max(1, round((time.perf_counter() - began) * 1e6))
    by_batch = registry.sizes(r, other, result, config)
    emitted = by_batch.agg(F.sum("emitted")).first()[0] if by_batch is not None else matches
    if registry.ALGORITHMS[name].pad == "probe":
        emitted = max(matches, max(0, n_r - settings.r_window - 1) * settings.s_window + max(0, n_s - settings.s_window - 1) * settings.r_window)
    return r.sparkSession.createDataFrame([(name, matches, emitted or 0, max(0, tuples), us, max(0, tuples) / us)], SCHEMA)


def stream_figures(query, firsts: Sequence[int] = (100, 1000)) -> dict:
    """Of a streaming query: its batches and rows, rows a second, the mean milliseconds of its first batches, and of the whole time
    the share of each phase (what Spark reports of a trigger: offsets, planning, execution, commit).

    A query knows as many batches as ``spark.sql.streaming.numRecentProgressUpdates``: 100 unless that is raised.
    """
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    ms = [p["durationMs"].get("triggerExecution", 0) for p in batches]
    rows = sum(p["numInputRows"] for p in batches)
    phases: dict[str, float] = {}
    for p in batches:
        for name, spent in p["durationMs"].items():
            if name != "triggerExecution":
                phases[name] = phases.get(name, 0) + spent / max(1, sum(ms))
    latency = {f"mean_latency_ms_first_{n}": sum(ms[:n]) / max(1, len(ms[:n])) for n in firsts}
    return {"batches": len(batches), "rows": rows, "rows_per_second": 1000 * rows / max(1, sum(ms)), **latency, "phase_shares": phases}


def repeated(run, times: int) -> tuple[float, Sequence[float]]:
    """The median seconds of ``run()``, and all."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return median(took), took
