from __future__ import annotations

SCHEMA = "ts long, key long, payload long, pos long"


def frame(spark, rows):
    """A stream from (ts, key) rows."""
    return spark.createDataFrame([(t, k, 100 + i, i) for i, (t, k) in enumerate(rows)], SCHEMA)


def random_stream(rng, n, keys, ties=True, nulls=True):
    ts, out = 0, []
    for _ in range(n):
        ts += int(rng.integers(0 if ties else 1, 4))
        key = int(rng.integers(0, keys))
        out.append((ts, None if nulls and rng.random() < 0.05 else key))
    return out
