"""The tuple-at-a-time join as a stateful streaming query.

The windows count rows over all keys, so their state is one group, in one task; a batch replay (``operators.joins.eager``) has
no such bound. Rows must come in the order of time over triggers; within a trigger they are sorted by (ts, S before R, seq).
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "r_ts long, r_key long, r_payload long, s_ts long, s_key long, s_payload long, r_pos long, s_pos long"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


class Windows:
    """Both windows: the last rows of each side, and these by key."""

    def __init__(self, window: tuple[int, int], prefill: tuple[int, int], rows: dict | None = None, seen: dict | None = None) -> None:
        self.window, self.prefill = dict(zip("RS", window, strict=True)), dict(zip("RS", prefill, strict=True))
        self.rows = {side: deque() for side in "RS"}
        self.by_key = {side: defaultdict(deque) for side in "RS"}
        self.seen = {"R": 0, "S": 0} | (seen or {})
        for side in "RS":
            for row in (rows or {}).get(side, []):
                self._add(side, tuple(row))

    def _add(self, side: str, row: tuple) -> None:
        self.rows[side].append(row)
        self.by_key[side][row[1]].append(row)
        if len(self.rows[side]) > self.window[side]:
            old = self.rows[side].popleft()
            own = self.by_key[side][old[1]]
            own.popleft()
            if not own:
                del self.by_key[side][old[1]]

    def add(self, side: str, ts: int, key: int | None, payload: int) -> Iterator[tuple]:
        """Takes a row in; yields its matches if its side's prefill is over."""
        row = (ts, key, payload, self.seen[side])
        self.seen[side] += 1
        self._add(side, row)
        if row[3] < self.prefill[side] or key is None:
            return
        other = "S" if side == "R" else "R"
        for match in self.by_key[other].get(key, ()):
            r, s = (row, match) if side == "R" else (match, row)
            yield (*r[:3], *s[:3], r[3], s[3])


def _values(column: pd.Series) -> list:
    """As plain numbers or strings, None for null."""
    if not column.isna().any():
        return (column if column.dtype == object else column.astype("int64")).tolist()
    return [None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in column.tolist()]


def eager_stream(stream: DataFrame, window: tuple[int, int], prefill: tuple[int, int] | None = None) -> DataFrame:
    """The matches of a stream (side, ts, key, payload, seq) whose first ``prefill`` rows of each side came before all others.

    That is what a replay does: it fills both windows before it merges. Rows of the prefill may come in any triggers, but no
    other row before them.
    """
    prefill = prefill or window
    schema = "state string"

    def step(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        windows = Windows(window, prefill, known.get("rows"), known.get("seen"))
        rows = pd.concat(list(frames))
        rows["turn"] = (rows["side"] == "R").astype(int)
        rows = rows.sort_values(["ts", "turn", "seq"], kind="stable")
        out = []
        for row in zip(*(_values(rows[c]) for c in ("side", "ts", "key", "payload")), strict=True):
            out.extend(windows.add(*row))
        state.update((json.dumps({"rows": {k: list(v) for k, v in windows.rows.items()}, "seen": windows.seen}),))
        yield pd.DataFrame(out, columns=_NAMES)

    return stream.withColumn("one", F.lit(0)).groupBy("one").applyInPandasWithState(step, OUT, schema, "append", GroupStateTimeout.NoTimeout)
