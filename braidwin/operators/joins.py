"""Joins of two streams on equal keys over count-based sliding windows.

Streams have columns ts, key, payload (any type) and pos (0-based arrival position; ``operators.position.with_pos``). Every
join returns r_ts, r_key, r_payload, s_ts, s_key, s_payload, r_pos, s_pos, and those by batch also k, the batch's number.
A null key joins nothing. The first ``window`` rows of a stream fill its window without output.

What a row may join is a range of the other stream's positions, no longer than a window and a batch; positions are cut into
buckets of that length, so a range touches two of them at most and (key, bucket) is the key of a hash join: the work of a
frequent key grows with the window, not with the stream.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwin.operators.position import merged

COLUMNS = ("ts", "key", "payload", "pos")
#: The rows in all windows of a stream are sent to every task if they are no more than this.
MAX_SENT = 1 << 13


@dataclass(frozen=True)
class Side:
    """Window, batch and length of one stream."""

    window: int
    batch: int
    rows: int

    def batch_of(self, pos: Column) -> Column:
        return F.when(pos < self.window, -1).otherwise(F.floor((pos - self.window) / self.batch)).cast("long")

    def filled(self, k: Column) -> Column:
        """Rows that came before batch k."""
        return F.least(F.lit(self.window) + k * self.batch, F.lit(self.rows))

    def low(self, k: Column) -> Column:
        """First position of the window at the start of batch k."""
        return self.filled(k) - self.window

    @property
    def batches(self) -> int:
        return -(-(self.rows - self.window) // self.batch)


def sides(r: DataFrame, s: DataFrame, window: tuple[int, int], batch: tuple[int, int]) -> tuple[Side, Side]:
    if min(*window, *batch) < 1:
        raise ValueError("windows and batches must be positive")
    return Side(window[0], batch[0], r.count()), Side(window[1], batch[1], s.count())


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in COLUMNS], *[c for c in df.columns if c not in COLUMNS])


def band(probe: DataFrame, build: DataFrame, p: str, b: str, low: Column, high: Column, length: int, copied: str = "probe", sent: bool = False) -> DataFrame:
    """Rows of ``probe`` and ``build`` of equal key, for which low <= the build row's position < high (at most low + length).

    A range touches two buckets: either a probing row is copied to both, or (``copied="build"``) it goes to the first, and
    every build row also to the bucket before its own. The pairs are the same; the shorter side should be the one that is copied.
    sent: whether ``build`` is so short that it is sent to the tasks whole.
    """
    ranged = _named(probe.withColumns({"_low": F.greatest(low, F.lit(0)), "_high": high}).where((F.col("_high") > F.col("_low")) & F.col("key").isNotNull()), p)
    first, last = F.floor(F.col("_low") / length), F.floor((F.col("_high") - 1) / length)
    other, own = _named(build.where(F.col("key").isNotNull()), b), F.floor(F.col(f"{b}_pos") / length)
    ranged = ranged.withColumn("_bucket", F.explode(F.sequence(first, last)) if copied == "probe" else first)
    other = other.withColumn("_bucket_b", own if copied == "probe" else F.explode(F.array(own - 1, own)))
    on = (F.col(f"{p}_key") == F.col(f"{b}_key")) & (F.col("_bucket") == F.col("_bucket_b")) & (F.col(f"{b}_pos") >= F.col("_low")) & (F.col(f"{b}_pos") < F.col("_high"))
    return ranged.join(F.broadcast(other) if sent else other, on).drop("_bucket", "_bucket_b", "_low", "_high")


PAIR_COLUMNS = [f"{side}_{c}" for side in "rs" for c in COLUMNS[:3]] + ["r_pos", "s_pos"]


def eager(r: DataFrame, s: DataFrame, window: tuple[int, int], prefill: tuple[int, int] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """Tuple at a time, in the order of time (of equal times S first): each new row joins the other stream's last ``window`` rows.

    ``rows``: the streams' lengths, where counting these would be dear.
    """
    (wr, ws), (pr, ps) = window, prefill or window
    if min(wr, ws) < 1:
        raise ValueError("windows must be positive")
    n_r, n_s = rows or (r.count(), s.count())
    rr, ss, ends = merged(r, s)
    rr = rr.withColumn("ns", F.greatest("ns", F.lit(ps))).where(F.col("pos") >= pr)
    ss = ss.withColumn("nr", F.greatest("nr", F.lit(pr))).where(F.col("pos") >= ps)
    by_r, by_s = ("probe", "build") if n_r <= n_s else ("build", "probe")
    in_s, in_r = (_reached(s, ends[0], ps, ws), _reached(r, ends[1], pr, wr)) if ends else (None, None)
    of_r = (s, by_r) if in_s is None else (in_s, "build", True)
    of_s = (r, by_s) if in_r is None else (in_r, "build", True)
    new_r = band(rr, of_r[0], "r", "s", F.col("ns") - ws, F.col("ns"), ws, *of_r[1:]).select(PAIR_COLUMNS)
    new_s = band(ss, of_s[0], "s", "r", F.col("nr") - wr, F.col("nr"), wr, *of_s[1:]).select(PAIR_COLUMNS)
    return new_r.unionByName(new_s)


def _reached(df: DataFrame, ends: Iterable[int], least: int, window: int) -> DataFrame | None:
    """The rows of ``df`` in a window that ends at one of ``ends`` (or at ``least``, for those below it); None if these may be more than ``MAX_SENT``."""
    spans: list[list[int]] = []
    for end in sorted({max(end, least) for end in ends}):
        low = max(end - window, 0)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = end
        else:
            spans.append([low, end])
    if len(spans) > 64 or sum(high - low for low, high in spans) > MAX_SENT:
        return None
    within = F.lit(False)
    for low, high in spans:
        within = within | ((F.col("pos") >= low) & (F.col("pos") < high))
    return df.where(within)


def delta(r: DataFrame, s: DataFrame, window: tuple[int, int], batch: tuple[int, int]) -> DataFrame:
    """Batch by batch, in lock-step by count: the new rows of each stream join the other's window and new rows; every pair once."""
    a, b = sides(r, s, window, batch)
    k = F.greatest("_k", "_k_b").alias("k")
    if a.batches < b.batches:
        return _lifelong(s, r, "s", "r", b, a).select(k, *PAIR_COLUMNS)
    return _lifelong(r, s, "r", "s", a, b).select(k, *PAIR_COLUMNS)


def _lifelong(probe: DataFrame, build: DataFrame, p: str, b: str, a: Side, o: Side) -> DataFrame:
    """The pairs of ``delta`` in one join, with _k and _k_b, the batches of both rows.

    A probing row joins the other stream from the window before its batch, or from the first batch on if it fills the window
    itself, to the end of the last batch that has it in its window: one range of positions. The probing stream must not have
    fewer batches than the other. Then this range is bounded for the rows too that stay in its window to the end.
    """
    pos = F.col("pos")
    own = probe.withColumn("_k", a.batch_of(pos))
    low = F.when(F.col("_k") < 0, o.window).otherwise(o.low(F.greatest("_k", F.lit(0))))
    high = F.when(pos >= a.rows - a.window, o.rows).otherwise(F.least(o.window + (F.floor(pos / a.batch) + 1) * o.batch, F.lit(o.rows)))
    length = o.window + o.batch * (-(-a.window // a.batch) + 1)
    return band(own, build.withColumn("_k_b", o.batch_of(pos)), p, b, low, high, length, "probe" if a.rows <= o.rows else "build")


def delta_of(new_r: DataFrame, new_s: DataFrame, r: DataFrame, s: DataFrame, a: Side, b: Side) -> DataFrame:
    """The pairs of ``delta`` for the batches of ``new_r`` and ``new_s``, which are among ``r`` and ``s``; these need no rows but the new ones and the windows before."""
    k = F.col("k")
    rr = new_r.withColumn("k", a.batch_of(F.col("pos"))).where(k >= 0)
    ss = new_s.withColumn("k", b.batch_of(F.col("pos"))).where(k >= 0)
    # A row joins what has come by the end of its batch; pairs of one batch come from the first join alone.
    of_r, of_s = ("probe", "build") if a.rows <= b.rows else ("build", "probe")
    by_r = band(rr, s, "r", "s", b.low(k), F.least(b.filled(k) + b.batch, F.lit(b.rows)), b.window + b.batch, of_r)
    by_s = band(ss, r, "s", "r", a.low(k), a.filled(k), a.window, of_s)
    return by_r.select("k", *PAIR_COLUMNS).unionByName(by_s.select("k", *PAIR_COLUMNS))


def _lifetimes(df: DataFrame, side: Side, batches: int, length: int) -> DataFrame:
    """Each row with a and b, the first and last batch at whose end it is in the window or new, once for each stretch (of
    ``length`` batches) that they touch: two of them, but for the rows that stay in the window of a stream that has ended."""
    pos = F.col("pos")
    first = F.greatest(F.floor((pos - side.window) / side.batch), F.lit(0))
    last = F.when(pos >= side.rows - side.window, batches - 1).otherwise(F.least(F.floor(pos / side.batch), F.lit(batches - 1)))
    rows = df.where(F.col("key").isNotNull()).select(*COLUMNS).withColumns({"a": first.cast("long"), "b": last.cast("long")}).where("a <= b")
    return rows.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("a") / length), F.floor(F.col("b") / length))))


def _alive(r: DataFrame, s: DataFrame, window: tuple[int, int], batch: tuple[int, int]) -> tuple[DataFrame, DataFrame, tuple[Side, Side], int]:
    a, b = sides(r, s, window, batch)
    length = max(-(-a.window // a.batch), -(-b.window // b.batch)) + 1
    batches = max(a.batches, b.batches, 0)
    return _lifetimes(r, a, batches, length), _lifetimes(s, b, batches, length), (a, b), length


def joined_by_batch(rr: DataFrame, ss: DataFrame) -> DataFrame:
    left = _named(rr.select(*COLUMNS, "k", F.col("fresh").alias("r_fresh")), "r")
    right = _named(ss.select(*COLUMNS, F.col("k").alias("_k"), F.col("fresh").alias("s_fresh")), "s")
    return left.join(right, (F.col("k") == F.col("_k")) & (F.col("r_key") == F.col("s_key")))


def snapshot(r: DataFrame, s: DataFrame, window: tuple[int, int], batch: tuple[int, int]) -> DataFrame:
    """Batch by batch, both windows and new rows joined anew: a pair comes in every batch in which both are there.

    A pair is found once, in the stretch of its first common batch, and then repeated for each of its batches.
    """
    rr, ss, _, length = _alive(r, s, window, batch)
    left, right = (_named(df, side).withColumnsRenamed({c: f"_{side}_{c}" for c in ("a", "b", "stretch")}) for df, side in ((rr, "r"), (ss, "s")))
    first, last = F.greatest("_r_a", "_s_a"), F.least("_r_b", "_s_b")
    pairs = left.join(right, (F.col("r_key") == F.col("s_key")) & (F.col("_r_stretch") == F.col("_s_stretch")) & (first <= last) & (F.col("_r_stretch") == F.floor(first / length)))
    return pairs.select(F.explode(F.sequence(first, last)).alias("k"), *PAIR_COLUMNS)


def rect(r: DataFrame, s: DataFrame, window: tuple[int, int], batch: tuple[int, int]) -> DataFrame:
    """Batch by batch, the blocks of a key that new rows contribute to: new rows join all, and if a key has new rows on both
    sides, its old rows join each other again.

    The former are the pairs of ``delta``. For the latter only the old rows of keys with new rows on both sides are looked at,
    and only in those batches.
    """
    rr, ss, (a, b), length = _alive(r, s, window, batch)
    new = [df.select("key", side.batch_of(F.col("pos")).alias("k")).where("k >= 0").distinct() for df, side in ((r, a), (s, b))]
    both = new[0].join(new[1], ["key", "k"]).select(F.col("key").alias("_key"), "k", F.floor(F.col("k") / length).alias("_stretch"))

    def old(rows: DataFrame, side: Side) -> DataFrame:
        found = rows.join(both, (F.col("key") == F.col("_key")) & (F.col("stretch") == F.col("_stretch")) & F.col("k").between(F.col("a"), F.col("b")) & (F.col("pos") < side.filled(F.col("k"))))
        return found.select(*COLUMNS, "k", F.lit(False).alias("fresh"))

    again = joined_by_batch(old(rr, a), old(ss, b)).select("k", *PAIR_COLUMNS)
    return delta(r, s, window, batch).unionByName(again)


def static(r: DataFrame, s: DataFrame) -> DataFrame:
    """Both relations as a whole."""
    return _named(r, "r").join(_named(s, "s"), F.col("r_key") == F.col("s_key")).select(PAIR_COLUMNS)
