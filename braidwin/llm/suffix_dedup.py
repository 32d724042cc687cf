"""Suffix-array dedup: byte strings of a given length that stand more than once in the corpus.

A suffix array over all bytes of a corpus fits nowhere, but suffixes need only meet those that share FLOOR bytes with them.
Each start of a FLOOR-byte string is therefore owned by the string's anchor, its k-gram of the least hash (ties: the first):
equal strings have equal anchors at equal places, wherever they stand. The starts with one anchor occurrence are
neighbours and make a segment of some hundred bytes.

1. Anchors: hashes of the anchor and of the segment, no bytes. Equal segments are counted before the shuffle; they repeat as a
   whole and need no comparison, however many there are.
2. Anchors that have several distinct segments: one segment of each kind is cut from its document, and the segments of an
   anchor meet in a task, which makes a suffix array of their starts, cut at MIN bytes (prefix doubling, with the ranks by
   FLOOR bytes on the way). Suffixes of equal rank are the occurrences of one string; with these ordered by place, the
   previous smaller position of a suffix is its neighbour before, so its longest previous factor reaches MIN (or FLOOR)
   bytes if it has one, and the next factor likewise.
3. An anchor with more than HOT distinct segments, as in a passage that stands between ever different texts, isn't brought
   together: digests of its MIN- and FLOOR-byte strings are counted, combined before the shuffle, with the same result.

What is removed is covered by strings of MIN bytes. Factors of FLOOR bytes or more only count: a passage of 51 words may have
less than MIN bytes, and is told by them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwin.llm.common import chunks, grouped, map_batches, remove, shuffle_partitions, shuffled, span_hashes, text_key, text_of, with_columns, written

MIN = 400
#: Bytes from which on a factor is counted: what some 50 words have.
FLOOR = 288
GRAM = 32
#: Distinct segments of an anchor that one task compares; bytes of segments that share a suffix array.
HOT, ARRAY_BYTES = 1500, 1 << 19


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least value of every w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    rows = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    rows[: len(x)] = x
    rows = rows.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def segments(texts: list[bytes], length: int = FLOOR, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each segment: number of the text, place of the anchor, first and last start, hash of the anchor, all within the text."""
    joined = b"".join(texts)
    cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    none = np.zeros(0, np.int64)
    if len(joined) < length:
        return none, none, none, none, none
    buf = np.frombuffer(joined, np.uint8)
    at = np.arange(len(buf) - gram + 1)
    h = span_hashes(buf, at, at + gram)
    # The hash's upper half, then the place: of equal hashes the first.
    least = window_min((h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
    owner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(owner) + 1, bool)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        valid[lo : max(lo, hi - length + 1)] = True
    starts = np.flatnonzero(valid[:-1])
    if not len(starts):
        return none, none, none, none, none
    own = owner[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(own) != 0)]))
    # Texts stand end to end: a start belongs to the last text that begins at or before it.
    lo, hi, p = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1], own[new]
    of = np.searchsorted(cuts, lo, side="right") - 1
    split = np.searchsorted(cuts, hi, side="right") - 1
    assert (of == split).all()
    return of, p - cuts[of], lo - cuts[of], hi - cuts[of], h[p].view(np.int64)


def _anchors(docs: DataFrame, length: int, floor: int) -> DataFrame:
    """(doc_id, key, lo, hi, over, h, seg) of each segment of each text: its first and last start, how many starts at its end have
    less than ``length`` bytes, the hash of its anchor, a digest of its bytes (up to the end of the last start's ``length``, or
    the text's). Segments are told apart by h and seg together, 128 bits."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            for a, b in chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
                own = texts[a:b]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                of, _, lo, hi, h = segments(own, floor)
                seg = b"".join([hashlib.blake2b(own[t][i : j + length], digest_size=8, person=b"%d" % (j - i)).digest() for t, i, j in zip(of.tolist(), lo.tolist(), hi.tolist(), strict=True)])
                ids = batch.slice(a, b - a).select(["doc_id", "key"]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(np.clip(hi + length - sizes[of], 0, hi - lo + 1), pa.int32()), pa.array(h), pa.array(np.frombuffer(seg, "<i8"))], names=["doc_id", "key", "lo", "hi", "over", "h", "seg"])

    return map_batches(docs, found, with_columns(docs.select("doc_id", "key"), lo="int", hi="int", over="int", h="bigint", seg="bigint"))


def ranks(buf: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each of the ascending ``lengths`` the rank of every suffix among all, by so many first bytes; what lies past the end
    counts as zero bytes.

    Prefix doubling. A suffix's sort key and its place share 64 bits where they fit, as sorting numbers takes a fraction of
    the time of sorting places by numbers; arrays of ARRAY_BYTES and one group of HOT segments do fit.
    """
    n = len(buf)
    bits = max(1, n.bit_length())
    size = max(1, min((63 - bits) // 8, *lengths))
    wide = np.concatenate([buf, np.zeros(size, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(size):
        key = (key << np.uint64(8)) | wide[j : j + n]
    places, out, width = np.arange(n, dtype=np.uint64), [], 8 * size
    while True:
        if width + bits <= 64:
            packed = np.sort((key << np.uint64(bits)) | places)
            order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
            sorted_ = packed >> np.uint64(bits)
        else:
            order = np.argsort(key)
            sorted_ = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(sorted_[1:] != sorted_[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        out += [rank] * (len(out) < len(lengths) and size == lengths[len(out)])
        if len(out) == len(lengths) or (n and new[-1] == n - 1):
            return out + [rank] * (len(lengths) - len(out))
        step = min(size, lengths[len(out)] - size)
        key, width = (rank.astype(np.uint64) + np.uint64(1)) << np.uint64(bits), 2 * bits
        key[: n - step] |= rank[step:].astype(np.uint64) + np.uint64(1)
        size += step


def _equal_neighbours(rank: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a suffix of equal rank comes before, or after, in ``order``."""
    suffixes = np.lexsort((order, rank))  # the suffix array, its equal suffixes by place
    same = rank[suffixes][1:] == rank[suffixes][:-1]
    previous, following = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    previous[suffixes[1:]] = same  # the longest previous factor reaches the length of the ranks
    following[suffixes[:-1]] = same
    return previous, following


def repeats(parts: list[bytes], owned: np.ndarray, order: np.ndarray, copies: np.ndarray, length: int, floor: int) -> tuple[list[list[tuple[int, int, bool]]], np.ndarray]:
    """For each segment the runs of its starts (first, last, whether no earlier place has the string) whose strings of ``length``
    stand elsewhere too, and the number of its starts whose strings of ``floor`` do.

    owned: the number of starts of each segment; order: the places of the segments; copies: how often each stands.
    """
    buf = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    at = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(parts)), owned)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(owned) - owned, owned)
    low, high = ranks(buf, floor, length)
    again = copies[of] > 1
    previous, following = _equal_neighbours(low[at[of] + inner], order[of])
    starts = np.bincount(of, weights=previous | following | again, minlength=len(parts)).astype(np.int64)
    whole = np.flatnonzero(inner + length <= sizes[of])  # at a text's end the last starts have less than ``length``
    previous, following = _equal_neighbours(high[at[of] + inner][whole], order[of][whole])
    of, inner, found = of[whole], inner[whole], previous | following | again[whole]
    out: list[list[tuple[int, int, bool]]] = [[] for _ in parts]
    if len(of):
        state = np.where(found, np.where(previous, 1, 2), 0)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(state) != 0) | (np.diff(of) != 0)]))
        last = np.concatenate([new[1:], [len(of)]]) - 1
        for i, j in zip(new.tolist(), last.tolist(), strict=True):
            if state[i]:
                out[of[i]].append((int(inner[i]), int(inner[j]), bool(state[i] == 2)))
    return out, starts


_RUNS = "array<struct<a:int,b:int,first:boolean>>"


def _compared(cut: DataFrame, length: int, floor: int, parts: int) -> DataFrame:
    """(h, seg, starts, runs) of segments whose anchors have few distinct ones."""
    runs_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.bool_())]))

    def judged(rows: pa.Table) -> pa.RecordBatch:
        place = np.lexsort([rows.column(c).to_numpy() for c in ("lo", "key", "doc")])
        order = np.empty(len(place), np.int64)
        order[place] = np.arange(len(place))
        runs, starts = repeats(rows.column("bytes").to_pylist(), rows.column("owned").to_numpy(), order, rows.column("n").to_numpy(), length, floor)
        found = pa.array([[{"a": a, "b": b, "first": f} for a, b, f in x] for x in runs], runs_type)
        return pa.RecordBatch.from_arrays([rows.column("h").combine_chunks(), rows.column("seg").combine_chunks(), pa.array(starts), found], names=["h", "seg", "starts", "runs"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for group in grouped(batches, "h"):
            segs = group.column("seg").to_pylist()
            group = group.take([i for i in range(len(segs)) if i == 0 or segs[i] != segs[i - 1]])  # rows alike in doc_id and text
            kept.append(group)
            size += group.column("bytes").nbytes
            if size >= ARRAY_BYTES:
                yield judged(pa.concat_tables(kept))
                kept, size = [], 0
        if kept:
            yield judged(pa.concat_tables(kept))

    return map_batches(cut.repartition(parts, "h").sortWithinPartitions("h", "seg"), compared, f"h long, seg long, starts long, runs {_RUNS}")


def _counted(cut: DataFrame, length: int, floor: int) -> DataFrame:
    """What ``_compared`` gives, for anchors with any number of distinct segments: every string of theirs by its digest.

    Of each string one row is left, that of its first place: of strings that stand once it tells where they do, so that the
    starts of those that stand again are all others, and need not be joined with the counts.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ((True, floor, b"floor"), (False, length, b"length"))
        for batch in batches:
            pieces, owned = batch.column("bytes").to_pylist(), batch.column("owned").to_pylist()
            for i, (piece, n) in enumerate(zip(pieces, owned, strict=True)):
                for low, size, name in kinds:
                    m = max(0, min(n, len(piece) - size + 1))
                    row = batch.slice(i, 1).select(["h", "seg", "n", "doc", "key", "lo"]).take(pa.array(np.zeros(m, np.int64)))
                    digest = pa.array([hashlib.blake2b(piece[j : j + size], digest_size=16, person=name).digest() for j in range(m)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, low)), digest], names=["h", "seg", "n", "doc", "key", "lo", "a", "low", "digest"])

    kinds = cut.dropDuplicates(["h", "seg"])
    each = map_batches(kinds, digests, "h long, seg long, n long, doc long, key long, lo int, a int, low boolean, digest binary")
    firsts = each.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "key", "lo", "h", "seg", "a", "low")).alias("x")).select("n", "x.*")
    found = firsts.groupBy("h", "seg").agg(F.count_if(F.col("low") & (F.col("n") == 1)).alias("lone"), F.collect_list(F.when(~F.col("low") & (F.col("n") == 1), F.col("a"))).alias("once"), F.collect_list(F.when(~F.col("low") & (F.col("n") > 1), F.col("a"))).alias("first"))
    whole = F.greatest(F.lit(0), F.least(F.col("owned"), F.octet_length("bytes") - (length - 1))).cast("int")
    rows = kinds.select("h", "seg", "owned", whole.alias("whole")).join(shuffled(found), ["h", "seg"], "left")
    none = F.expr("cast(array() as array<int>)")
    rows = rows.withColumns({"once": F.coalesce("once", none), "first": F.coalesce("first", none), "lone": F.coalesce("lone", F.lit(0))})
    every = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(none)
    rest = F.array_except(every, F.concat("once", "first"))
    run = lambda first: lambda a: F.struct(a.alias("a"), a.alias("b"), F.lit(first).alias("first"))
    runs = F.concat(F.transform("first", run(True)), F.transform(rest, run(False)))
    return rows.select("h", "seg", (F.col("owned") - F.col("lone")).alias("starts"), runs.alias("runs"))


def spans(docs: DataFrame, text: str = "text", length: int = MIN, keep_first: bool = True, floor: int = FLOOR) -> DataFrame:
    """(doc_id, key, spans, n_factors): for each row with any, the bytes covered by a string of ``length`` bytes that also stands
    elsewhere, and the number of starts whose longest previous or next factor has ``floor`` bytes or more (at most ``length``).

    spans: ascending, neither touching nor overlapping (lo, hi) places in the UTF-8 bytes, hi exclusive. ``keep_first``: a
    string's first place (by doc_id, then a hash of the text, then place) is not covered by it; else all its places are.
    Strings do not cross documents; overlapping ones count; they are judged on the input. Rows that are alike in doc_id and
    text repeat one another; each is the first place of its strings if one is. Null and short texts have no spans.
    """
    spark = docs.sparkSession
    floor = min(floor, length)
    # A key of no nulls: rows that differ in it differ in doc_id or text.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text_key(text).alias("key"), text_of(text).cast("binary").alias("text"))
    every = written(_anchors(rows.where(F.octet_length("text") >= floor), length, floor), "anchors")
    kinds = every.groupBy("h", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "lo", "hi", "over")).alias("rep"))
    kinds = written(kinds, "kinds")
    anchors = kinds.groupBy("h").agg(F.count("*").alias("d"), F.sum("n").alias("total")).where("total > 1")
    open_ = written(kinds.join(anchors, "h").drop("total"), "repeated")
    remove(kinds)
    # Where one kind of segment is all an anchor has, it repeats as a whole, but for strings that the text is too short for.
    whole = f"cast(filter(array(named_struct('a', 0, 'b', rep.hi - rep.lo - rep.over, 'first', true)), x -> x.b >= 0) as {_RUNS})"
    alone = open_.where("d = 1").select("h", "seg", F.expr("cast(rep.hi - rep.lo + 1 as bigint)").alias("starts"), F.expr(whole).alias("runs"))
    cut = _cut(rows, open_.where("d > 1"), length)
    hot = open_.where(F.col("d") > HOT).limit(1).count() > 0
    if hot:
        cut = written(cut, "segments")
    parts = 4 * shuffle_partitions(spark)
    judged = _compared(cut.where(F.col("d") <= HOT), length, floor, parts)
    if hot:
        judged = judged.unionByName(_counted(cut.where(F.col("d") > HOT), length, floor))
    reps = open_.select("h", "seg", F.col("rep.doc_id").alias("r_doc"), F.col("rep.key").alias("r_key"), F.col("rep.lo").alias("r_lo"))
    runs = written(alone.unionByName(judged).where("starts > 0"), "runs")
    if hot:
        remove(cut)
    placed = every.join(runs.join(reps, ["h", "seg"]) if keep_first else runs, ["h", "seg"])
    own = F.col("runs")
    if keep_first:
        is_rep = (F.col("doc_id") == F.col("r_doc")) & (F.col("key") == F.col("r_key")) & (F.col("lo") == F.col("r_lo"))
        own = F.filter("runs", lambda x: ~(is_rep & x["first"]))
    covered = F.transform(own, lambda x: F.struct((F.col("lo") + x["a"]).alias("lo"), (F.col("lo") + x["b"] + length).alias("hi")))
    each = placed.select("doc_id", "key", "lo", "starts", covered.alias("c"))
    # Rows alike in doc_id and text have the same segments, each counts once.
    by_doc = each.groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "starts", "c")).alias("found"))
    n_factors = F.aggregate("found", F.lit(0).cast("long"), lambda acc, x: acc + x["starts"])
    by_doc = by_doc.select("doc_id", "key", F.array_sort(F.flatten(F.transform("found", lambda x: x["c"]))).alias("c"), n_factors.alias("n_factors"))
    # Each start has one owner, so in the order of their first bytes the runs' last bytes rise as well: a span ends where the next run begins later.
    merged = F.expr("""transform(arrays_zip(filter(c, (x, i) -> i = 0 or get(c, i - 1).hi < x.lo), filter(c, (x, i) -> i = size(c) - 1 or get(c, i + 1).lo > x.hi)),
        x -> named_struct('lo', x['0'].lo, 'hi', x['1'].hi))""")
    return by_doc.select("doc_id", "key", merged.alias("spans"), "n_factors")


def _cut(rows: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """(h, seg, n, d, doc, key, lo, owned, bytes): one segment of each kind, cut from its document; owned: the number of its starts."""
    by_doc = reps.groupBy(F.col("rep.doc_id").alias("_d"), F.col("rep.key").alias("_k")).agg(F.collect_list(F.struct("h", "seg", "n", "d", F.col("rep.lo").alias("lo"), F.col("rep.hi").alias("hi"))).alias("cuts"))
    wanted = rows.join(by_doc, (F.col("doc_id") == F.col("_d")) & (F.col("key") == F.col("_k")))
    each = wanted.select("text", F.col("doc_id").alias("doc"), "key", F.explode("cuts").alias("c"))
    return each.select("c.h", "c.seg", "c.n", "c.d", "doc", "key", "c.lo", F.expr("cast(c.hi - c.lo + 1 as bigint)").alias("owned"), F.expr(f"substring(text, c.lo + 1, c.hi - c.lo + {length})").alias("bytes"))


_SPANS = "array<struct<lo:int,hi:int>>"
_COLUMNS = {"n_bytes": "bigint", "n_removed": "bigint", "spans": _SPANS, "n_factors": "bigint", "kept": "binary"}


def dedup(docs: DataFrame, text: str = "text", length: int = MIN, keep_first: bool = True, floor: int = FLOOR) -> DataFrame:
    """``docs`` with n_bytes and n_removed, spans and n_factors (see ``spans``; empty and 0 without any) and kept, the bytes left, in order."""
    docs = docs.drop(*_COLUMNS)
    found = written(spans(docs, text, length, keep_first, floor).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "spans", "n_factors"), "spans")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.join(shuffled(found), (doc == F.col("_d")) & (text_key(text) == F.col("_k")), "left").drop("_d", "_k")
    data = text_of(text).cast("binary")
    rows = rows.withColumns({"spans": F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")), "n_factors": F.coalesce("n_factors", F.lit(0).cast("long")), "n_bytes": F.octet_length(data).cast("long")})
    # The gaps between spans, joined as characters of one byte each: the time is that of the text, however many they are.
    gap = lambda i: F.substring(data, F.coalesce(F.get("spans", i - 1)["hi"], F.lit(0)) + 1, F.coalesce(F.get("spans", i)["lo"], F.lit(2147483647)) - F.coalesce(F.get("spans", i - 1)["hi"], F.lit(0)))
    kept = F.encode(F.array_join(F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.decode(gap(i), "ISO-8859-1")), ""), "ISO-8859-1")
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["hi"] - x["lo"])
    return rows.withColumns({"n_removed": n_removed, "kept": F.when(F.size("spans") == 0, data).otherwise(kept)})
