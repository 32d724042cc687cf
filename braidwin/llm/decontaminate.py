"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every test suffix.

A Python worker makes its documents, some megabytes at a time, into a shard: the words as numbers of the benchmark's
vocabulary (0: not in it) and a suffix array of the word positions, cut to one window. A suffix that starts with a word
that begins no test suffix, or that meets an unknown word before the shortest window that starts so, can equal no
window; such suffixes are left out of the array. Every test suffix is then binary-searched in every shard. Windows that
occur one word after the other along one alignment are one verbatim match, of which length and place are reported.

The benchmark goes to the executors in blocks of about BLOCK_BYTES, one after the other; documents pass once for each block,
and what they hit is written, so neither side need fit anywhere. Documents are not shuffled where one block is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwin.llm.common import WORD_TABLE, map_batches, text_chunks, text_key, with_columns, written

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20


class TestIndex:
    """The test suffixes of a block of items: each distinct window once, with the items and places that have it."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.window, self.vocabulary = window, {}
        found: dict[bytes, list[tuple[int, int]]] = {}
        self.item_ids = [x for x, _ in items]
        for k, (_, text) in enumerate(items):
            words = (text or "").encode().translate(WORD_TABLE).split()
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], ">u4")
            for j in range(max(1, len(ids) - window + 1) if len(ids) else 0):
                found.setdefault(ids[j : j + window].tobytes(), []).append((k, j))
        keys = sorted(found)
        self.sizes = np.array([len(k) // 4 for k in keys], np.int64)
        self.low = np.array([k.ljust(4 * window, b"\0") for k in keys], f"S{4 * window}")
        self.high = np.array([k.ljust(4 * window, b"\xff") for k in keys], f"S{4 * window}")
        self.at = np.concatenate([[0], np.cumsum([len(found[k]) for k in keys])]).astype(np.int64)
        self.places = np.array([p for k in keys for p in found[k]], np.int64).reshape(-1, 2)
        #: For each word number, the words of the shortest window that begins with it.
        self.need = np.full(len(self.vocabulary) + 1, window + 1, np.int64)
        for k in keys:
            first = int.from_bytes(k[:4], "big")
            self.need[first] = min(self.need[first], len(k) // 4)


def search(index: TestIndex, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each text in the shard (one more entry), and the occurrences: shard position, words, item, place in the item."""
    words = [t.translate(WORD_TABLE).split() for t in texts]
    cuts = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))])
    ids = np.zeros(cuts[-1] + index.window, ">u4")
    get = index.vocabulary.get
    for w, lo in zip(words, cuts, strict=False):
        ids[lo : lo + len(w)] = np.fromiter(map(get, w, repeat(0)), np.uint32, len(w))
    n = int(cuts[-1])
    empty = np.zeros(0, np.int64)
    if not n or not len(index.low):
        return cuts, empty, empty, empty, empty
    unknown = np.flatnonzero(ids == 0)
    plain = ids[:n].astype(np.int64)
    start = np.flatnonzero(plain)
    start = start[unknown[np.searchsorted(unknown, start)] - start >= index.need[plain[start]]]
    suffix = np.lib.stride_tricks.sliding_window_view(ids, index.window)[start].copy()
    suffix[np.cumsum(suffix == 0, axis=1) > 0] = 0
    keys = suffix.reshape(-1).view(f"S{4 * index.window}") if len(start) else np.zeros(0, f"S{4 * index.window}")
    order = np.argsort(keys, kind="stable")
    keys, start = keys[order], start[order]
    lo, hi = np.searchsorted(keys, index.low, "left"), np.searchsorted(keys, index.high, "right")
    which, at = _ranges(lo, hi)
    pos, size = start[at], index.sizes[which]
    hit, place = _ranges(index.at[which], index.at[which + 1])
    return cuts, pos[hit], size[hit], index.places[place, 0], index.places[place, 1]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every range the numbers in it: number of the range, number."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _longest(doc: np.ndarray, pos: np.ndarray, size: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each document with occurrences: its number, and length, first word and item of its longest verbatim match (ties: the first place, then the least id as a string)."""
    order = np.lexsort((pos, pos - place, item, doc))
    doc, pos, size, item, diagonal = doc[order], pos[order], size[order], item[order], (pos - place)[order]
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(pos) != 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    length = pos[last] + size[last] - pos[first]
    best = np.lexsort((item[first], pos[first], -length, doc[first]))
    best = best[np.concatenate([[True], np.diff(doc[first][best]) != 0])]
    return doc[first][best], length[best], pos[first][best], item[first][best]


_COLUMNS = {"n_words": "bigint", "hits": "array<struct<lo:bigint,hi:bigint>>", "items": "array<string>", "longest_match": "bigint", "longest_start": "bigint", "longest_item": "string"}


def _matches(docs: DataFrame, index: TestIndex, text: str) -> tuple[DataFrame, Broadcast]:
    """``docs`` with _COLUMNS, and the broadcast index, to be destroyed once the rows are written."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    spans_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, texts in text_chunks(batches, text, SHARD_BYTES):
            cuts, pos, size, item, place = search(own, texts)
            n_words = np.diff(cuts) - 1
            mark = np.zeros(cuts[-1] + WINDOW + 1, np.int64)
            np.add.at(mark, pos, 1)
            np.add.at(mark, pos + size, -1)
            hit = np.cumsum(mark) > 0
            edge = np.diff(hit.view(np.int8), prepend=0)
            los, his = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            doc_of_run = np.searchsorted(cuts, los, side="right") - 1
            runs: list[list] = [[] for _ in texts]
            for d, lo, hi in zip(doc_of_run.tolist(), (los - cuts[doc_of_run]).tolist(), (his - cuts[doc_of_run]).tolist(), strict=True):
                runs[d].append({"lo": lo, "hi": hi})
            doc = np.searchsorted(cuts, pos, side="right") - 1
            items: list[list] = [[] for _ in texts]
            best: list[tuple] = [(0, None, None)] * len(texts)
            if len(doc):
                for d, k in np.unique(np.stack([doc, item], axis=1), axis=0).tolist():
                    items[d].append(own.item_ids[k])
                for d, length, at, k in zip(*(x.tolist() for x in _longest(doc, pos, size, item, place)), strict=True):
                    best[d] = (length, at - int(cuts[d]), own.item_ids[k])
            items = [sorted({k for k in x if k is not None}) for x in items]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(runs, spans_type), pa.array(items, pa.list_(pa.string())), *(pa.array([b[i] for b in best], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], names=[*batch.schema.names, *_COLUMNS])

    return map_batches(docs, matched, with_columns(docs, **_COLUMNS)), sent


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (runs of hit words, from 0, end exclusive), n_hit, items (ids as sorted strings), longest_match
    (words), longest_start, longest_item, and contaminated (a word is hit and 20 times the hit words are as many as all words).

    Null and empty texts have no words. Items without words have no window; repeated items count once; an item without id
    hits words but is not listed. Rows of ``docs`` that are alike in doc_id and text are judged alike and each stays.
    """
    docs = docs.drop(*_COLUMNS, "n_hit", "contaminated")
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) * 2 // block_bytes))
    def index(k: int) -> TestIndex:
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        return TestIndex(sorted(((r.id, r.t) for r in block.collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1])), window)

    if blocks == 1:
        out, _ = _matches(docs, index(0), text)
    else:
        key = docs.select("*", text_key(text).alias("_key"))
        every = None
        # One block at a time is collected, searched and written; its index is gone before the next is made.
        for k in range(blocks):
            part, sent = _matches(key.select("doc_id", "_key", F.col(text).alias("_text")), index(k), "_text")
            part = written(part.drop("_text").where(F.size("hits") > 0), "block")
            sent.destroy()
            every = part if every is None else every.unionByName(part)
        # Most documents match no block: only those that do are grouped, the words are counted by the first pass.
        # Ties as within a block: the first place, then the least item, one without id before all.
        best = F.min(F.struct((-F.col("longest_match")).alias("n"), "longest_start", "longest_item"))
        hit = every.groupBy("doc_id", "_key").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), best.alias("_best"))
        hit = hit.withColumns({"_doc": F.col("doc_id"), "_k": F.col("_key")}).drop("doc_id", "_key")
        counted = _matches(key, TestIndex([], window), text)[0].drop("hits", "items", "longest_match", "longest_start", "longest_item")
        joined = counted.join(hit, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_k")), "left")
        merged = F.expr("""aggregate(array_sort(hits), cast(array() as array<struct<lo:bigint,hi:bigint>>),
            (a, x) -> if(size(a) = 0 or element_at(a, -1).hi < x.lo, array_append(a, x), array_append(slice(a, 1, size(a) - 1), named_struct('lo', element_at(a, -1).lo, 'hi', greatest(element_at(a, -1).hi, x.hi)))))""")
        out = joined.withColumns({
            "hits": F.coalesce(merged, F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")), "items": F.coalesce("items", F.expr("cast(array() as array<string>)")),
            "longest_match": F.coalesce(-F.col("_best.n"), F.lit(0)), "longest_start": F.col("_best.longest_start"), "longest_item": F.col("_best.longest_item"),
        }).drop("_doc", "_k", "_best", "_key")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    out = out.withColumns({"n_hit": n_hit, "items": F.filter("items", lambda x: x.isNotNull())})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def items_sha256(items: str = "items"):
    return F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct(items))).cast("binary"), 256)
