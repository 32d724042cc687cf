"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

A document's tokens are cut every ``window`` tokens; the full pieces fill a window each, the remainders are packed. Every
FILLER_ONE_IN-th remainder is cut into pieces of FILLER tokens: the differencing ends with imbalances about as large as
its smallest pieces, so a few small ones make the windows nearly equal.

Remainders are dealt at random into buckets of about BUCKET rows, which are packed on their own: with k windows, each
piece begins as a k-tuple of loads with itself in one place; the two tuples of the largest imbalance are merged, the
largest load of one to the smallest of the other, until one is left. If its largest load exceeds the window, k rises.
"""

from __future__ import annotations

import gc
import heapq
import os
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwin.llm.common import grouped, map_batches, shuffle_partitions, text_chunks, with_columns, written

WINDOW = 4096
BUCKET = 2048
FILLER, FILLER_ONE_IN = 32, 64
END_ID = 2
#: Bytes of text that are encoded together.
ENCODE_BYTES = 4 << 20
CACHE_WORDS = 1_000_000
PUNCTUATION = string.punctuation.encode()
_TOKENIZERS: dict[str, _Words] = {}
#: The characters that byte-level encodings show bytes as: printable ones of Latin-1 as themselves, the others from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SHOWN = {b: 256 + n for n, b in enumerate(_HIDDEN)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """A word as letters and the ASCII punctuation after them, which the tokenizer splits and encodes apart; else the word alone.

    Of the letters A-Z are lower-cased, as the tokenizer does, so one entry serves all of a word's forms.
    """
    if b"<|" in word:
        return word, b""  # special tokens have capitals of their own
    if word.islower() and word.isalpha():
        return word, b""  # one object for both tables
    stem = word.rstrip(PUNCTUATION)
    if len(stem) == len(word):
        return word.lower(), b""
    if not stem.isalpha():
        text = stem.decode(errors="replace")
        if not (text.isalpha() and text.lower().isalpha()):  # a small letter may come with a mark, which would go to the punctuation
            return word.lower(), b""
    return stem.lower(), word[len(stem) :]


def _plain(stem: bytes) -> str | None:
    """The stem as the merges see it, a character for each byte, if it is of letters that need no normalising; else None."""
    if stem.isalpha():
        return stem.decode()
    text = stem.decode(errors="replace")
    if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
        return stem.decode("latin-1").translate(_SHOWN)
    return None


class _Words(dict):
    """The ids of words, as bytes; a word is encoded when it is first asked for."""

    def __init__(self, tokenizer, known: dict = (), stems: dict = ()) -> None:
        super().__init__(known)
        self.tokenizer, self.model, self.stems = tokenizer, tokenizer.model, {**dict(stems), b"": b""}

    def __missing__(self, word: bytes) -> bytes:
        stem, tail = _parts(word)
        ids = self.stems.get(stem)
        if ids is None:
            ids = self.stem(stem)
        if tail:
            end = self.stems.get(tail)
            ids += self.stem(tail) if end is None else end
        self[word] = ids
        return ids

    def stem(self, stem: bytes) -> bytes:
        shown = _plain(stem)
        if shown is None:
            ids = self.tokenizer.encode(stem.decode(errors="replace"), add_special_tokens=False).ids
        else:  # nothing is normalised or split in a word of small letters: the merges are all there is to do
            ids = [t.id for t in self.model.tokenize(shown)]
        ids = self.stems[stem] = array("I", ids).tobytes()
        return ids


def encode(path: str, texts: list[bytes]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token or rule of it looks past any, so the ids of a text are those of its
    white-space separated words one after the other. A worker keeps those of CACHE_WORDS words at most, for good those of
    the first half, as frequent words come early.
    """
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = _Words(Tokenizer.from_file(path))
    words = _TOKENIZERS[path]
    out = []
    for text in texts:
        out.append(b"".join(map(words.__getitem__, text.split())))
        if len(words) + len(words.stems) > CACHE_WORDS:
            words = _TOKENIZERS[path] = _Words(words.tokenizer, islice(words.items(), CACHE_WORDS // 4), islice(words.stems.items(), CACHE_WORDS // 4))
    return out


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of k, for each piece: Karmarkar-Karp differencing over k-tuples."""
    n = len(sizes)
    if k == 1 or n < 2:
        return np.zeros(n, np.int64)
    loads: dict[int, np.ndarray] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []

    def tuple_of(i: int) -> np.ndarray:
        if i >= n:
            return loads.pop(i)
        one = np.zeros(k, np.int64)
        one[0] = sizes[i]
        return one

    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = tuple_of(a) + tuple_of(b)[::-1]
        order = np.argsort(-both, kind="stable")
        loads[node] = both = both[order]
        merges.append((node, a, b, order.astype(np.int32)))
        heapq.heappush(heap, (int(both[-1] - both[0]), node))
    out, windows = np.zeros(n, np.int64), {2 * n - 2: np.arange(k)}
    for node, a, b, order in reversed(merges):
        place = np.empty(k, np.int64)
        place[order] = windows.pop(node)
        for child, own in ((a, place), (b, place[::-1])):
            if child < n:
                out[child] = own[0]
            else:
                windows[child] = own
    return out


def assign(sizes: np.ndarray, window: int) -> np.ndarray:
    """The window of each piece (none is larger than a window), of as few windows as the differencing can keep within capacity."""
    k, tries = max(1, -(-int(sizes.sum()) // window), int((sizes > window // 2).sum())), 0
    while True:
        at = difference(sizes, k)
        excess = np.maximum(np.bincount(at, weights=sizes, minlength=k) - window, 0).sum()
        if not excess:
            return at
        tries += 1
        k += max(1, int(excess // window), tries // 8)


def _cuts(n: int, window: int, filler: bool) -> list[int]:
    full = n // window * window
    cuts = list(range(0, full, window))
    if n > full:
        cuts += range(full, n, FILLER) if filler else [full]
    return [*cuts, n]


_PIECE = {"start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint"}


def pieces(docs: DataFrame, tokenizer: str | None = None, text: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: the columns of ``docs`` but the text, start, length, ids_crc32, doc_tokens (and ids)."""
    path = tokenizer or default_tokenizer()
    docs = docs.drop(*_PIECE, "ids", "_row").withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    end = np.array([end_id], "<u4").tobytes()
    keep = [c for c in docs.columns if c != text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text, ENCODE_BYTES):
            rows = batch.column("_row").to_pylist()
            of, found, ids = [], [], []
            gc.disable()  # the many words are no cycles, but make the collector look through the cache again and again
            try:
                every = encode(path, texts)
            finally:
                gc.enable()
            for i, encoded in enumerate(every):
                encoded += end
                n = len(encoded) // 4
                at = _cuts(n, window, rows[i] % FILLER_ONE_IN == 0)
                view = memoryview(encoded)
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    of.append(i)
                    found.append((lo, hi - lo, zlib.crc32(view[4 * lo : 4 * hi]), n))
                    if with_ids:
                        ids.append(np.frombuffer(view[4 * lo : 4 * hi], np.int32))
            taken = batch.select(keep).take(pa.array(of, pa.int64()))
            arrays = [pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [[]] * 4)]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*taken.columns, *arrays], names=[*keep, *_PIECE, *["ids"] * with_ids])

    schema = with_columns(docs.select(keep), **_PIECE, **({"ids": "array<int>"} if with_ids else {}))
    return map_batches(docs, cut, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``pieces`` with sequence_id and offset: every token of every document, an ``end_id`` after each, lies in one piece.

    A null or empty text has its ``end_id`` alone. A sequence has at most ``window`` tokens, its pieces stand one after the
    other from 0. Equal rows are packed each on its own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs.drop("sequence_id", "offset"), tokenizer, text, window, end_id, with_ids), "pieces")
    rest = cut.where(F.col("start") >= F.col("doc_tokens") - F.col("doc_tokens") % window).select("_row").distinct().count()
    buckets = max(1, -(-rest // BUCKET))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    schema = with_columns(cut.drop("_row"), sequence_id="bigint", offset="bigint")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "_bucket"):
            size = group.column("length").to_numpy()
            full = size == window
            part = np.flatnonzero(~full)
            at = np.zeros(len(size), np.int64)
            at[part] = assign(size[part], window)
            first = at[part].max(initial=-1) + 1
            at[full] = first + np.arange(full.sum())
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(size[order])
            new = np.concatenate([[True], np.diff(at[order]) != 0]) if len(order) else np.zeros(0, bool)
            begin = (ends - size[order])[np.flatnonzero(new)][np.cumsum(new) - 1]
            offset = np.empty(len(size), np.int64)
            offset[order] = ends - size[order] - begin
            sequence = (group.column("_bucket")[0].as_py() << 32) + at
            out = group.drop_columns(["_bucket", "_row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from out.combine_chunks().to_batches(max_chunksize=65536)

    # A bucket is some thousand small rows, whatever the size of the table.
    sorted_ = dealt.repartition(min(buckets, max(shuffle_partitions(spark), buckets // 64)), "_bucket").sortWithinPartitions("_bucket", "_row", "start")
    return map_batches(sorted_, packed, schema)
