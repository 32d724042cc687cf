"""Token counts by section: every document is encoded in chunks whose tokens are those of the whole, its tokens' character spans
are joined to sections.

The encoding is byte-level, so its tokens cover the text without a gap; token spans and section spans are both sorted, and
the interval join of a document is one merge of the two. A token that crosses a boundary is allocated by RULE:

- ``start``: wholly to the section that has its first character;
- ``majority``: wholly to the section that has most of its bytes (ties: the first);
- ``share``: to each section in proportion to the bytes that it has of it (fractions).

A token whose bytes are a part of one character belongs to where that character stands.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from braidwin.llm.common import map_batches, text_chunks, with_columns

RULES = ("start", "majority", "share")
CACHE_CHUNKS = 200_000
#: The characters of Unicode's White_Space property.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: White space and the black characters after it: the encoding's own splitting never looks past the end of such a chunk.
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_ENCODERS: dict[str, tuple] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The byte-level encoding of a ranks file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_bytes(path: str, text: str) -> np.ndarray:
    """The length in bytes of each token of the whole text, encoded chunk by chunk."""
    if path not in _ENCODERS:
        own = encoder(path)
        sizes = np.zeros(own.n_vocab + 1, np.uint16)
        for token, rank in own._mergeable_ranks.items():
            sizes[rank] = len(token)
        _ENCODERS[path] = (own, sizes, {})
    own, sizes, cache = _ENCODERS[path]
    if len(cache) > CACHE_CHUNKS:
        cache.clear()
    chunks = _CHUNK.findall(text)
    try:
        return np.frombuffer(b"".join(map(cache.__getitem__, chunks)), np.uint16)
    except KeyError:
        for c in chunks:
            if c not in cache:
                cache[c] = sizes[own.encode_ordinary(c)].tobytes()
        return np.frombuffer(b"".join(map(cache.__getitem__, chunks)), np.uint16)


def lines(data: bytes) -> np.ndarray:
    """Where the sections begin and the last one ends, in bytes: lines, each with its line feed."""
    buf = np.frombuffer(data, np.uint8)
    return np.unique(np.concatenate([[0], np.flatnonzero(buf == 10) + 1, [len(buf)]]))


def attribute(sizes: np.ndarray, data: bytes, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section ``data[cuts[i]:cuts[i + 1]]``, and the tokens that begin in it and go past its end."""
    n = len(cuts) - 1
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    # To whole characters: a start goes back to, an end forward to the next first byte of a character.
    lead = np.flatnonzero(np.append((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, True))
    starts = lead[np.searchsorted(lead, starts, "right") - 1]
    ends = lead[np.searchsorted(lead, ends, "left")]
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.searchsorted(cuts, ends, "left") - 1
    cross = np.flatnonzero(last > first)
    over = np.bincount(first[cross], minlength=n)
    if rule == "start" or not len(cross):
        return np.bincount(first, minlength=n).astype(float), over
    out = np.bincount(first[last == first], minlength=n).astype(float)
    for t in cross.tolist():
        s = np.arange(first[t], last[t] + 1)
        part = np.minimum(cuts[s + 1], ends[t]) - np.maximum(cuts[s], starts[t])
        if rule == "share":
            out[s] += part / part.sum()
        else:
            out[s[np.argmax(part)]] += 1
    return out, over


_COLUMNS = {"section": "bigint", "char_start": "bigint", "char_end": "bigint", "n_tokens": "double", "n_crossing": "bigint", "doc_tokens": "bigint"}


def token_counts(docs: DataFrame, ranks: str | None = None, text: str = "text", rule: str = "start") -> DataFrame:
    """A row for each section (line, with its line feed) of each document: the columns of ``docs`` but the text, section (from 0),
    char_start and char_end (code points, end exclusive), n_tokens (allocated by ``rule``), n_crossing (tokens that begin here
    and end in a later section) and doc_tokens.

    The n_tokens of a document add up to its doc_tokens. A null or empty text is one section of no characters and no tokens.
    Equal rows are counted each on its own; columns of ``docs`` with the names of the results are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}: one of {', '.join(RULES)}")
    path = ranks or default_ranks()
    docs = docs.drop(*_COLUMNS)
    keep = [c for c in docs.columns if c != text]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text):
            of, parts = [], []
            for i, data in enumerate(texts):
                sizes = token_bytes(path, data.decode(errors="surrogateescape"))
                cuts = lines(data) if data else np.array([0, 0])
                n, over = attribute(sizes, data, cuts, rule) if data else (np.zeros(1), np.zeros(1, np.int64))
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[cuts]
                of.append(np.full(len(n), i))
                parts.append((np.arange(len(n)), chars[:-1], chars[1:], n, over, np.full(len(n), len(sizes))))
            if not of:
                continue
            taken = batch.select(keep).take(pa.array(np.concatenate(of)))
            arrays = [pa.array(np.concatenate(x).astype(np.float64 if i == 3 else np.int64)) for i, x in enumerate(zip(*parts, strict=True))]
            yield pa.RecordBatch.from_arrays([*taken.columns, *arrays], names=[*keep, *_COLUMNS])

    return map_batches(docs, counted, with_columns(docs.select(keep), **_COLUMNS))
