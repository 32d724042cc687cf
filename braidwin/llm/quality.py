"""Quality classifier: supervised subword embeddings.

Every text is a bag of hashed features: its white-space separated words, the byte 3- to 5-grams of these, a word's edges
included, and for each pair of neighbouring words one pseudo-word that tells how far back the same pair stood before (the
words of a repeated line are new to any vocabulary; that they come again is not). Each feature has a learned vector; a text's vector is the mean over its features; a softmax layer gives
the classes. Vectors and layer are trained together by stochastic gradient descent in numpy.

At scoring time the mean and the layer are both linear, so ``mean(E[f]) @ w = mean(E @ w)[f]``: one number a feature is
all that the executors need (2**BITS floats, a fixed size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwin.llm.common import held_out, map_batches, mix, span_hashes, spans, text_chunks, text_of, with_columns

BITS = 18
DIM = 8
EPOCHS, RATE, BOOST = 8, 0.3, 50
GRAMS = (3, 4, 5)
#: Bytes of text whose features are made together: each takes some hundred bytes for a moment.
FEATURE_BYTES = 1 << 18
#: At most so many labelled rows of each class are learned from, the first in the order of a hash of doc_id.
MAX_TRAIN_PER_CLASS = 1200
#: Bytes of text of a class that are learned from, at most.
MAX_TRAIN_BYTES = 24 << 20
_SPACES = bytes(32 if c in b" \t\n\r\x0b\x0c\x00" else c for c in range(256))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of every text, and the number of the text that each belongs to (ascending within a kind)."""
    buf = np.frombuffer(b" " + b" ".join(texts).translate(_SPACES) + b" " * max(GRAMS), np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc_of = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    doc_of = np.concatenate([[0], doc_of, np.full(len(buf) - 1 - len(doc_of), len(texts) - 1)]).astype(np.int32)
    black = buf != 32
    starts, ends = spans(black)
    words, of = span_hashes(buf, starts, ends), doc_of[starts]
    found = [(words >> np.uint64(64 - BITS)).astype(np.int32), _recency(words, of)]
    owner = [of, of[1:][of[1:] == of[:-1]]]
    n = len(buf) - max(GRAMS) + 1
    wide = buf.astype(np.uint64)
    packed, inner = wide[:n].copy(), np.ones(n, bool)
    for size in range(2, max(GRAMS) + 1):
        packed = (packed << np.uint64(8)) | wide[size - 1 : size - 1 + n]
        if size > 2:
            inner &= black[size - 2 : size - 2 + n]
        if size in GRAMS:
            at = np.flatnonzero(inner)
            h = (packed[at] + np.uint64(size << 56)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((h >> np.uint64(64 - BITS)).astype(np.int32))
            owner.append(doc_of[at + 1])
    return np.concatenate(found), np.concatenate(owner)


def _recency(words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each pair of neighbouring words of one text: the bucket of the gap, in powers of two, to the pair's last occurrence there."""
    at = np.flatnonzero(of[1:] == of[:-1])
    pair = mix(words[at] * np.uint64(3) + words[at + 1] + of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(pair, kind="stable")
    again = pair[order][1:] == pair[order][:-1]
    gap = np.zeros(len(at), np.int64)
    gap[order[1:][again]] = (at[order[1:]] - at[order[:-1]])[again]
    kind = np.where(gap == 0, 0, 1 + np.minimum(np.log2(np.maximum(gap, 1)).astype(np.int64), 9))
    return (mix(kind.astype(np.uint64) + np.uint64(977)) >> np.uint64(64 - BITS)).astype(np.int32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches, limit=FEATURE_BYTES):
        ids, owner = features(texts)
        order = np.argsort(owner, kind="stable")
        ids, cuts = ids[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
        bags = [np.unique(ids[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({
            "ord": batch.column("ord"), "label": batch.column("label"),
            "ids": pa.array([x.astype(np.int32).tobytes() for x, _ in bags], pa.binary()),
            "counts": pa.array([c.astype(np.int32).tobytes() for _, c in bags], pa.binary()),
        })


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """(ord, label, text): a bounded sample of the rows whose labels may be learned from.

    A doc_id with several labels counts as 1 if one of them is 1. At most ``per_class`` ids of each class are taken, in
    the order of a hash of doc_id, and of these as many as have ``class_bytes`` of text together, without those that have more
    than a hundredth of it; so what is broadcast and learned from is bounded whatever the size of the tables and texts.
    """
    seen = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("ord", F.xxhash64("doc_id"))
    some = [seen.where(F.col("label") == k).orderBy("ord", "doc_id").limit(per_class) for k in (0, 1)]
    size = F.sum(F.octet_length(text_of())).alias("size")
    sized = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id").groupBy("label", "ord", "doc_id").agg(size).where(F.col("size") <= class_bytes // 100)
    upto = F.sum("size").over(Window.partitionBy("label").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = sized.withColumn("upto", upto).where(F.col("upto") <= class_bytes).select("doc_id", "ord", "label")
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(taken), "doc_id").select("ord", "label", "text")


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learn from (label, feature ids, counts); returns one weight a feature and the bias of the two-class softmax."""
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    W, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    seen = np.zeros(1 << BITS, bool)
    n = np.array([sum(y == k for y, _, _ in bags) for k in (0, 1)])
    if not n.all():
        return np.zeros(1 << BITS, np.float32), 0.0 if not n.any() else float(4 * np.sign(n[1] - n[0]))
    cost = n.sum() / (2 * n)
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            y, ids, share = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            x = share @ E[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = W @ x + bias
            p = np.exp(z - z.max())
            err = (p / p.sum()).astype(np.float32)
            err[y] -= 1
            err *= np.float32(min(cost[y], 4.0) * lr)
            if len(ids):
                # A mean over thousands of features moves each by a hair: scaled by their number as if each were an example.
                E[ids] -= np.outer(share * np.float32(min(len(ids), BOOST)), err @ W)
                seen[ids] = True
            W -= np.outer(err, x)
            bias -= np.float32(0.1) * err
    weight = E @ (W[1] - W[0])
    weight[~seen] = 0
    return weight.astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = MAX_TRAIN_PER_CLASS) -> tuple[np.ndarray, float]:
    rows = map_batches(labelled(docs, labels, label, per_class), _bags, "ord long, label int, ids binary, counts binary").collect()
    bags = []
    for r in sorted(rows, key=lambda r: (r.ord, r.ids)):
        counts = np.frombuffer(r.counts, np.int32)
        bags.append((r.label, np.frombuffer(r.ids, np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    return train(bags)


def classify(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 from 0.5 on).

    Null and empty texts have no features and get the bias alone. Columns of ``docs`` named score or predicted are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        for batch, texts in text_chunks(batches, text, FEATURE_BYTES):
            ids, owner = features(texts)
            n = np.bincount(owner, minlength=len(texts))
            z = np.bincount(owner, weights=weight[ids], minlength=len(texts)) / np.maximum(n, 1) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return map_batches(docs, scored, with_columns(docs, score="double", predicted="integer"))
