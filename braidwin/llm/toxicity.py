"""Toxicity: a second-order factorization machine over hashed terms.

A text is the set of its words (as in ``common.word_spans``) and of the first 5, 6 and 7 bytes of longer words (a stem
tells of forms that no learned text has), each a 64-bit hash. The score is the logistic function of
``b + sum(w_i) + 1/2 * sum_f((sum v_if)**2 - sum v_if**2)`` over the terms that the model knows: the weights ``w`` rate
single terms, the products of the factors ``v`` rate pairs that only together are toxic (an insult beside the mention of
a group), which no additive weight can. Trained in numpy: the weights by follow-the-regularised-leader steps, whose L1 pull
keeps the weight of a term at exactly 0 until its evidence exceeds L1, the factors by Adagrad for the terms that are not
at 0. Only those terms are in the model, so the thousands of neutral words of a long text add up to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from braidwin.llm.common import map_batches, mix, span_hashes, text_chunks, with_columns, word_spans
from braidwin.llm.quality import labelled

FACTORS = 6
STEMS = (5, 6, 7)
#: Terms that fewer of the learned texts have are not looked at.
MIN_DOCS = 4
EPOCHS, RATE, L1, L2 = 10, 5.0, 30.0, 1.0
FACTOR_RATE, FACTOR_DECAY = 0.02, 1e-3
#: At most so many labelled rows of each class are learned from, the first in the order of a hash of doc_id.
MAX_TRAIN_PER_CLASS = 3000
THRESHOLD = 0.7


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts, and the number of the text that each belongs to."""
    buf, starts, ends, cuts = word_spans(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(cuts))
    h, owner = [span_hashes(buf, starts, ends)], [of]
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        h.append(mix(span_hashes(buf, starts[long], starts[long] + size) + np.uint64(size)))
        owner.append(of[long])
    return np.concatenate(h), np.concatenate(owner)


def _term_sets(texts: list[bytes]) -> list[np.ndarray]:
    h, of = term_hashes(texts)
    by_text = np.split(h[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(texts)))[:-1])
    return [np.unique(x) for x in by_text]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("label"), pa.array([x.tobytes() for x in _term_sets(texts)], pa.binary())], names=["ord", "label", "terms"])


class Model:
    """terms: sorted hashes; w, v: a row for each term; b: the bias."""

    def __init__(self, terms: np.ndarray, w: np.ndarray, v: np.ndarray, b: float) -> None:
        self.terms, self.w, self.v, self.b = terms, w, v, b

    def rows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their rows."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == h)
        return known, at[known]

    def margins(self, h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """The score before the logistic function for each of n texts; ``of`` tells which text a term's hash belongs to."""
        known, row = self.rows(h)
        once = np.unique(of[known] * np.int64(len(self.terms) + 1) + row)  # a term counts once a text
        of, row = once // (len(self.terms) + 1), once % (len(self.terms) + 1)
        z = np.bincount(of, weights=self.w[row], minlength=n) + self.b
        for f in range(self.v.shape[1]):
            x = self.v[row, f]
            z += 0.5 * (np.bincount(of, weights=x, minlength=n) ** 2 - np.bincount(of, weights=x * x, minlength=n))
        return z


def train(bags: list[tuple[int, np.ndarray]], seed: int = 11) -> Model:
    """Learn from (label, term hashes)."""
    n = [sum(y == k for y, _ in bags) for k in (0, 1)]
    if not all(n):
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)), 4.0 if n[1] else -4.0)
    terms, docs = np.unique(np.concatenate([h for _, h in bags]), return_counts=True)
    terms = terms[docs >= MIN_DOCS]
    rng = np.random.default_rng(seed)
    w, z, seen = np.zeros(len(terms)), np.zeros(len(terms)), np.zeros(len(terms))
    v, gv = rng.normal(0, 0.01, (len(terms), FACTORS)), np.full((len(terms), FACTORS), 1e-2)
    b, gb = 0.0, 1.0
    known = Model(terms, w, v, b)
    rows = [known.rows(h)[1] for _, h in bags]
    cost = (len(bags) / (2 * n[0]), len(bags) / (2 * n[1]))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            y, r = bags[i][0], rows[i]
            on = r[w[r] != 0]
            s = v[on].sum(axis=0)
            margin = b + w[on].sum() + 0.5 * float((s * s - (v[on] ** 2).sum(axis=0)).sum())
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * min(cost[y], 5.0)
            more = np.sqrt(seen[r] + err * err)
            z[r] += err - (more - np.sqrt(seen[r])) / RATE * w[r]
            seen[r] += err * err
            w[r] = np.where(np.abs(z[r]) <= L1, 0.0, -(z[r] - np.sign(z[r]) * L1) / ((1 + more) / RATE + L2))
            dv = err * (s - v[on]) + FACTOR_DECAY * v[on]
            gv[on] += dv * dv
            v[on] -= FACTOR_RATE * dv / np.sqrt(gv[on])
            gb += err * err
            b -= 0.3 * err / np.sqrt(gb)
    on = w != 0
    return Model(terms[on], w[on], v[on], float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = MAX_TRAIN_PER_CLASS) -> Model:
    rows = map_batches(labelled(docs, labels, label, per_class), _terms, "ord long, label int, terms binary").collect()
    return train([(r.label, np.frombuffer(r.terms, np.uint64)) for r in sorted(rows, key=lambda r: (r.ord, r.terms))])


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 from ``threshold`` on).

    Null and empty texts have no terms and get the bias alone. Columns of ``docs`` named score or predicted are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.terms, model.w, model.v, model.b))
    docs = docs.drop("score", "predicted")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch, texts in text_chunks(batches, text):
            score = 1 / (1 + np.exp(-np.clip(own.margins(*term_hashes(texts), len(texts)), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return map_batches(docs, scored, with_columns(docs, score="double", predicted="integer"))
