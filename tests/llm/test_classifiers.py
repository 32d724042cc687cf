import re
import zlib

import numpy as np
import pytest
from conftest_llm import docs_frame

from braidwin.llm import quality, queries, toxicity
from braidwin.llm.common import held_out, span_hashes, table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = module.classify(docs, module.fit(docs, labels)).join(labels, "doc_id").where(held_out()).toPandas()
    assert auc(scored["score"].to_numpy(), scored[label].to_numpy()) > least
    assert scored["score"].between(0, 1).all()


def test_labels_of_held_out_rows_are_not_used(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = docs_frame(spark, [(i, f"text {i}") for i in range(60)])
    taken = {r.ord for r in quality.labelled(docs, labels, "quality", 100).collect()}
    from pyspark.sql import functions as F

    free = {r.ord for r in labels.where(~held_out()).select(F.xxhash64("doc_id").alias("ord")).collect()}
    assert taken == free and len(quality.labelled(docs, labels, "quality", 5).collect()) == 10
    # "text 7" has 6 bytes, "text 12" 7: nothing over a hundredth of the bytes, and no more than these together.
    assert {len(r.text) for r in quality.labelled(docs, labels, "quality", 100, 600).collect()} == {6}
    assert sum(len(r.text) for r in quality.labelled(docs_frame(spark, [(i, "x") for i in range(60)] * 40), labels, "quality", 100, 4000).collect()) <= 8000


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_empty_tables(spark, odd, module, label):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (5, None), (None, 1), (7, 0)], f"doc_id long, {label} int")
    scored = module.classify(odd, module.fit(odd, labels))
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    none = module.fit(odd, labels.limit(0))
    assert len({r.score for r in module.classify(odd, none).collect()}) == 1
    assert module.classify(odd.limit(0), none).count() == 0
    assert scored.columns.count("score") == 1


def test_an_interaction_that_no_sum_of_weights_has():
    """Toxic if exactly both terms meet: each alone is as frequent among the others."""
    rng = np.random.default_rng(0)
    a, b, bags = np.uint64(11), np.uint64(22), []
    for _ in range(1200):
        y = int(rng.random() < 0.5)
        own = [a, b] if y else [[a], [b]][int(rng.integers(2))]
        bags.append((y, np.unique(np.array([*own, *rng.integers(100, 130, 5)], np.uint64))))
    model = toxicity.train(bags)
    z = model.margins(np.array([a, b, a, b], np.uint64), np.array([0, 0, 1, 2]), 3)
    assert z[0] > max(z[1], z[2]) + 1


def test_features_do_not_depend_on_the_neighbours():
    texts = [b"some words here", b"", b"more words here and there", "é ß".encode()]
    whole, of = quality.features(texts)
    for i, t in enumerate(texts):
        alone, _ = quality.features([t])
        assert sorted(whole[of == i].tolist()) == sorted(alone.tolist())


def plain_logistic(z):
    return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def test_quality_scores_by_a_plain_sum(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    weight, bias = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in queries.op1_quality_classifier(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        ids = quality.features([text])[0].tolist()
        score = plain_logistic(sum(float(weight[i]) for i in ids) / max(1, len(ids)) + bias)
        assert abs(rows[doc].score - score) < 1e-6 and rows[doc].predicted == (rows[doc].score >= 0.5)
        assert rows[doc].held_out == (zlib.crc32(str(doc).encode()) % 3 == 1)


def test_toxicity_scores_by_all_pairs_of_terms(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = toxicity.fit(docs, labels)
    at = {int(h): i for i, h in enumerate(model.terms)}
    rows = {r.doc_id: r for r in queries.op8_toxicity(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode())))
        hashed = {hash_of(w) for w in words} | {int(toxicity.mix(np.array([hash_of(w[:n]) + n], np.uint64))[0]) for w in words for n in toxicity.STEMS if len(w) > n}
        known = sorted(at[h] for h in hashed if h in at)
        z = model.b + sum(float(model.w[i]) for i in known)
        z += sum(float(model.v[i] @ model.v[j]) for n, i in enumerate(known) for j in known[:n])
        assert abs(rows[r.doc_id].score - plain_logistic(z)) < 1e-6 and rows[r.doc_id].predicted == (rows[r.doc_id].score >= 0.7)


def hash_of(word):
    return int(span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])
