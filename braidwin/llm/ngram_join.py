"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact comparison of the shingle sets verifies them.

1. Every text becomes the set of its word 5-shingles (fewer words: one shingle of all). Texts of equal sets are copies: one
   entry stands for them all, however many there are.
2. Each of TREES trees gives a set a label of LONGEST MinHash values. A tree is a trie of the labels: a node of depth d is
   all sets whose labels begin with the same d values. No prefix need be shorter than ``depth``: the greatest whose
   ``1 - (1 - threshold**depth)**trees`` reaches the target recall.
3. A node of that depth with at most NODE_BLOCK sets is a leaf. A more crowded one is descended, a value at a time, until its
   part holds no more. That makes a set's matched prefixes longer and its recall lower, so they are shortened again, set by
   set, until ``1 - product(1 - threshold**d)`` over the depths of its leaves in all trees reaches the target. A node that one
   set is shortened to is the leaf of all sets below it. So what shares a few values in some trees is told apart there, and
   what is alike in all trees is looked at under short prefixes, however crowded.
4. Under each leaf, sets whose signatures agree in far fewer places than the threshold lets expect are no candidates; the
   others are joined to families (connected components, whose edges are few: a member and the first of its group).
5. In a family all pairs are compared exactly, in tasks of two blocks of a bounded number of shingles each. What is kept
   is one row for each member and task: how many documents it is linked to there, and one it is linked with. So a family
   of any size is spread over many tasks, and no pair of it is ever a row.

Leaves that stay crowded are likewise compared block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwin.llm.common import grouped, map_batches, mix, shuffle_partitions, shuffled, text_chunks, text_key, with_columns, word_hashes, written
from braidwin.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, LONGEST, RECALL = 16, 8, 0.999
#: Standard deviations below the threshold at which a signature still makes a candidate.
SLACK = 4.5
#: Sets under a leaf, and shingles and sets of a family, that are looked at together at most (twice as many: a pair of blocks).
NODE_BLOCK, FAMILY_SHINGLES, FAMILY_BLOCK = 512, 400_000, 256
_SALTS = 8
#: Bytes of a MinHash value.
_WIDTH = 2


def depth(threshold: float, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix at which the trees find a pair of just the threshold with the target recall."""
    for k in range(longest, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles; empty without words."""
    words, cuts = word_hashes(texts)
    runs = words[: max(0, len(words) - shingle + 1)].copy()
    for j in range(1, shingle):
        runs = mix(runs * np.uint64(3) + words[j : j + len(runs)])
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        elif b > a:
            one = words[a : a + 1].copy()
            for j in range(a + 1, b):
                one = mix(one * np.uint64(5) + words[j : j + 1])
            out.append(one)
        else:
            out.append(words[:0])
    return out


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each, of a set that is not empty."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[i : i + 4096, None] * factors).min(axis=0))
    return (mix(low) >> np.uint64(48)).astype("<u2")


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class Links:
    """Union-find over the members of a group."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(self.root[np.append(others, i)])
        self.root[np.isin(self.root, roots)] = roots[0]


def _blocks(group: Column, n: Column, key: Column) -> Column:
    """For a row with ``key`` in one of ``n`` blocks of its group, (group, block, a, b) for each pair of blocks it takes part in."""
    own = F.pmod(F.xxhash64(key), n).cast("int")
    pair = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda j: F.struct(F.xxhash64(group, F.least(own, j), F.greatest(own, j)).alias("g"), own.alias("block"), (own != j).alias("two")))
    return F.explode(pair)


def _sets(docs: DataFrame, text: str, trees: int) -> DataFrame:
    """(doc_id, key, set, n, sig) of every document; set is null without words."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(trees * LONGEST)
        for batch, texts in text_chunks(batches, text):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("key"), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s, factors).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], names=["doc_id", "key", "set", "n", "sig"])

    rows = docs.select("doc_id", text_key(text).alias("key"), text)
    return map_batches(rows, found, with_columns(rows.select("doc_id", "key"), set="binary", n="bigint", sig="binary"))


def _node(tree: Column, d: Column) -> Column:
    """The node of a tree that has the first ``d`` values of a set's label."""
    return F.xxhash64(tree, F.col("sig").substr(tree * F.lit(_WIDTH * LONGEST) + 1, d * F.lit(_WIDTH)))


def _salted(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def _leaves(sets: DataFrame, trees: int, k: int, threshold: float, recall: float) -> DataFrame:
    """(set, node, size): the leaf of each set in each tree, where it isn't the only one there."""
    salt = F.pmod(F.xxhash64("set"), F.lit(_SALTS)).cast("int").alias("salt")
    nodes = sets.select("set", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _node(t, F.lit(k)))).alias("tree", "node"))
    shared = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    under = written(nodes.select("*", salt).join(_salted(shared), ["node", "salt"]).select("set", "tree", "node", "size"), "nodes")
    few, many = under.where(F.col("size") <= NODE_BLOCK).select("set", "node", "size"), under.where(F.col("size") > NODE_BLOCK)
    if not many.limit(1).count():
        return few
    # The way from each crowded node to the end of the label, with the sets of each node on it.
    ways = many.select("set", "tree").join(sets.select("set", "sig"), "set")
    ways = ways.select("set", "tree", salt, F.posexplode(F.transform(F.sequence(F.lit(k), F.lit(LONGEST)), lambda d: _node(F.col("tree"), d))).alias("depth", "node"))
    ways = ways.withColumn("depth", F.col("depth") + k)
    ways = written(ways.join(shuffled(_salted(ways.groupBy("node").agg(F.count("*").alias("size")))), ["node", "salt"]), "ways")
    # How deep each set would go in each tree, and the greatest depth that its recall allows for all of them.
    deep = ways.groupBy("set", "tree").agg(F.coalesce(F.min(F.when(F.col("size") <= NODE_BLOCK, F.col("depth"))), F.lit(LONGEST)).alias("deep"))
    deep = deep.groupBy("set").agg(F.collect_list(F.struct("tree", "deep")).alias("deep"))

    def missed(most: int) -> Column:
        part = F.aggregate("deep", F.lit(1.0), lambda p, x: p * (1 - F.pow(F.lit(threshold), F.least(x["deep"], F.lit(most)))))
        return part * F.pow(F.lit(1 - threshold**k), trees - F.size("deep"))

    most = F.lit(k)
    for d in range(k + 1, LONGEST + 1):
        most = F.when(missed(d) <= 1 - recall, F.lit(d)).otherwise(most)
    deep = deep.select("set", most.alias("most"), F.explode("deep").alias("x"))
    deep = deep.select("set", F.col("x.tree").alias("tree"), F.least("x.deep", "most").alias("depth"))
    cut = written(ways.join(shuffled(deep), ["set", "tree", "depth"]).select("node").distinct(), "cut")
    # A leaf is the first node on the way that any set is cut at.
    ends = ways.join(shuffled(_salted(cut)), ["node", "salt"]).groupBy("set", "tree").agg(F.min(F.struct("depth", "node", "size")).alias("leaf"))
    return few.union(ends.select("set", "leaf.node", "leaf.size").where("size > 1"))


def _candidates(sets: DataFrame, trees: int, k: int, threshold: float, recall: float) -> DataFrame:
    """(a, b): edges that join the sets of each family."""
    leaves = _leaves(sets, trees, k, threshold, recall)
    under = leaves.select("set", _blocks(F.col("node"), F.ceil(F.col("size") / NODE_BLOCK), F.col("set")).alias("p")).select("set", "p.*")
    # One byte of each value is enough to tell how alike two signatures are.
    dealt = under.join(sets.select("set", "sig"), "set")
    values = trees * LONGEST
    least = values * threshold - SLACK * (values * threshold * (1 - threshold)) ** 0.5
    parts = 4 * shuffle_partitions(sets.sparkSession)

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in grouped(batches, "g"):
            m = group.num_rows
            if m < 2:
                continue
            keys = group.column("set").to_pylist()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(m, -1).astype(np.uint8)
            links = Links(m)
            for i in range(m - 1):
                near = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= least)
                if len(near):
                    links.join(i, near + i + 1)
            other = np.flatnonzero(links.root != np.arange(m))
            a += [keys[i] for i in other.tolist()]
            b += [keys[i] for i in links.root[other].tolist()]
            if len(a) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return map_batches(dealt.select("g", "set", "sig").repartition(parts, "g").sortWithinPartitions("g", "set"), families, "a binary, b binary")


def compare(sets: list[np.ndarray], block: np.ndarray, two: bool, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set the weight of those that are alike, and the least of those it hangs together with.

    ``two``: only pairs of different blocks are compared (those of one block are, in the task for that block alone).
    """
    m = len(sets)
    every = np.concatenate(sets)
    ids = np.unique(every, return_inverse=True)[1]
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sizes, mark = np.diff(cuts), np.zeros(len(ids), np.int32)
    links, total = Links(m), np.zeros(m, np.int64)
    for i in range(m - 1):
        own = ids[cuts[i] : cuts[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids[cuts[i + 1] :]], cuts[i + 1 : -1] - cuts[i + 1])
        mark[own] = 0
        alike = shared >= threshold * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9
        if two:
            alike &= block[i + 1 :] != block[i]
        near = np.flatnonzero(alike) + i + 1
        if len(near):
            total[i] += weight[near].sum()
            total[near] += weight[i]
            links.join(i, near)
    return total, links.root


def _verified(docs: DataFrame, text: str, sets: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(set, links, peer): for each set of a family and each task that it was compared in, the documents linked to it and a set it hangs together with."""
    roots = written(components(edges), "families")
    members = roots.select(F.col("node").alias("set"), "root").union(roots.select(F.col("root").alias("set"), "root").distinct())
    known = members.join(sets.select("set", "n", "copies", "rep"), "set")
    size = known.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n") / FAMILY_SHINGLES)).alias("blocks"))
    known = known.join(size, "root").select("set", "copies", "root", "blocks", F.col("rep.doc_id").alias("_d"), F.col("rep.key").alias("_k"))
    known = written(known, "members")
    rows = docs.select("doc_id", text_key(text).alias("key"), F.col(text).alias("text"))
    rows = rows.join(shuffled(known), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("set", "copies", "root", "blocks", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            hashes = pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("set", "copies", "root", "blocks")), hashes], names=["set", "copies", "root", "blocks", "hashes"])

    dealt = map_batches(rows, shingled, "set binary, copies long, root binary, blocks long, hashes binary")
    dealt = dealt.select("set", "copies", "hashes", _blocks(F.col("root"), F.col("blocks"), F.col("set")).alias("p")).select("set", "copies", "hashes", "p.*")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "g"):
            keys = group.column("set").to_pylist()
            once = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]  # rows that are alike in doc_id and text
            group, keys = group.take(once), [keys[i] for i in once]
            hashes = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
            total, root = compare(hashes, group.column("block").to_numpy(), group.column("two")[0].as_py(), group.column("copies").to_numpy(), threshold)
            yield pa.RecordBatch.from_pydict({"set": pa.array(keys, pa.binary()), "links": pa.array(total), "peer": pa.array([keys[r] for r in root.tolist()], pa.binary())})

    parts = 4 * shuffle_partitions(docs.sparkSession)
    return map_batches(dealt.repartition(parts, "g").sortWithinPartitions("g", "set"), compared, "set binary, links long, peer binary")


def similar(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, copy_id, n_copies, class_id, n_links) for every row of ``docs``.

    A link is a pair of documents whose shingle sets have a Jaccard similarity of ``threshold`` or more, copies included.
    copy_id: the least doc_id of the documents of the same set, n_copies their number; class_id: the least doc_id of those
    connected by links; n_links: the other documents that this one is linked to. A text without words (null, empty) has no set:
    it is alone in its class, with no links. Equal rows count each.
    """
    k = depth(threshold, trees, recall=recall)
    every = written(_sets(docs, text, trees), "sets")
    sets = every.where("set is not null").groupBy("set").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "key")).alias("rep"), F.min("doc_id").alias("copy_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = written(sets, "distinct")
    found = written(_verified(docs, text, sets, _candidates(sets, trees, k, threshold, recall), threshold), "links")
    classes = components(found.where("set != peer").select(F.col("set").alias("a"), F.col("peer").alias("b")))
    links = found.groupBy("set").agg(F.sum("links").alias("links")).where("links > 0")
    known = sets.select("set", "copies", "copy_id").join(links, "set", "left").where("copies > 1 or links > 0")
    known = known.join(classes.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = known.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    known = written(known.join(least, "root").drop("root"), "classes")
    # One set may be that of a third of all documents: its one row here is repeated for each salt that they are split by.
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).withColumnRenamed("set", "_set")
    rows = every.select("doc_id", "key", "set").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(_SALTS)).cast("int"))
    rows = rows.join(shuffled(salted), (F.col("set") == F.col("_set")) & (F.col("_salt") == F.col("salt")), "left")
    return rows.select(
        "doc_id", "key", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"), F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0).cast("long")) + F.coalesce("copies", F.lit(1).cast("long")) - 1).alias("n_links"))


def first_of_each(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: that of the least doc_id (of rows alike in it: that of the least text hash, once).

    Rows without a doc_id are kept.
    """
    drop = similar(docs, text, threshold)
    multi = written(drop.where("n_links > 0"), "multi")
    # The row that stays for each class, combined before the shuffle.
    stays = multi.where("doc_id is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("stay"))
    gone = multi.where("doc_id is not null").join(stays, "class_id").where((F.col("doc_id") != F.col("stay.doc_id")) | (F.col("key") != F.col("stay.key")))
    gone = written(gone.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct(), "gone")
    kept = docs.withColumn("_key", text_key(text)).join(shuffled(gone), (F.col("doc_id") == F.col("_d")) & (F.col("_key") == F.col("_k")), "left_anti").drop("_key")
    again = multi.groupBy("doc_id", "key").count().where("count > 1 and doc_id is not null")
    if again.limit(1).count():  # rows repeated as a whole
        twice = shuffled(written(again.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")), "again"))
        on = (F.col("doc_id") == F.col("_d")) & (F.col("_key") == F.col("_k"))
        kept = kept.withColumn("_key", text_key(text))
        kept = kept.join(twice, on, "left_anti").unionByName(kept.join(twice, on, "left_semi").dropDuplicates(["doc_id", "_key"])).drop("_key")
    return kept
