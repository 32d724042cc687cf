"""Document fingerprints: threshold-scaled sketches of word shingles.

DataFrame functions only. Every run of SHINGLE words (lower-cased runs of letters and digits; fewer words: one shingle of
all) is hashed to 64 bits, and all hashes below FRACTION of their range are kept. What is kept of a shingle does not depend
on the document, so sketches of any sizes can be compared (shared hashes over one sketch's size estimate containment) and
the sketch of a union is the union of the sketches. A text none of whose hashes is that low keeps its least one; a union
drops it as soon as it has a low one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwin.llm.common import shuffle_partitions, text_key, text_of

SHINGLE = 5
FRACTION = 1 / 2
#: Partitions of an ordering by doc_id, at most: their bounds are part of the plan.
MAX_RANGES = 2000


def _limit(fraction: float) -> int:
    return -(1 << 63) + int(fraction * (1 << 64))


def with_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of a text column: an ascending array of distinct hashes; null and wordless texts have an empty one."""
    w, a, k = f"_w_{out}", f"_a_{out}", f"_k_{out}"
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda x: x != "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    runs = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(F.size(w) - (shingle - 1), F.lit(0))).alias(str(i)) for i in range(shingle)])
    df = df.withColumn(a, F.when(F.size(w) >= shingle, F.transform(runs, lambda x: F.xxhash64(x))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.expr("cast(array() as array<bigint>)")))
    df = df.withColumn(k, F.filter(a, lambda x: x < F.lit(_limit(fraction))))
    return df.withColumn(out, F.when(F.size(k) > 0, F.array_sort(F.array_distinct(k))).when(F.size(a) > 0, F.array(F.array_min(a))).otherwise(F.col(k))).drop(w, a, k)


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), ",")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: str, b: str) -> Column:
    """Estimated part of the shingles of ``a`` that ``b`` has; an empty sketch is contained in all."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def union(*sketches: str, fraction: float = FRACTION) -> Column:
    """The sketch of documents taken together."""
    every = F.array_sort(F.array_distinct(F.flatten(F.array(*sketches))))
    low = F.filter(every, lambda x: x < F.lit(_limit(fraction)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(every, 1, 1))


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: str) -> DataFrame:
    """``docs`` with next_<column>: those of the row of the next lower ``id_col`` (an integer), after the last the first.

    Rows are dealt by ranges of the id, whose bounds are estimated quantiles; each range also gets the first row of the one
    after it. Nulls come last; ties are ordered by ``tie``.
    """
    n = min(shuffle_partitions(docs.sparkSession), MAX_RANGES)
    cuts = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col(id_col))) if cuts else F.lit(0)
    at = F.when(F.col(id_col).isNull(), F.lit(len(cuts))).otherwise(at)
    firsts = sorted((r[0], r[1]) for r in docs.select(F.col(id_col).alias("i"), at.alias("r")).groupBy("r").agg(F.max("i")).collect())
    # A row for each range at most: the range, its first id, and the range before it that has rows.
    rows = [(r, first, firsts[k - 1][0]) for k, (r, first) in enumerate(firsts)]
    own = docs.withColumn("_range", at)
    if rows:
        known = docs.sparkSession.createDataFrame(rows, "_r int, _first long, _before int")
        own = own.join(F.broadcast(known), (F.col("_range") == F.col("_r")) & F.col(id_col).eqNullSafe(F.col("_first")), "left").drop("_r", "_first")
    else:
        own = own.withColumn("_before", F.lit(None).cast("int"))
    dealt = own.withColumn("_to", F.explode(F.array_compact(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost")), F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("r"), F.lit(True).alias("ghost")))))))
    dealt = dealt.withColumns({"_range": F.col("_to.r"), "_ghost": F.col("_to.ghost")}).drop("_to", "_before")
    order = Window.partitionBy("_range").orderBy("_ghost", F.col(id_col).desc_nulls_last(), F.col(tie).desc())
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("_ghost")).drop("_range", "_ghost")


def edited_pairs(docs: DataFrame, text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, next_sketch) for every row of ``docs``.

    edited: the text (null: empty), its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    document's, in descending order of doc_id; after the last comes the first. Rows of equal doc_id are ordered by a hash of
    the text.
    """
    rows = docs.select("doc_id", text_of(text).alias("t")).withColumn("key", text_key("t"))
    # The next sketch is made again from its text, as sketches of random hashes are as long as the text and don't compress.
    rows = with_sketch(with_sketch(with_next(rows, "doc_id", ["t"], "key"), "t", "sketch", fraction), "next_t", "next_sketch", fraction)
    rows = rows.withColumn("n_chars", F.length("t").cast("long")).withColumn("k", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("t", F.lit(1), (F.col("n_chars") - F.col("k")).cast("int")), F.substring("next_t", F.lit(1), F.col("k"))))
    return with_sketch(rows.select("doc_id", "n_chars", "edited", "sketch", "next_sketch"), "edited", "edited_sketch", fraction)
