"""Secret scans: patterns find candidates, their ownership over the whole corpus tells examples from live credentials.

DataFrame functions only. ``split`` by a pattern gives the gaps between its matches and ``regexp_extract_all`` the matches;
the lengths of both, added up, are the matches' places. Candidates are hashed and counted by distinct owners and distinct
repositories: a value that many owners have, or that some owners have in many repositories, is an example that was copied
around; one that few have, or one owner alone in however many repositories, looks live. Named patterns are always reported;
values that only look like keys (long, with letters and digits) are reported where they look live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwin.llm.common import shuffled, text_key, text_of, written

#: kind, pattern, group of the value, least characters of the value, a test that is cheaper than the pattern's matches
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    # A run of 16 or more is the same match as a whole run that has 16 or more.
    ("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
)
GENERIC = "generic"
#: A value is a widely copied example from so many distinct owners on, or with more than one owner from so many repositories on.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
_SALTS = 8
#: Values of an array that are folded together.
_BLOCK = 128
_SPAN = "struct<start:bigint,kind:int,end:bigint,secret:bigint>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = _BLOCK) -> Column:
    """The running total of an array of longs from 0 on, by an associative ``combine``.

    A fold copies what it has so far, so it is made for blocks of the array, and for the blocks' totals.
    """
    none = F.expr("cast(array() as array<bigint>)")

    def fold(some: Column) -> Column:
        return F.aggregate(some, none, lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(combine(F.element_at(acc, -1), x))))

    def joined_blocks(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), fold(F.transform(blocks, lambda x: F.element_at(x, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda x, at: F.transform(x, lambda v: combine(at, v))))

    def by_blocks(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / block).cast("int"))
        blocks = F.transform(starts, lambda i: fold(F.slice(whole, i * block + 1, F.lit(block))))
        return F.when(F.size(whole) == 0, none).otherwise(once(blocks, joined_blocks))

    return once(values, by_blocks)


def _found(text: Column, n: int, kind: tuple) -> Column:
    """Spans of one kind: start and end in code points, hash of the value."""
    _, pattern, group, least, test = kind
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("w"), value.alias("v")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["w"]).alias("size"), m["v"].alias("value")))

    def spans(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: (x["gap"] + x["size"]).cast("long")), lambda a, x: a + x)
        each = F.filter(F.zip_with(parts, ends, lambda x, end: F.struct(x.alias("x"), end.alias("end"))), lambda y: F.length(y["x"]["value"]) >= least)
        return F.transform(each, lambda y: F.struct((y["end"] - y["x"]["size"]).alias("start"), F.lit(n).alias("kind"), y["end"].alias("end"), F.xxhash64(y["x"]["value"]).alias("secret")))

    return F.when(text.rlike(test), once(parts, spans)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _generic(text: Column, base: Column) -> Column:
    """Generic candidates that have a letter and a digit and touch no base span."""
    # Only the start of a run is looked at: if the whole has no digit, no part of it has, however long it is.
    start = r"(?<![A-Za-z0-9_-])"
    pattern = start + r"(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+"
    found = _found(text, len(KINDS), (GENERIC, pattern, 0, 20, start + r"(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20}"))
    return F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def joined(spans: Column) -> Column:
    """kind:start:end, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(GENERIC))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "lang") -> DataFrame:
    """(doc_id, key, owner, repository, base, generic): the spans in every document, written to the shared folder."""
    t = text_of("_text")
    cols = [F.col("doc_id"), text_key(text).alias("key"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text_of(text).alias("_text")]
    base = docs.select(cols).withColumn("base", F.array_sort(F.concat(*[_found(t, n, k) for n, k in enumerate(KINDS)])))
    return written(base.withColumn("generic", _generic(t, F.col("base"))).drop("_text"), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(secret, n_owners, n_repositories) of every candidate value.

    Counted in two steps that each combine before they shuffle, so a value in a third of all documents is a few rows a
    task. Repositories of one name and two owners are two. A null owner counts as one owner, a null repository as one of its
    owner's.
    """
    each = found.select(F.explode(F.concat("base", "generic")).alias("s"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    by_owner = each.groupBy(F.col("s.secret").alias("secret"), "owner", "repository").agg(F.count("*").alias("n")).groupBy("secret", "owner").agg(F.count("*").alias("r"))
    return by_owner.groupBy("secret").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "lang", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(doc_id, key, base, extra, n_live, n_example) for every row of ``docs``.

    base: the spans of the named patterns. extra: the generic candidates that look live. n_live, n_example: base spans whose
    value looks live, or is an example: ``example_owners`` owners have it, or two or more have it in ``example_repositories``
    repositories. A null or empty text has no spans; rows that are alike in doc_id and text are judged alike and each stays.
    """
    found = candidates(docs, text, owner, repository)
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= example_repositories))
    least = ownership(found).where(copied).select("secret", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"), F.lit(True).alias("example"))
    # An example's rows may be a third of all: its one row here is repeated for each salt that they are split by.
    each = found.where(F.size("base") + F.size("generic") > 0).select("doc_id", "key", F.explode(F.concat("base", "generic")).alias("s")).distinct()
    each = each.withColumns({"secret": F.col("s.secret"), "salt": F.pmod(F.xxhash64("doc_id", "key", "s.start"), F.lit(_SALTS)).cast("int")}).join(least, ["secret", "salt"], "left")
    is_base = F.col("s.kind") < len(KINDS)
    live = F.col("example").isNull()
    judged = each.groupBy("doc_id", "key").agg(
        F.collect_list(F.when(~is_base & live, F.col("s"))).alias("extra"), F.count_if(is_base & live).alias("n_live"), F.count_if(is_base & ~live).alias("n_example"))
    judged = judged.withColumns({"_d": F.col("doc_id"), "_k": F.col("key")}).drop("doc_id", "key")
    out = found.join(judged, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return out.select("doc_id", "key", "base", F.coalesce("extra", F.expr(f"cast(array() as array<{_SPAN}>)")).alias("extra"), F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"), F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"))


def redacted(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """The text with every span replaced by ``mark``, touching or overlapping ones by one."""

    def pieces(x: Column) -> Column:
        """``x``: the sorted spans, the greatest end up to each of them, and the text with four bytes a code point."""
        spans, ends, data = x["spans"], x["ends"], x["data"]
        first = lambda i: (i == 0) | (F.get(spans, i)["start"] > F.get(ends, i - 1))
        last = lambda i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > F.get(ends, i))
        begins = F.transform(F.filter(spans, lambda _, i: first(i)), lambda s: s["start"])
        gaps = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.filter(ends, lambda _, i: last(i))), F.concat(begins, F.array(F.octet_length(data).cast("long"))), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
        # Cut as bytes, which takes the time of what is cut, and joined as characters of one byte each.
        each = F.transform(gaps, lambda g: F.decode(F.substring(data, (g["lo"] * 4 + 1).cast("int"), F.greatest(F.lit(0), F.least(g["hi"], F.lit(1 << 28)) - g["lo"]).cast("int") * 4), "ISO-8859-1"))
        between = mark.encode("utf-32-be").decode("latin-1")
        # The byte order mark in front is the decoder's; one that the text begins with stays.
        return F.decode(F.encode(F.concat(F.lit("\x00\x00\u00fe\u00ff"), F.array_join(each, between)), "ISO-8859-1"), "UTF-32")

    def merged(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return once(F.struct(spans.alias("spans"), ends.alias("ends"), F.encode(text, "UTF-32").alias("data")), pieces)

    return F.when(F.size(spans) == 0, text).otherwise(once(F.array_sort(spans), merged))


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "lang") -> DataFrame:
    """``docs`` with its secrets, base and extra spans, replaced in the text; n_chars, if there, counts the new text.

    Texts are shuffled once, to meet their spans, however few these are. Null texts stay null.
    """
    spans = scan(docs, text, owner, repository).select("doc_id", "key", F.concat("base", "extra").alias("_spans")).where(F.size("_spans") > 0).distinct()
    spans = written(spans.withColumns({"_d": F.col("doc_id"), "_k": F.col("key")}).drop("doc_id", "key"), "spans")
    rows = docs.withColumn("_key", text_key(text)).join(shuffled(spans), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    rows = rows.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col("_spans"))))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return rows.select(docs.columns)
