"""The queries of this subpackage: thin digests of each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwin.llm import decontaminate, fingerprints, ngram_join, packing, quality, secret_scan, suffix_dedup, token_counts, toxicity, url_filter
from braidwin.llm.common import held_out, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_factors")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprints.as_text("sketch").alias("fingerprint"), fingerprints.as_text("edited_sketch").alias("edited_fingerprint"),
        fingerprints.likeness("sketch", "edited_sketch").alias("near_edited"), fingerprints.likeness("sketch", "next_sketch").alias("near_next"), fingerprints.containment("sketch", "edited_sketch").alias("kept_part"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    kinds = F.transform("base", lambda x: x["kind"])
    n = [F.size(F.array_compact(F.transform(kinds, lambda x: F.when(x == F.lit(i), x)))).cast("long").alias(f"n_{k[0]}") for i, k in enumerate(secret_scan.KINDS)]  # noqa: B023
    return found.select("doc_id", *n, F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.concat("base", "extra")).alias("spans"), "n_live", "n_example")


#: (verdict, host, path)
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "aliases")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_sha256().alias("items_sha256"), "contaminated", "longest_match", "longest_start", "longest_item")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op4: the edited texts."""
    rows = fingerprints.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op5: the spans of the named patterns."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op6: hosts, paths and rules."""
    return op6_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL states of op9 in short: all but the longest matches."""
    return op9_benchmark_decontamination(spark, sf_dir).drop("longest_match", "longest_start", "longest_item")


_LEAST = {name: least for name, _, _, least, _ in secret_scan.KINDS}
#: The patterns as the task states them.
_PATTERNS = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def _secret_sql() -> str:
    kinds = []
    for k, (name, pattern) in enumerate(_PATTERNS.items()):
        p = pattern.replace("'", "''")
        kinds.append(f"SELECT row, {k} AS kind, '{name}' AS name, {_LEAST[name]} AS least, regexp_extract_all(t, '{p}', 0) AS w, regexp_extract_all(t, '{p}', {2 if name == 'assign' else 0}) AS v, regexp_split_to_array(t, '{p}') AS g FROM d")
    counts = ", ".join(f"COALESCE(COUNT(*) FILTER (name = '{name}'), 0) AS n_{name}" for name in _PATTERNS)
    return f"""WITH d AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, COALESCE(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(kinds)}),
e AS (SELECT row, kind, name, least, UNNEST(w) AS w, UNNEST(v) AS v, UNNEST(g[1:len(w)]) AS g, UNNEST(range(len(w))) AS i FROM m WHERE len(w) > 0),
p AS (SELECT *, CAST(SUM(length(g) + length(w)) OVER (PARTITION BY row, kind ORDER BY i) AS BIGINT) AS stop FROM e),
x AS (SELECT row, {counts}, string_agg(name || ':' || (stop - length(w)) || ':' || stop, ',' ORDER BY stop - length(w), kind) AS spans FROM p WHERE length(v) >= least GROUP BY row)
SELECT doc_id, {', '.join(f'COALESCE(n_{n}, 0) AS n_{n}' for n in _PATTERNS)}, sha256(COALESCE(spans, '')) AS base_sha256 FROM d LEFT JOIN x USING (row)"""


def _url_sql() -> str:
    fits = [f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}' END" for _, h, p in sorted(URL_RULES, key=lambda x: -len(x[1] + x[2]))]
    ascii_ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {ascii_}) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u)
SELECT page_id, host, path, COALESCE({', '.join(fits)}) AS rule FROM h"""


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "edited_texts": """WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, COALESCE(LEAD(t) OVER (ORDER BY doc_id DESC), FIRST_VALUE(t) OVER (ORDER BY doc_id DESC)) AS after FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 3) || substring(after, 1, length(t) // 3)) AS edited_sha256 FROM n""",
    "secret_base_spans": _secret_sql(),
    "url_rules": _url_sql(),
    "benchmark_hits": f"""WITH d AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, COALESCE({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item, LEAST(13, len(w)) AS size, UNNEST(range(GREATEST(len(w) - 12, 1))) AS place, w FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item, size, array_to_string(w[place + 1:place + size], ' ') AS run FROM i),
s AS (SELECT DISTINCT size FROM k),
p AS (SELECT row, size, UNNEST(range(len(w) - size + 1)) AS place, w FROM d, s WHERE len(w) >= size),
h AS (SELECT p.row, p.size, p.place, k.item FROM (SELECT row, size, place, array_to_string(w[place + 1:place + size], ' ') AS run FROM p) p JOIN k USING (size, run)),
c AS (SELECT row, COUNT(DISTINCT word) AS n_hit FROM (SELECT row, UNNEST(range(place, place + size)) AS word FROM h) GROUP BY row),
t AS (SELECT row, COUNT(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY row)
SELECT doc_id, len(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if callable(f) and (name.startswith("op") or name in SQL)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
