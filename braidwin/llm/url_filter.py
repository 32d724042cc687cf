"""URL filters with redirect equivalence: the decisions on blocked URLs hold for their aliases.

DataFrame functions only. A page's own rule decides: the longest of those that fit its host, or a domain above it, and the
start of its path. Pages without a rule take part in the connected components of the redirect and canonical-link edges: a
component with an explicitly allowed URL is allowed, else one with a blocked URL is blocked, else the page is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from html import unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwin.llm.common import shuffled, written
from braidwin.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules stand in the plan itself; more are joined.
INLINE_RULES = 200
_SALTS = 8
# A tag up to its end, ">" in quotes included. All runs are possessive: a page is read once, however broken its tags are.
_TAG = r"""(?is)<%s(?=[\s/])(?:[^>"']|"[^"]*+"|'[^']*+'|["'])*+"""
_ATTRIBUTE = r"""(?s)(?<![^\s"'<>/=])([^\s"'<>/=]++)\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>][^\s>]*+))"""
#: What follows the seconds of a refresh; without seconds only after ``url=``.
_REFRESH = r"""(?is)^\s*+(?:[0-9.]*+[\s;,]*+url\s*+=\s*+|[0-9.]++[\s;,]++(?!url\s*+=))(?:"([^"]*+)|'([^']*+)|(\S.*+))"""
# In an attribute a name without semicolon is no entity before "=", a letter or a digit: "?a=1&copy=2" is meant as it stands.
_ENTITY = r"&(?:#[xX][0-9a-fA-F]++;?|#[0-9]++;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))"
#: The named entities, and the numbers that stand for other characters than their own.
_ENTITIES = {**html5, **{f"#{n}": unescape(f"&#{n};") for n in range(128, 160)}}


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _plain(path: Column) -> Column:
    """A path without dot segments; the empty one is ``/``."""
    parts = F.split(path, "/", -1)
    here, up = (lambda x: F.lower(x).isin(".", "%2e")), (lambda x: F.lower(x).isin("..", ".%2e", "%2e.", "%2e%2e"))
    step = lambda acc, x: F.when(up(x), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(here(x), acc).otherwise(F.array_append(acc, x))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.expr("cast(array() as array<string>)"), step)
    end = F.element_at(parts, -1)
    kept = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((here(end) | up(end)) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(path == "", F.lit("/")).when(path.rlike(r"(?i)/(?:\.|%2e)"), kept).otherwise(path)


def node(url: Column) -> Column:
    """What tells URLs apart as ends of an edge: host, path without dot segments and query; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.unhex(F.md5(F.concat(host(url), F.lit(" "), _plain(path(url)), query).cast("binary"))))


def resolved(url: Column, link: Column) -> Column:
    """The absolute URL of a link that stands at ``url``, without dot segments; null for another scheme than ``://``."""
    top, own = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path(url)
    folder = F.regexp_extract(own, r"(?s)^(.*/)", 1)
    absolute = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*+://"), link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*+:"), F.lit(None).cast("string"))
        .when((link == "") | link.startswith("#"), url).when(link.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(top, link)).when(link.startswith("?"), F.concat(top, own, link)).otherwise(F.concat(top, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )
    dots = absolute.rlike(r"(?i)/(?:\.|%2e)")
    return F.when(dots, F.concat(F.regexp_extract(absolute, r"(?s)^(.*?://[^/?#]*)", 1), _plain(path(absolute)), F.regexp_extract(absolute, r"(?s)^.*?://[^?#]*(.*)", 1))).otherwise(absolute)


def _character(entity: Column) -> Column:
    """What an entity stands for; one that is not known stays."""
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _ENTITIES.items())), F.lit("\x01"), F.lit("\x02"))
    digits = F.regexp_extract(entity, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    code = F.when(F.length(digits).between(1, 7), F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    return F.when(entity.startswith("&#"), F.coalesce(F.try_element_at(table, F.concat(F.lit("#"), code.cast("string"))), number)).otherwise(F.coalesce(F.try_element_at(table, F.substring(entity, 2, 64)), entity))


def unescaped(text: Column) -> Column:
    """An attribute's text with its HTML entities decoded."""
    parts = F.zip_with(F.split(text, _ENTITY, -1), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), lambda gap, x: F.concat(gap, F.when(x.isNull(), F.lit("")).otherwise(_character(x))))
    return F.when(F.instr(text, "&") > 0, F.array_join(parts, "")).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's first attribute of that name, null without one."""
    every = [F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2, 3, 4)]
    at = F.array_position(F.transform(every[0], F.lower), name).cast("int") - 1
    return unescaped(F.concat(*[F.get(values, at) for values in every[1:]]))


def _links(html: Column) -> Column:
    """The targets of all canonical links and refreshes as they stand in the page."""
    link, meta = (F.regexp_extract_all(html, F.lit(_TAG % name), F.lit(0)) for name in ("link", "meta"))
    canonical = F.filter(link, lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(meta, lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    content = F.transform(refresh, lambda t: F.coalesce(_attribute(t, "content"), F.lit("")))
    after = F.transform(content, lambda c: F.concat(*[F.regexp_extract(c, _REFRESH, i) for i in (1, 2, 3)]))
    # Not HTML, but met: <meta http-equiv=refresh content=0; url=...>.
    after = F.zip_with(after, refresh, lambda c, t: F.when(c != "", c).otherwise(_attribute(t, "url")))
    return F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), after)


def _suffixes(h: Column) -> Column:
    labels = F.split(h, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]], host_col: str = "host", path_col: str = "path") -> DataFrame:
    """``urls`` with rule (its host and path) and rule_verdict; null where none fits. rules: (verdict, host, path); the longest
    host and path together wins, of equally long ones an allow rule, then the first as a string."""
    spark = urls.sparkSession
    rank = "struct(length(concat(h, p)) as n, verdict = 'allow' as allow, concat(h, p) as rule, verdict, p)"
    if len(rules) <= INLINE_RULES:
        by_host: dict[str, list] = {}
        for verdict, h, p in rules:
            by_host.setdefault(h, []).append((len(h + p), verdict == "allow", h + p, verdict, p))
        parts = []
        for h, own in by_host.items():
            fits = (F.col(host_col) == h) | F.col(host_col).endswith("." + h)
            parts += [F.when(fits & F.col(path_col).startswith(p), F.struct(F.lit(n).alias("n"), F.lit(allow).alias("allow"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for n, allow, rule, verdict, p in own]
        best = F.array_max(F.array_compact(F.array(*parts))) if parts else F.lit(None).cast("struct<rule:string,verdict:string>")
        return urls.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best")
    table = spark.createDataFrame(list(rules), "verdict string, h string, p string").selectExpr("h as _s", rank + " as _r")
    # Decided once for each distinct host and path, of which many rows may have the same.
    keys = urls.select(F.col(host_col).alias("_h"), F.col(path_col).alias("_p")).distinct()
    hits = keys.withColumn("_s", F.explode(_suffixes(F.col("_h")))).join(table, "_s").where(F.col("_p").startswith(F.col("_r.p"))).groupBy("_h", "_p").agg(F.max("_r").alias("_r"))
    out = urls.join(hits, (F.col(host_col) == F.col("_h")) & (F.col(path_col) == F.col("_p")), "left")
    return out.withColumns({"rule": F.col("_r.rule"), "rule_verdict": F.col("_r.verdict")}).drop("_h", "_p", "_r")


def page_edges(pages: DataFrame) -> DataFrame:
    """(page columns but html, targets): the URLs that a page's canonical links and refreshes name, each once."""
    html = F.coalesce(F.col("html"), F.lit(""))
    found = F.transform(_links(html), lambda x: F.translate(F.btrim(x, F.lit(" \t\n\r\f")), "\t\n\r", ""))
    links = F.when(html.rlike(r"(?i)<link\b|http-equiv"), F.filter(found, lambda x: x != "")).otherwise(F.expr("cast(array() as array<string>)"))
    bases = F.when(html.rlike(r"(?i)<base\b"), F.array_compact(F.transform(F.regexp_extract_all(html, F.lit(_TAG % "base"), F.lit(0)), lambda t: _attribute(t, "href"))))
    pages = pages.withColumn("targets", links).withColumn("_base", F.when(F.size("targets") > 0, F.get(bases, F.lit(0)))).drop("html")
    pages = pages.withColumn("_base", F.coalesce(resolved(F.col("url"), F.btrim("_base", F.lit(" \t\n\r\f"))), F.col("url")))
    return pages.withColumn("targets", F.array_distinct(F.array_compact(F.transform("targets", lambda x: resolved(F.when((x == "") | x.startswith("#"), F.col("url")).otherwise(F.col("_base")), x))))).drop("_base")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` (page_id, url, html, ...) without html, and host, path, rule, verdict and aliases (whether the verdict came from them).

    redirects: further edges (source, target), absolute URLs. A null url, and one without ``://``, has empty host and path, no
    rule and no alias. Repeated rows each stay.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "rule_verdict", "targets", "aliases")
    seen = page_edges(pages).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    seen = written(with_rules(seen, rules).withColumn("_node", node(F.col("url"))), "urls")
    links = seen.where(F.size("targets") > 0).select(F.col("url").alias("source"), F.explode("targets").alias("target"))
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    links = written(links.where(node(F.col("source")).isNotNull() & node(F.col("target")).isNotNull()).distinct(), "links")
    roots = components(links.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")))
    ends = links.select(F.explode(F.array("source", "target")).alias("url")).distinct().withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    ends = with_rules(ends, rules).select(node(F.col("url")).alias("node"), "rule_verdict").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A component's verdict is combined before the shuffle, so the size of a component does not matter.
    by_root = ends.groupBy("root").agg(F.max(F.when(F.col("rule_verdict") == "allow", 2).when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("_found"))
    by_node = written(ends.select("node", "root").distinct().join(by_root, "root").where("_found > 0").select(F.col("node").alias("_end"), "_found"), "verdicts")
    # A third of all pages may have one URL: its one row here is repeated for each salt that they are split by.
    salted = by_node.withColumn("_salt_end", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    seen = seen.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    out = seen.join(shuffled(salted), (F.col("_node") == F.col("_end")) & (F.col("_salt") == F.col("_salt_end")), "left")
    alias = F.when(F.col("_found") == 2, F.lit("allow")).when(F.col("_found") == 1, F.lit("block"))
    return out.withColumns({"verdict": F.coalesce("rule_verdict", alias, F.lit("allow")), "aliases": F.col("rule_verdict").isNull() & alias.isNotNull()}).drop("_node", "_end", "_found", "_salt", "_salt_end", "targets", "rule_verdict")
