"""The library's queries over the test tables, and DuckDB SQL that states what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwin.functions import crypto, scalar
from braidwin.operators import fk, joins, keyed, padding, position, rearrange
from braidwin.plans import metrics, registry
from braidwin.plans.config import JoinConfig
from braidwin.sources import generators
from braidwin.sources.tables import read_dump, read_keys, stream, write_dump, write_metrics
from braidwin.streaming import batches
from braidwin.streaming.eager import eager_stream

OUT = ["r_pos", "s_pos", "r_key", "s_key", "r_ts", "s_ts", "r_payload", "s_payload"]
BATCH = ["k", *OUT]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark, d) -> DataFrame:
    return stream(_table(spark, d, "customer").select("c_custkey"), "c_custkey", ["c_custkey"])


def orders(spark, d) -> DataFrame:
    return stream(_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", "o_orderkey")


def events(spark, d, kind: str) -> DataFrame:
    rows = _table(spark, d, "events").where(F.col("event_type") == kind).select("event_id", "ts", "user_id")
    return stream(rows, "user_id", ["ts", "event_id"], "ts", "event_id")


def suppliers(spark, d) -> DataFrame:
    return stream(_table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", ["s_suppkey"])


def lines(spark, d, key: str) -> DataFrame:
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", key)
    return stream(rows, key, ["l_shipdate", "l_orderkey", "l_linenumber", key], "l_shipdate", "l_orderkey")


def parts(spark, d) -> DataFrame:
    return stream(_table(spark, d, "part").select("p_partkey"), "p_partkey", ["p_partkey"], F.lit(0).cast("long"))


# --- the SQL of the same streams -------------------------------------------------------------------------------------

SQL_STREAMS = {
    "customers": "SELECT c_custkey - 0 AS key, c_custkey AS payload, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS pos, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS ts FROM customer",
    "orders": "SELECT o_custkey AS key, o_orderkey AS payload, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, epoch_us(o_orderdate) * 1000 AS ts FROM orders",
    "clicks": "SELECT user_id AS key, event_id AS payload, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS pos, epoch_us(ts) * 1000 AS ts FROM events WHERE event_type = 'click'",
    "purchases": "SELECT user_id AS key, event_id AS payload, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS pos, epoch_us(ts) * 1000 AS ts FROM events WHERE event_type = 'purchase'",
    "suppliers": "SELECT s_suppkey AS key, s_suppkey AS payload, ROW_NUMBER() OVER (ORDER BY s_suppkey) - 1 AS pos, ROW_NUMBER() OVER (ORDER BY s_suppkey) - 1 AS ts FROM supplier",
    "supplier_lines": "SELECT l_suppkey AS key, l_orderkey AS payload, ROW_NUMBER() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) - 1 AS pos, epoch_us(l_shipdate) * 1000 AS ts FROM lineitem",
    "part_lines": "SELECT l_partkey AS key, l_orderkey AS payload, ROW_NUMBER() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos, epoch_us(l_shipdate) * 1000 AS ts FROM lineitem",
    "parts": "SELECT p_partkey AS key, p_partkey AS payload, ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS pos, CAST(0 AS BIGINT) AS ts FROM part",
}
_PAIR = "a.pos AS r_pos, b.pos AS s_pos, a.key AS r_key, b.key AS s_key, a.ts AS r_ts, b.ts AS s_ts, a.payload AS r_payload, b.payload AS s_payload"


def _with(r: str, s: str) -> str:
    return f"WITH r AS ({SQL_STREAMS[r]}), s AS ({SQL_STREAMS[s]}), n AS (SELECT (SELECT COUNT(*) FROM r) AS nr, (SELECT COUNT(*) FROM s) AS ns)"


def sql_eager(r: str, s: str, window: tuple[int, int], prefill: tuple[int, int] | None = None) -> str:
    (wr, ws), (pr, ps) = window, prefill or window
    return f"""{_with(r, s)},
m AS (SELECT 1 AS side, * FROM r UNION ALL SELECT 0 AS side, * FROM s),
c AS (SELECT *, SUM(1 - side) OVER w AS cs, SUM(side) OVER w AS cr FROM m WINDOW w AS (ORDER BY ts, side, pos ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, GREATEST(cs, {ps}) AS seen FROM c WHERE side = 1), b AS (SELECT *, GREATEST(cr, {pr}) AS seen FROM c WHERE side = 0)
SELECT {_PAIR} FROM a JOIN b ON a.key = b.key
WHERE (a.pos >= {pr} AND b.pos < a.seen AND b.pos >= a.seen - {ws}) OR (b.pos >= {ps} AND a.pos < b.seen AND a.pos >= b.seen - {wr})"""


def _k(side: str, window: int, batch: int) -> str:
    return f"CASE WHEN pos < {window} THEN -1 ELSE CAST(FLOOR((pos - {window}) / {batch}) AS BIGINT) END AS k FROM {side}"


def sql_delta(r: str, s: str, window: tuple[int, int], batch: tuple[int, int]) -> str:
    (wr, ws), (br, bs) = window, batch
    return f"""{_with(r, s)},
a AS (SELECT *, {_k("r", wr, br)}), b AS (SELECT *, {_k("s", ws, bs)})
SELECT GREATEST(a.k, b.k) AS k, {_PAIR} FROM a JOIN b ON a.key = b.key, n
WHERE GREATEST(a.k, b.k) >= 0 AND (a.k >= b.k OR a.pos >= LEAST({wr} + b.k * {br}, n.nr) - {wr}) AND (b.k >= a.k OR b.pos >= LEAST({ws} + a.k * {bs}, n.ns) - {ws})"""


def _sql_batches(r: str, s: str, window: tuple[int, int], batch: tuple[int, int]) -> str:
    (wr, ws), (br, bs) = window, batch

    def side(t: str, w: int, b: int) -> str:
        return f"SELECT k.k, {t}.*, pos >= LEAST({w} + k.k * {b}, n.n{t}) AS fresh FROM {t}, n, k WHERE pos >= LEAST({w} + k.k * {b}, n.n{t}) - {w} AND pos < LEAST({w} + (k.k + 1) * {b}, n.n{t})"

    return f"""{_with(r, s)},
k AS (SELECT UNNEST(RANGE(0, CAST(GREATEST(CEIL((nr - {wr}) / {br}), CEIL((ns - {ws}) / {bs}), 0) AS BIGINT))) AS k FROM n),
a0 AS ({side("r", wr, br)}), b0 AS ({side("s", ws, bs)})"""


def sql_snapshot(r: str, s: str, window: tuple[int, int], batch: tuple[int, int]) -> str:
    return f"{_sql_batches(r, s, window, batch)}\nSELECT a.k, {_PAIR} FROM a0 a JOIN b0 b ON a.k = b.k AND a.key = b.key"


def sql_rect(r: str, s: str, window: tuple[int, int], batch: tuple[int, int]) -> str:
    return f"""{_sql_batches(r, s, window, batch)},
a AS (SELECT *, BOOL_OR(fresh) OVER (PARTITION BY k, key) AS hf FROM a0), b AS (SELECT *, BOOL_OR(fresh) OVER (PARTITION BY k, key) AS hf FROM b0)
SELECT a.k, {_PAIR} FROM a JOIN b ON a.k = b.k AND a.key = b.key WHERE (a.fresh OR b.hf) AND (b.fresh OR a.hf)"""


# --- the queries: name -> (function, SQL or None) --------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {}

W, B = (512, 512), (64, 256)
EW, EB = (64, 64), (16, 16)


def _run(alg: str, r: Callable, s: Callable, window: tuple[int, int], batch: tuple[int, int] = (0, 0), **more) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        config = JoinConfig(alg=alg, r_window=window[0], s_window=window[1], r_batch=batch[0], s_batch=batch[1], **more)
        out = registry.run(r(spark, d), s(spark, d), config)
        return out.select(BATCH if "k" in out.columns else OUT)

    return query


def clicks(spark, d):
    return events(spark, d, "click")


def purchases(spark, d):
    return events(spark, d, "purchase")


def supplier_lines(spark, d):
    return lines(spark, d, "l_suppkey")


def part_lines(spark, d):
    return lines(spark, d, "l_partkey")


FK = {"fk_join": True}
ALL["delta_fk_customer_orders"] = _run("FK-MERG-L3", customers, orders, W, B, **FK), sql_delta("customers", "orders", W, B)
ALL["fk_sort_l3"] = _run("FK-SORT-L3", customers, orders, W, B, **FK), sql_delta("customers", "orders", W, B)
ALL["sort_l2_lockstep"] = _run("FK-SORT-L2", customers, orders, W, **FK), sql_delta("customers", "orders", W, (1, 1))
ALL["eager_click_purchase"] = _run("SHJ", clicks, purchases, EW, no_sgx=True), sql_eager("clicks", "purchases", EW)
ALL["shj_l1"] = _run("SHJ-L1", clicks, purchases, EW), sql_eager("clicks", "purchases", EW)
ALL["shj_l2"] = _run("SHJ-L2", clicks, purchases, EW), sql_eager("clicks", "purchases", EW)
ALL["eager_fk_part_lineitem"] = _run("FK-MERG-L2", parts, part_lines, (128, 4096), **FK), sql_eager("parts", "part_lines", (128, 4096))
ALL["nlj_prefill_plus_one"] = _run("NLJ-L4", clicks, purchases, EW), sql_eager("clicks", "purchases", EW, (65, 65))
ALL["shj_l3_window_plus_batch"] = _run("SHJ-L3", clicks, purchases, EW, EB), sql_delta("clicks", "purchases", (80, 80), EB)
ALL["shj_l3_supplier_lineitem"] = _run("SHJ-L3", suppliers, supplier_lines, (32, 512), (8, 256)), sql_delta("suppliers", "supplier_lines", (40, 768), (8, 256))
ALL["delta_click_purchase"] = (lambda spark, d: joins.delta(clicks(spark, d), purchases(spark, d), EW, EB).select(BATCH)), sql_delta("clicks", "purchases", EW, EB)
ALL["snapshot"] = (lambda spark, d: joins.snapshot(clicks(spark, d), purchases(spark, d), EW, EB).select(BATCH)), sql_snapshot("clicks", "purchases", EW, EB)
ALL["snapshot_ephemeral"] = _run("FK-EPHI-L2", customers, orders, W, B, **FK), sql_snapshot("customers", "orders", (448, 256), B)
ALL["rect_nfk"] = _run("NFK-JOIN-L3", clicks, purchases, EW, EB), sql_rect("clicks", "purchases", EW, EB)
ALL["rect_nfk_lockstep"] = _run("NFK-JOIN-L2", clicks, purchases, EW), sql_rect("clicks", "purchases", EW, (1, 1))
ALL["static_symmetric"] = (lambda spark, d: joins.static(customers(spark, d), orders(spark, d)).select(OUT)), f"{_with('customers', 'orders')} SELECT {_PAIR} FROM r a JOIN s b ON a.key = b.key"
ALL["self_join_window"] = _run("SHJ-L1", clicks, clicks, EW, self_join=True), sql_eager("clicks", "clicks", EW)


def eager_encrypted_key(spark: SparkSession, d: str) -> DataFrame:
    config = JoinConfig(alg="SHJ-L0", no_sgx=True, r_window=64, s_window=64)
    out = registry.run(clicks(spark, d), purchases(spark, d), config)
    return out.select("r_pos", "s_pos", crypto.decrypt_int(F.col("r_key")).alias("key"), crypto.decrypt_int(F.col("s_payload")).alias("s_payload"))


ALL["eager_encrypted_key"] = eager_encrypted_key, f"SELECT r_pos, s_pos, r_key AS key, s_payload FROM ({sql_eager('clicks', 'purchases', EW)})"


def _padded_sizes(alg: str, r: Callable, s: Callable, window, batch, **more) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        config = JoinConfig(alg=alg, r_window=window[0], s_window=window[1], r_batch=batch[0], s_batch=batch[1], **more)
        a, b = r(spark, d), s(spark, d)
        return registry.sizes(a, b, registry.run(a, b, config), config).select("k", "matches", "emitted", "dummies")

    return query


def _sql_sizes(delta: str, r: str, s: str, window, batch, size: str) -> str:
    (wr, ws), (br, bs) = window, batch
    body = f"""x AS ({delta}), {_with(r, s)[5:]},
k AS (SELECT UNNEST(RANGE(0, CAST(GREATEST(CEIL((nr - {wr}) / {br}), CEIL((ns - {ws}) / {bs}), 0) AS BIGINT))) AS k FROM n),
z AS (SELECT k.k, LEAST({wr} + (k.k + 1) * {br}, nr) - LEAST({wr} + k.k * {br}, nr) AS fr, LEAST({ws} + (k.k + 1) * {bs}, ns) - LEAST({ws} + k.k * {bs}, ns) AS fs FROM k, n),
c AS (SELECT z.*, COALESCE((SELECT COUNT(*) FROM x WHERE x.k = z.k), 0) AS matches FROM z)"""
    return f"WITH {body} SELECT k, matches, GREATEST({size}, matches) AS emitted, GREATEST({size}, matches) - matches AS dummies FROM c"


_MERGE = f"CAST(({W[0]} + fs) + ({W[1]} + fr) + (fr + fs) AS BIGINT)"
ALL["padded_l4_merge"] = _padded_sizes("FK-MERG-L4", customers, orders, W, B, **FK), _sql_sizes(sql_delta("customers", "orders", W, B), "customers", "orders", W, B, _MERGE)
ALL["padded_l4_sort"] = _padded_sizes("FK-SORT-L4", customers, orders, W, B, **FK), _sql_sizes(sql_delta("customers", "orders", W, B), "customers", "orders", W, B, _MERGE)
ALL["padded_l4_shj"] = _padded_sizes("SHJ-L4", clicks, purchases, EW, EB), _sql_sizes(sql_delta("clicks", "purchases", (80, 80), EB), "clicks", "purchases", (80, 80), EB, "CAST(256 AS BIGINT)")


def trim_dummies(spark: SparkSession, d: str) -> DataFrame:
    config = JoinConfig(alg="FK-MERG-L4", r_window=512, s_window=512, r_batch=64, s_batch=256, fk_join=True)
    return padding.trim(registry.padded(customers(spark, d), orders(spark, d), config)).select(BATCH)


ALL["trim_dummies"] = trim_dummies, sql_delta("customers", "orders", W, B)


def padded_rows(spark: SparkSession, d: str) -> DataFrame:
    config = JoinConfig(alg="FK-SORT-L4", r_window=512, s_window=512, r_batch=64, s_batch=256, fk_join=True)
    rows = registry.padded(customers(spark, d), orders(spark, d), config)
    return rows.groupBy("k", "is_dummy").agg(F.count("*").alias("n"))


_S = _sql_sizes(sql_delta("customers", "orders", W, B), "customers", "orders", W, B, _MERGE)
ALL["padded_rows"] = padded_rows, f"SELECT k, false AS is_dummy, matches AS n FROM ({_S}) WHERE matches > 0 UNION ALL SELECT k, true, dummies FROM ({_S}) WHERE dummies > 0"


def nlj_padding(spark: SparkSession, d: str) -> DataFrame:
    r, s = clicks(spark, d), purchases(spark, d)
    probes = r.where("pos >= 65").select(F.col("pos").alias("probe"))
    rr, _ = position.merged_counts(r, s)
    ns = rr.withColumn("ns", F.greatest("ns", F.lit(65))).where("pos >= 65")
    found = joins.band(ns, s, "r", "s", F.col("ns") - 64, F.col("ns"), 64).select(F.col("r_pos").alias("probe"))
    return padding.pad_probes(found, probes, 64)


ALL["nlj_padding"] = nlj_padding, f"""{_with('clicks', 'purchases')},
m AS (SELECT 1 AS side, * FROM r UNION ALL SELECT 0 AS side, * FROM s),
c AS (SELECT *, SUM(1 - side) OVER (ORDER BY ts, side, pos ROWS UNBOUNDED PRECEDING) AS cs FROM m),
a AS (SELECT *, GREATEST(cs, 65) AS seen FROM c WHERE side = 1 AND pos >= 65)
SELECT a.pos AS probe, COUNT(b.pos) AS matches, CAST(64 AS BIGINT) AS emitted FROM a LEFT JOIN s b ON a.key = b.key AND b.pos < a.seen AND b.pos >= a.seen - 64 GROUP BY a.pos"""

_ONE = f"WITH s AS ({SQL_STREAMS['clicks']})"
ALL["arrival_positions"] = (lambda spark, d: orders(spark, d).select("pos", "key", "payload", "ts")), f"SELECT pos, key, payload, ts FROM ({SQL_STREAMS['orders']})"
ALL["key_counts"] = (lambda spark, d: keyed.key_counts(clicks(spark, d))), f"{_ONE} SELECT key, COUNT(*) AS n FROM s GROUP BY key"
ALL["rank_of_key"] = (lambda spark, d: keyed.rank_of_key(clicks(spark, d))), f"{_ONE} SELECT DISTINCT key, (SELECT COUNT(*) FROM s b WHERE b.key < a.key) AS rank FROM s a"
ALL["rank_of_row"] = (lambda spark, d: keyed.ranked(clicks(spark, d)).select("pos", "rank")), f"{_ONE} SELECT pos, ROW_NUMBER() OVER (ORDER BY key, ts, pos) - 1 AS rank FROM s"
ALL["point_probe"] = (lambda spark, d: _probe(clicks(spark, d))), f"{_ONE} SELECT * FROM s WHERE (key, ts) = (SELECT (key, ts) FROM s WHERE pos = 17)"
ALL["successor_ts"] = (lambda spark, d: keyed.successor(clicks(spark, d)).select("pos", "key", "next_ts")), f"{_ONE} SELECT pos, key, LEAD(ts) OVER (PARTITION BY key ORDER BY ts, pos) AS next_ts FROM s"
ALL["evict_oldest"] = (lambda spark, d: keyed.evicted(clicks(spark, d), 100)), f"{_ONE} SELECT ts, key, payload, pos FROM s ORDER BY ts, key, pos LIMIT 100"
ALL["extract_min"] = (lambda spark, d: keyed.extract_min(clicks(spark, d))), f"{_ONE} SELECT ts, key, payload, pos FROM s ORDER BY ts, key, pos LIMIT 1"
ALL["window_retire"] = (lambda spark, d: keyed.window_at(clicks(spark, d), 1000, 64)), f"{_ONE} SELECT ts, key, payload, pos FROM s WHERE pos >= 936 AND pos < 1000"
ALL["remove_rows"] = (lambda spark, d: keyed.without(clicks(spark, d), keyed.evicted(clicks(spark, d), 50)).select("ts", "key", "payload", "pos")), f"{_ONE} SELECT ts, key, payload, pos FROM s WHERE (key, ts) NOT IN (SELECT (key, ts) FROM s ORDER BY ts, key, pos LIMIT 50)"
ALL["ring_counts"] = (lambda spark, d: keyed.ring(clicks(spark, d), 64).select("pos", "key", "in_ring")), f"{_ONE} SELECT a.pos, a.key, COUNT(*) AS in_ring FROM s a JOIN s b ON a.key = b.key AND b.pos <= a.pos AND b.pos > a.pos - 64 GROUP BY a.pos, a.key"


def _probe(df: DataFrame) -> DataFrame:
    at = df.where("pos = 17").first()
    return keyed.lookup(df, at.key, at.ts).select("key", "payload", "pos", "ts")


def _weighted(spark, d) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("weight"))


_WEIGHTED = "WITH o AS (SELECT o_orderkey, o_custkey % 4 AS weight FROM orders)"
ALL["expand_by_weight"] = (lambda spark, d: rearrange.expand(_weighted(spark, d), "weight")), f"{_WEIGHTED} SELECT o_orderkey, weight, UNNEST(RANGE(0, weight)) AS copy FROM o WHERE weight > 0"
ALL["prefix_offsets"] = (lambda spark, d: rearrange.offsets(_weighted(spark, d), "weight", ["o_orderkey"])), f"{_WEIGHTED} SELECT *, CAST(SUM(weight) OVER (ORDER BY o_orderkey) - weight AS BIGINT) AS slot FROM o"
ALL["distribute_to_slots"] = (lambda spark, d: rearrange.distributed(_weighted(spark, d), "weight", ["o_orderkey"])), f"{_WEIGHTED}, x AS (SELECT *, CAST(SUM(weight) OVER (ORDER BY o_orderkey) - weight AS BIGINT) AS slot FROM o) SELECT o_orderkey, weight, slot + UNNEST(RANGE(0, weight)) AS slot FROM x WHERE weight > 0"
ALL["block_sizes"] = (lambda spark, d: rearrange.block_sizes(clicks(spark, d), purchases(spark, d))), f"{_with('clicks', 'purchases')}, a AS (SELECT key, COUNT(*) AS height FROM r GROUP BY key), b AS (SELECT key, COUNT(*) AS width FROM s GROUP BY key) SELECT key, height, width, height * width AS pairs FROM a JOIN b USING (key)"
ALL["output_size"] = (lambda spark, d: rearrange.output_size(clicks(spark, d), purchases(spark, d))), f"{_with('clicks', 'purchases')} SELECT COUNT(*) AS pairs FROM r JOIN s ON r.key = s.key"
_MARK = "payload % 3 = 0"
ALL["compact_marked"] = (lambda spark, d: rearrange.compact(orders(spark, d), F.expr(_MARK))), f"WITH s AS ({SQL_STREAMS['orders']}) SELECT ts, key, payload, pos FROM s WHERE {_MARK}"
ALL["compact_stable"] = (lambda spark, d: rearrange.compact_stable(orders(spark, d), F.expr(_MARK), ["pos"]).select("pos", "place")), f"WITH s AS ({SQL_STREAMS['orders']}) SELECT pos, ROW_NUMBER() OVER (ORDER BY CASE WHEN {_MARK} THEN 0 ELSE 1 END, pos) - 1 AS place FROM s"
ALL["prefix_sums_of_marks"] = (lambda spark, d: position.running(orders(spark, d), ["pos"], {"marks": F.expr(_MARK).cast("int")}, F.floor(F.col("pos") / 4096)).select("pos", "marks")), f"WITH s AS ({SQL_STREAMS['orders']}) SELECT pos, CAST(SUM(CASE WHEN {_MARK} THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS BIGINT) AS marks FROM s"


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    return position.with_pos(df, order, name="place")


_TAGGED = f"{_with('customers', 'orders')}, t AS (SELECT 'R' AS side, * FROM r UNION ALL SELECT 'S', * FROM s)"
ALL["merge_tagged"] = (lambda spark, d: fk.tagged(customers(spark, d), orders(spark, d)).select("side", "ts", "key", "payload", "pos")), f"{_TAGGED} SELECT side, ts, key, payload, pos FROM t"
ALL["sort_by_key_side"] = (lambda spark, d: _numbered(fk.tagged(customers(spark, d), orders(spark, d)), ["key", "side", "pos"]).select("side", "key", "pos", "place")), f"{_TAGGED} SELECT side, key, pos, ROW_NUMBER() OVER (ORDER BY key, side, pos) - 1 AS place FROM t"
ALL["sorted_scan"] = (lambda spark, d: rearrange.in_order(orders(spark, d).select("key", "pos"), F.col("key").desc(), "pos")), f"SELECT key, pos FROM ({SQL_STREAMS['orders']}) ORDER BY key DESC, pos"
ALL["is_sorted"] = (lambda spark, d: rearrange.is_sorted(orders(spark, d), "ts").select(F.lit("ts").alias("column"), "sorted").union(rearrange.is_sorted(orders(spark, d), "key").select(F.lit("key"), "sorted"))), f"""WITH s AS ({SQL_STREAMS['orders']}),
x AS (SELECT ts, key, LAG(ts) OVER (ORDER BY pos) AS ts_before, LAG(key) OVER (ORDER BY pos) AS key_before FROM s)
SELECT 'ts' AS "column", COUNT(*) FILTER (ts < ts_before) = 0 AS sorted FROM x UNION ALL SELECT 'key', COUNT(*) FILTER (key < key_before) = 0 FROM x"""
ALL["next_tuple_order"] = (lambda spark, d: position.merge_order(clicks(spark, d), purchases(spark, d)).select("side", "pos", "turn")), f"{_with('clicks', 'purchases')}, t AS (SELECT 'R' AS side, 1 AS rank, * FROM r UNION ALL SELECT 'S', 0, * FROM s) SELECT side, pos, ROW_NUMBER() OVER (ORDER BY ts, rank, pos) - 1 AS turn FROM t"
ALL["micro_batches"] = (lambda spark, d: _slices(orders(spark, d))), f"SELECT CASE WHEN pos < 512 THEN -1 ELSE CAST(FLOOR((pos - 512) / 256) AS BIGINT) END AS k, COUNT(*) AS n, MIN(pos) AS first, MAX(pos) AS last FROM ({SQL_STREAMS['orders']}) GROUP BY 1"
ALL["positional_zip"] = (lambda spark, d: rearrange.zipped(clicks(spark, d).select(F.col("payload").alias("left_id")), purchases(spark, d).select(F.col("payload").alias("right_id")), (["left_id"], ["right_id"]))), f"{_with('clicks', 'purchases')}, a AS (SELECT payload AS left_id, ROW_NUMBER() OVER (ORDER BY payload) - 1 AS place FROM r), b AS (SELECT payload AS right_id, ROW_NUMBER() OVER (ORDER BY payload) - 1 AS place FROM s) SELECT place, left_id, right_id FROM a JOIN b USING (place)"
ALL["last_seen_scan"] = (lambda spark, d: fk.last_seen(parts(spark, d), part_lines(spark, d)).select(OUT)), f"{_with('parts', 'part_lines')} SELECT {_PAIR} FROM r a JOIN s b ON a.key = b.key"
ALL["fk_duplicates"] = (lambda spark, d: fk.duplicate_keys(clicks(spark, d), 64)), f"{_ONE}, x AS (SELECT key, pos, pos - LAG(pos) OVER (PARTITION BY key ORDER BY pos) AS gap FROM s) SELECT key, pos FROM x WHERE gap < 64"
ALL["fk_latest"] = (lambda spark, d: fk.require_unique(clicks(spark, d), duplicates="latest").select("key", "payload", "pos", "ts")), f"{_ONE} SELECT key, payload, pos, ts FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY key ORDER BY pos DESC) = 1"
ALL["tuple_by_tuple_counts"] = (lambda spark, d: metrics.matches_by_tuple(joins.eager(clicks(spark, d), purchases(spark, d), EW))), f"SELECT r_pos, COUNT(*) AS matches FROM ({sql_eager('clicks', 'purchases', EW)}) GROUP BY r_pos"
ALL["count_matches"] = (lambda spark, d: joins.delta(customers(spark, d), orders(spark, d), W, B).agg(F.count("*").alias("matches"))), f"SELECT COUNT(*) AS matches FROM ({sql_delta('customers', 'orders', W, B)})"


def _slices(df: DataFrame) -> DataFrame:
    side = joins.Side(512, 256, 0)
    return df.withColumn("k", side.batch_of(F.col("pos"))).groupBy("k").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def aes_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    keys = _table(spark, d, "customer").select("c_custkey")
    data = crypto.little_endian(F.col("c_custkey"))
    return keys.select(
        "c_custkey", crypto.decrypt_int(crypto.encrypt_int(F.col("c_custkey"))).alias("plain"), crypto.from_little_endian(crypto.decrypt_random(crypto.encrypt_random(data))).alias("random_plain"),
        F.octet_length(crypto.encrypt(data)).cast("long").alias("size"), crypto.ciphertext_length(F.lit(4)).cast("long").alias("known_size"))


ALL["aes_roundtrip"] = aes_roundtrip, "SELECT c_custkey, c_custkey AS plain, c_custkey AS random_plain, CAST(16 AS BIGINT) AS size, CAST(16 AS BIGINT) AS known_size FROM customer"


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    return rows.select(
        "o_orderkey", scalar.to_ns(k, F.col("o_custkey")).alias("ns"), scalar.time_code(k * 1_000_000).alias("code"), scalar.bucket(k, 1024, 2).alias("bucket"), scalar.megabytes(k).alias("mb"),
        rearrange.next_power_of_two(k).alias("next_pow2"), rearrange.previous_power_of_two(k).alias("prev_pow2"), scalar.choose(k % 2 == 0, k, F.col("o_custkey")).alias("chosen"))


ALL["scalar_functions"] = scalar_functions, """SELECT o_orderkey, o_orderkey * 1000000000 + o_custkey AS ns,
CASE WHEN o_orderkey * 1000000 // 1000000000 < 2048 THEN CAST((o_orderkey * 1000000 // 1000000000) * 2097152 + FLOOR((o_orderkey * 1000000 % 1000000000) * 2097152 / 999999999) AS BIGINT) END AS code,
(o_orderkey & 1023) >> 2 AS bucket, o_orderkey / 1048576 AS mb,
CAST(CASE WHEN o_orderkey <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << CAST(LENGTH(BIN(o_orderkey - 1)) AS INT) END AS BIGINT) AS next_pow2,
CAST(CASE WHEN o_orderkey <= 1 THEN 0 ELSE CAST(1 AS BIGINT) << CAST(LENGTH(BIN(o_orderkey - 1)) - 1 AS INT) END AS BIGINT) AS prev_pow2,
CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey END AS chosen FROM orders"""


def pad_power_of_two(spark: SparkSession, d: str) -> DataFrame:
    padded = padding.pad_to_power_of_two(customers(spark, d).select("key"))
    return padded.agg(F.count("*").alias("n"), F.count_if("is_dummy").alias("dummies"))


ALL["pad_power_of_two"] = pad_power_of_two, "WITH c AS (SELECT COUNT(*) AS m FROM customer) SELECT CAST(POWER(2, CEIL(LOG2(m))) AS BIGINT) AS n, CAST(POWER(2, CEIL(LOG2(m))) AS BIGINT) - m AS dummies FROM c"


def oblivious_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return rearrange.shuffled(orders(spark, d), 7, ["pos"]).agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.min("place").alias("first"), F.max("place").alias("last"), F.sum("key").alias("keys"))


ALL["oblivious_shuffle"] = oblivious_shuffle, "SELECT COUNT(*) AS n, COUNT(*) AS places, CAST(0 AS BIGINT) AS first, COUNT(*) - 1 AS last, CAST(SUM(o_custkey) AS BIGINT) AS keys FROM orders"


def _shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.min("key").alias("least"), F.max("key").alias("most"), F.count_distinct("pos").alias("places"))


_GIVEN = "CAST({} AS BIGINT) AS n, CAST({} AS BIGINT) AS keys, CAST({} AS BIGINT) AS least, CAST({} AS BIGINT) AS most, CAST({} AS BIGINT) AS places"
ALL["generate_pk"] = (lambda spark, d: _shape(generators.unique_keys(spark, 5000))), f"SELECT {_GIVEN.format(5000, 5000, 1, 5000, 5000)}"
ALL["generate_fk"] = (lambda spark, d: generators.foreign_keys(spark, 5500, 1000).groupBy("key").agg(F.count("*").alias("n"))), "SELECT key, CASE WHEN key <= 500 THEN CAST(6 AS BIGINT) ELSE 5 END AS n FROM RANGE(1, 1001) t(key)"
ALL["generate_uniform"] = (lambda spark, d: _shape(generators.uniform_keys(spark, 20000, 20))), f"SELECT {_GIVEN.format(20000, 20, 1, 20, 20000)}"
ALL["generate_zipf"] = (lambda spark, d: generators.zipf_keys(spark, 20000, 100, 0.9).groupBy("key").agg(F.count("*").alias("n"))), None
ALL["generate_spread"] = (lambda spark, d: _shape(generators.spread_keys(spark, 100, 10000))), f"SELECT {_GIVEN.format(100, 100, 1, 9901, 100)}"
ALL["generate_listed"] = (lambda spark, d: _strangers(customers(spark, d))), "SELECT CAST(0 AS BIGINT) AS strangers"
ALL["generate_repeated"] = (lambda spark, d: generators.repeated_keys(customers(spark, d), 3).groupBy("key").agg(F.count("*").alias("n"))), "SELECT c_custkey AS key, CAST(3 AS BIGINT) AS n FROM customer"
ALL["generate_repeated_sorted"] = (lambda spark, d: generators.repeated_keys(customers(spark, d), 3, sort=True).select("pos", "key")), "SELECT ROW_NUMBER() OVER (ORDER BY c_custkey, i) - 1 AS pos, c_custkey AS key FROM customer, RANGE(3) t(i)"
ALL["generate_times"] = (lambda spark, d: rearrange.is_sorted(generators.uniform_keys(spark, 20000, 20, rate=1000), "ts")), "SELECT true AS sorted"
ALL["throughput_metrics"] = (lambda spark, d: metrics.measured(customers(spark, d), orders(spark, d), JoinConfig(alg="FK-MERG-L4", r_window=512, s_window=512, r_batch=64, s_batch=256, fk_join=True))), None


ALL["shuffle_keys"] = (lambda spark, d: rearrange.reseated(orders(spark, d), ["key", "payload"], 3).agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.sum("payload").alias("payloads"), F.count_distinct("pos").alias("places"))), "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS keys, CAST(SUM(o_orderkey) AS BIGINT) AS payloads, COUNT(*) AS places FROM orders"


def _strangers(keys: DataFrame) -> DataFrame:
    return generators.listed_keys(keys, 3000).select("key").distinct().join(keys.select("key"), "key", "left_anti").agg(F.count("*").alias("strangers"))


def stream_delta(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and purchases as a file stream: the prefill, then triggers of one or more batches of 500 rows a side."""
    r, s = clicks(spark, d), purchases(spark, d)
    window, batch = EW, (500, 500)
    side_r, side_s = joins.sides(r, s, window, batch)
    n = max(side_r.batches, side_s.batches)
    cuts = [(window[0] + k * batch[0], window[1] + k * batch[1]) for k in range(0, n, batches.batches_a_trigger(n, max(batch)))]
    at = batches.scratch(spark)
    join = batches.BatchJoin(f"{at}/out", f"{at}/state", window, "delta", batch)
    stream_ = batches.as_files(r, s, cuts, f"{at}/in")
    stream_.writeStream.option("checkpointLocation", f"{at}/checkpoint").foreachBatch(join).trigger(availableNow=True).start().awaitTermination()
    return batches.read_result(spark, f"{at}/out").select(BATCH)


ALL["stream_delta"] = stream_delta, sql_delta("clicks", "purchases", EW, (500, 500))


def stream_eager(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and purchases as a file stream, joined tuple by tuple: the prefill, then all that came up to some times, then the rest."""
    r, s = clicks(spark, d), purchases(spark, d)
    rr, _ = position.merged_counts(r, s)
    step = 700 * batches.batches_a_trigger(-(-r.count() // 700), 700)
    cuts = [EW, *((x.pos, max(x.ns, EW[1])) for x in rr.where(f"pos % {step} = 0 and pos > 64").select("pos", "ns").orderBy("pos").collect())]
    at = batches.scratch(spark)
    own = spark.newSession()  # the state is one group: other partitions would only start tasks without rows, in every trigger
    own.conf.set("spark.sql.shuffle.partitions", "1")
    result = eager_stream(batches.as_files(r, s, cuts, f"{at}/in", own), EW)
    result.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select(OUT)


ALL["stream_eager"] = stream_eager, sql_eager("clicks", "purchases", EW)


def count_dummies(spark: SparkSession, d: str) -> DataFrame:
    config = JoinConfig(alg="FK-MERG-L4", r_window=512, s_window=512, r_batch=64, s_batch=256, fk_join=True)
    return padding.count_dummies(registry.padded(customers(spark, d), orders(spark, d), config))


ALL["count_dummies"] = count_dummies, f"SELECT CAST(SUM(dummies) AS BIGINT) AS dummies FROM ({_S})"


def dump_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Clicks written as text lines and read again."""
    at = batches.scratch(spark)
    write_dump(clicks(spark, d), f"{at}/dump")
    return read_dump(spark, f"{at}/dump").select("pos", "ts", "key", "payload")


ALL["dump_round_trip"] = dump_round_trip, f"SELECT pos, ts, key, payload FROM ({SQL_STREAMS['clicks']})"


def key_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customer keys written one a line, with lines that are none, and read as a stream: its keys, and whether times rise."""
    at = batches.scratch(spark)
    keys = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("value"))
    keys.union(spark.createDataFrame([("x",), ("",), ("-4",)], "value string")).write.text(f"{at}/keys")
    read = read_keys(spark, f"{at}/keys", 1000)
    return read.select("key").join(rearrange.is_sorted(read, "ts"))


ALL["key_file_scan"] = key_file_scan, "SELECT c_custkey AS key, true AS sorted FROM customer WHERE c_custkey > 0"
ALL["append_figures"] = (lambda spark, d: _figures(spark, d)), "SELECT CAST(2 AS BIGINT) AS runs, CAST(1 AS BIGINT) AS different"


def _figures(spark: SparkSession, d: str) -> DataFrame:
    at = batches.scratch(spark)
    row = spark.createDataFrame([("SHJ", 1, 1, 2, 3, 0.5)], metrics.SCHEMA)
    for _ in range(2):
        write_metrics(row, f"{at}/figures")
    return spark.read.option("header", True).csv(f"{at}/figures").agg(F.count("*").alias("runs"), F.count_distinct("algorithm").alias("different"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """DELTA of customers and orders with windows that fit 150 customers."""
    return joins.delta(customers(spark, d), orders(spark, d), (32, 32), (8, 32)).select(BATCH)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
