import numpy as np
import pytest
from helpers import frame, random_stream
from pyspark.sql import functions as F

from braidwin.functions import crypto, scalar
from braidwin.operators import fk, keyed, position, rearrange


def test_positions_with_ties_nulls_and_times(spark):
    rows = spark.createDataFrame([(3, 1), (None, 2), (1, 3), (1, 4), (2, 5)], "a int, b int")
    assert [(x.b, x.pos) for x in position.with_pos(rows, ["a", "b"]).orderBy("pos").collect()] == [(2, 0), (3, 1), (4, 2), (5, 3), (1, 4)]
    times = rows.select(F.expr("timestamp '2020-01-01' + make_interval(0, 0, 0, b)").alias("t"), "b")
    assert [x.b for x in position.with_pos(times, ["t", "b"]).orderBy("pos").collect()] == [1, 2, 3, 4, 5]
    assert position.with_pos(rows.limit(0), ["a", "b"]).count() == 0
    assert position.with_pos(rows, ["a", "b"], name="pos2").columns == ["a", "b", "pos2"]


def test_ring_counts_the_last_rows(spark):
    rng = np.random.default_rng(0)
    rows = random_stream(rng, 50, 4, nulls=False)
    found = {x.pos: x.in_ring for x in keyed.ring(frame(spark, rows), 7).collect()}
    assert found == {i: sum(rows[j][1] == rows[i][1] for j in range(max(0, i - 6), i + 1)) for i in range(50)}


def test_ordered_map(spark):
    df = frame(spark, [(5, 2), (6, 1), (7, 2), (8, 0)])
    assert {x.pos: x.rank for x in keyed.ranked(df).collect()} == {3: 0, 1: 1, 0: 2, 2: 3}
    assert {x.key: x.rank for x in keyed.rank_of_key(df).collect()} == {0: 0, 1: 1, 2: 2}
    assert {x.pos: x.next_ts for x in keyed.successor(df).collect()} == {0: 7, 1: None, 2: None, 3: None}
    assert [x.pos for x in keyed.evicted(df, 2).collect()] == [0, 1]
    assert keyed.extract_min(df).first().pos == 0
    assert keyed.lookup(df, 2, 7).first().pos == 2
    assert sorted(x.pos for x in keyed.without(df, keyed.lookup(df, 2, 7)).collect()) == [0, 1, 3]


def test_expand_offsets_and_slots(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, 3)], "id int, w int")
    assert sorted((x.id, x["copy"]) for x in rearrange.expand(df, "w").collect()) == [(1, 0), (1, 1), (4, 0), (4, 1), (4, 2)]
    assert {x.id: x.slot for x in rearrange.offsets(df, "w", ["id"]).collect()} == {1: 0, 2: 2, 3: 2, 4: 2}
    assert sorted((x.slot, x.id) for x in rearrange.distributed(df, "w", ["id"]).collect()) == [(0, 1), (1, 1), (2, 4), (3, 4), (4, 4)]


def test_compaction_and_permutations(spark):
    df = frame(spark, [(i, i % 3) for i in range(12)])
    placed = rearrange.compact_stable(df, F.col("key") == 1, ["pos"]).orderBy("place").collect()
    assert [x.pos for x in placed] == [1, 4, 7, 10, 0, 2, 3, 5, 6, 8, 9, 11]
    moved = rearrange.shuffled(df, 3, ["pos"]).orderBy("place").collect()
    assert sorted(x.pos for x in moved) == list(range(12)) and [x.place for x in moved] == list(range(12)) and [x.pos for x in moved] != list(range(12))
    seated = rearrange.reseated(df, ["key", "payload"], 3).orderBy("pos").collect()
    assert [x.ts for x in seated] == list(range(12)) and sorted(x.payload for x in seated) == [100 + i for i in range(12)]
    assert all(x.key == (x.payload - 100) % 3 for x in seated)


def test_sizes_and_sortedness(spark):
    r, s = frame(spark, [(0, 1), (1, 1), (2, 2), (3, None)]), frame(spark, [(0, 1), (1, 2), (2, 2), (3, None)])
    assert rearrange.output_size(r, s).first().pairs == r.join(s, "key").count() == 4
    assert rearrange.is_sorted(r, "ts").first().sorted and not rearrange.is_sorted(frame(spark, [(2, 0), (1, 0)]), "ts").first().sorted
    n = spark.createDataFrame([(0,), (1,), (2,), (3,), (1024,), (1025,)], "n long").select(rearrange.next_power_of_two(F.col("n")).alias("a"), rearrange.previous_power_of_two(F.col("n")).alias("b")).collect()
    assert [x.a for x in n] == [1, 1, 2, 4, 1024, 2048] and [x.b for x in n] == [0, 0, 1, 2, 512, 1024]


def test_deterministic_encryption(spark):
    one = spark.range(1)
    found = one.select(F.hex(crypto.encrypt_int(F.lit(1))).alias("a"), F.hex(crypto.encrypt_int(F.lit(2))).alias("b"), crypto.decrypt_int(crypto.encrypt_int(F.lit(4294967295))).alias("c"), crypto.encrypt_int(F.lit(None)).alias("d")).first()
    assert found.a == "13645E692D276A086BB34826588795ED" and found.b == "004B352D3BAF775BB8C4AAA5611FC29C"
    assert found.c == 4294967295 and found.d is None
    with pytest.raises(Exception, match="32-bit"):
        one.select(crypto.encrypt_int(F.lit(-1))).collect()
    assert one.select(F.hex(crypto.xor(F.unhex(F.lit("0FF0")), F.unhex(F.lit("FFFF")))).alias("x")).first().x == "F00F"


def test_scalars(spark):
    row = spark.range(1).select(scalar.time_code(F.lit(3_500_000_000)).alias("a"), scalar.time_code(F.lit(2048 * 10**9)).alias("b"), scalar.bucket(F.lit(29), 8).alias("c"), scalar.bucket(F.lit(29), 16, 1).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (3 * 2097152 + 500_000_000 * 2097152 // 999_999_999, None, 5, 6)
    with pytest.raises(ValueError):
        scalar.bucket(F.lit(1), 6)


def test_ranges_split_a_value_that_most_rows_share(spark):
    """One time for two thirds of the rows: they lie in several ranges, in the order of the second column."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1500).alias("ts"), ((F.col("id") * 7) % 3000).alias("pos"))
    at = position.range_of(rows, "ts", 8, "pos")
    counts = {x.r: x["count"] for x in rows.select(at.alias("r")).groupBy("r").count().collect()}
    assert max(counts.values()) < 700 and max(x["count"] for x in rows.select(position.range_of(rows, "ts", 8).alias("r")).groupBy("r").count().collect()) >= 2000
    placed = [(x.ts, x.pos) for x in position.with_pos(rows, ["ts", "pos"], at, name="place").orderBy("place").collect()]
    assert placed == sorted(placed)


def test_one_time_and_one_key_for_all_rows(spark):
    df = frame(spark, [(5, 1)] * 4000)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        assert [x.rank for x in keyed.ranked(df).orderBy("pos").collect()] == list(range(4000))
        found = keyed.successor(df)
        assert found.where("next_ts is null").count() == 1 and found.where("next_ts = 5").count() == 3999
        at = position.range_of(df, "ts", then="pos")
        assert df.select(at.alias("r")).groupBy("r").count().agg(F.max("count")).first()[0] < 1000
        left, right = position.merged_counts(df, df)
        assert {x.ns for x in left.collect()} == {4000} and {x.nr for x in right.collect()} == {0}
        assert fk.duplicate_keys(df, 64).count() == fk.duplicate_keys(df).count() == 3999
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_a_key_in_several_stretches_of_positions(spark):
    """Positions far apart: rings, gaps and last rows of a key do not end where a stretch does."""
    at = [0, 65_530, 65_535, 65_536, 65_539, 131_071, 131_072, 131_080, 400_000]
    df = spark.createDataFrame([(t, 1, 0, p) for t, p in enumerate(at)], "ts long, key long, payload long, pos long")
    assert {x.pos: x.in_ring for x in keyed.ring(df, 10).collect()} == {p: sum(p - 10 < q <= p for q in at) for p in at}
    assert sorted(x.pos for x in fk.duplicate_keys(df, 6).collect()) == [65_535, 65_536, 65_539, 131_072]
    assert sorted(x.pos for x in fk.require_unique(df, 6, "latest").collect()) == [0, 65_539, 131_072, 131_080, 400_000]
    assert [x.pos for x in fk.require_unique(df, duplicates="latest").collect()] == [400_000]


def test_a_count_of_positions_needs_neither_shuffle_nor_window_of_the_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    plan = position.with_pos(df, ["a", "b"]).groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_the_range_of_a_value_is_found_by_bisection(spark):
    rows = spark.createDataFrame([(None,), *[(x,) for x in range(-5, 40)]], "v int")
    for cuts in ([3], [0, 10, 20], list(range(0, 30, 2)), list(range(17))):
        known = F.array(*[F.lit(c) for c in cuts])
        found = rows.select("v", position._not_above(known, len(cuts), F.col("v")).alias("n")).collect()
        assert all(x.n == sum(c <= x.v for c in cuts) for x in found if x.v is not None)
    # Per row some log2 of the ranges, not all of them.
    df = spark.range(5000).withColumn("v", F.col("id") * 3)
    assert "filter(" not in df.select(position.range_of(df, "v", 100))._jdf.queryExecution().analyzed().toString()
    found = df.select("v", position.range_of(df, "v", 100).alias("n")).groupBy("n").agg(F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("n").collect()
    assert len(found) == 100 and max(x.rows for x in found) < 80 and all(a.hi < b.lo for a, b in zip(found, found[1:]))


def test_nothing_looks_for_a_range_after_the_rows_are_dealt(spark):
    """A filter on positions is pushed down to the window: what it names there is worked out once for each time that it is named."""
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("a"), F.col("id").alias("b"))
    placed = position.with_pos(df, ["a", "b"])
    plan = placed.where((F.col("pos") >= 64) & (F.col("pos") < 4000))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Window" in plan
    assert [x.pos for x in placed.where("pos >= 64").orderBy("a").collect()] == list(range(64, 5000))
    # Few distinct values of which one fills several ranges, and ranges whose numbers lie far apart.
    often = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1500).alias("ts"), ((F.col("id") * 7) % 3000).alias("pos"))
    found = position.ranges_of(often, "ts", 90, "pos")[0]
    same = found.put(often, "x").withColumn("y", position.range_of(often, "ts", 90, "pos"))
    assert all(x.x == x.y for x in same.collect())
    placed = [(x.ts, x.pos) for x in position.with_pos(often, ["ts", "pos"], found, name="place").orderBy("place").collect()]
    assert placed == sorted(placed)


def test_sums_of_merged_ranges_need_no_positions_of_a_stream_without_a_frequent_time(spark):
    """One time for all of R alone: only its positions are looked at before the result, S's are an error if they are."""
    r = spark.range(2000).select(F.lit(0).cast("long").alias("ts"), F.col("id").alias("key"), F.col("id").alias("payload"), F.col("id").alias("pos"))
    s = spark.range(2000).select((F.col("id") + 1).alias("ts"), F.col("id").alias("key"), F.col("id").alias("payload"), F.expr("if(id >= 0, raise_error('read'), id)").cast("long").alias("pos"))
    left, right = position.merged_counts(r, s)
    with pytest.raises(Exception, match="read"):
        right.collect()
    left, right = position.merged_counts(r, s.withColumn("pos", F.col("key")))
    assert {x.ns for x in left.collect()} == {0} and {x.nr for x in right.collect()} == {2000}


def test_a_filter_on_positions_is_not_pushed_into_the_steps_that_find_a_range(spark):
    """Where a row's offset could be null, such a filter asked of every row whether it is, in an expression of 3 ** steps parts."""
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    try:
        placed = position.with_pos(spark.range(3000).select((F.col("id") * 7 % 3000).alias("a"), F.col("id").alias("b")), ["a", "b"])
        plan = placed.where((F.col("pos") >= 64) & (F.col("pos") < 900))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CASE WHEN") < 20
        assert sorted(x.a for x in placed.where("pos >= 2990").collect()) == list(range(2990, 3000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_streams_of_few_times_are_merged_by_a_table_of_these(spark, monkeypatch):
    rng = np.random.default_rng(3)
    r, s = ([(None if t == 0 else int(t), int(k)) for t, k in zip(sorted(rng.integers(0, 6, n)), rng.integers(0, 9, n))] for n in (150, 260))
    a, b = frame(spark, r), frame(spark, s).withColumn("payload", F.col("payload").cast("string")).withColumn("key", F.col("key").cast("int"))
    before = lambda t, u: u is not None and (t is None or t < u)
    left, right, ends = position.merged(a, b)
    assert {x.pos: x.ns for x in left.collect()} == {i: sum(not before(t, u) for u, _ in s) for i, (t, _) in enumerate(r)}
    assert {x.pos: x.nr for x in right.collect()} == {i: sum(before(u, t) for u, _ in r) for i, (t, _) in enumerate(s)}
    assert ends == ({x.ns for x in left.collect()}, {x.nr for x in right.collect()})
    assert "Window" not in left._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(position, "MAX_TIMES", 0)
    by_ranges = position.merged(a, b)
    assert by_ranges[2] is None
    for x, y in zip((left, right), by_ranges[:2]):
        assert x.dtypes == y.dtypes and x.exceptAll(y).count() == y.exceptAll(x).count() == 0


def test_stable_compaction_by_positions_does_not_look_for_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(65_535, 0), (1, 1), (None, 1), (0, 0), (200_000, 0), (65_536, 1), (65_537, 1)], "pos long, v long")
    monkeypatch.setattr(rearrange, "ranges_of", None)
    found = [(x.pos, x.v == 0) for x in rearrange.compact_stable(df, F.col("v") == 0, ["pos"]).orderBy("place").collect()]
    assert found == [(p, True) for p in (0, 65_535, 200_000)] + [(p, False) for p in (None, 1, 65_536, 65_537)]


def test_listed_keys_take_their_positions_from_one_stream(spark, monkeypatch):
    from braidwin import queries

    made, whole = [], queries.customers
    monkeypatch.setattr(queries, "customers", lambda *at: made.append(1) or whole(*at))
    assert queries.ALL["generate_listed"][0](spark, "/root/testdata/sf0.001").first().strangers == 0 and made == [1]
