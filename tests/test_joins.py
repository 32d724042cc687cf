import numpy as np
import pytest
from helpers import frame, random_stream
from pyspark.sql import functions as F
from simulator import by_batch, eager

from braidwin.operators import fk, joins, padding

MODES = {"delta": joins.delta, "rect": joins.rect, "snapshot": joins.snapshot}


def pairs(df):
    return sorted((x.r_pos, x.s_pos) for x in df.collect())


def triples(df):
    return sorted((x.k, x.r_pos, x.s_pos) for x in df.collect())


CONFIGS = [
    # rows of R and S, keys, windows, batches: uneven, a partial last batch, one side ends early, windows of one row
    (60, 80, 5, (7, 11), (3, 4)),
    (20, 120, 3, (15, 9), (2, 10)),
    (90, 30, 8, (1, 1), (4, 1)),
    (50, 50, 2, (20, 20), (64, 7)),
]


@pytest.mark.parametrize("seed,config", list(enumerate(CONFIGS)))
def test_batch_joins_equal_a_step_by_step_run(spark, seed, config):
    nr, ns, keys, window, batch = config
    rng = np.random.default_rng(seed)
    r, s = random_stream(rng, nr, keys), random_stream(rng, ns, keys)
    found = {}
    for mode, join in MODES.items():
        found[mode] = triples(join(frame(spark, r), frame(spark, s), window, batch))
        assert found[mode] == sorted(by_batch(r, s, window, batch, mode)), mode
    assert set(found["delta"]) <= set(found["rect"]) <= set(found["snapshot"])
    assert len({x[1:] for x in found["delta"]}) == len(found["delta"])


@pytest.mark.parametrize("seed,config", list(enumerate(CONFIGS)))
@pytest.mark.parametrize("extra", [0, 1])
def test_eager_equals_a_step_by_step_run(spark, seed, config, extra):
    nr, ns, keys, window, _ = config
    rng = np.random.default_rng(100 + seed)
    r, s = random_stream(rng, nr, keys), random_stream(rng, ns, keys)
    prefill = (window[0] + extra, window[1] + extra)
    assert pairs(joins.eager(frame(spark, r), frame(spark, s), window, prefill)) == sorted(eager(r, s, window, prefill))


def test_full_windows_give_nothing(spark):
    r = frame(spark, [(i, 1) for i in range(5)])
    assert joins.delta(r, r, (5, 5), (2, 2)).count() == 0
    assert joins.snapshot(r, r, (5, 5), (2, 2)).count() == 0
    assert joins.eager(r, r, (5, 5)).count() == 0


def test_key_zero_joins_and_null_does_not(spark):
    r = frame(spark, [(0, 9), (1, 0), (2, None)])
    s = frame(spark, [(0, 9), (1, 0), (2, None)])
    assert pairs(joins.static(r, s)) == [(0, 0), (1, 1)]
    assert triples(joins.delta(r, s, (1, 1), (2, 2))) == [(0, 1, 1)]


def test_old_pairs_come_again_only_with_new_rows_on_both_sides(spark):
    r, s = frame(spark, [(0, 1), (1, 1)]), frame(spark, [(0, 1), (1, 1)])
    assert triples(joins.rect(r, s, (1, 1), (1, 1))) == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1)]
    assert triples(joins.delta(r, s, (1, 1), (1, 1))) == [(0, 0, 1), (0, 1, 0), (0, 1, 1)]


def test_extra_columns_and_bad_sizes(spark):
    r = frame(spark, [(0, 1), (1, 2)])
    with pytest.raises(ValueError):
        joins.delta(r, r, (1, 1), (0, 1))
    with pytest.raises(ValueError):
        joins.eager(r, r, (0, 1))


def test_fk_check_and_last_seen(spark):
    r = frame(spark, [(0, 1), (1, 2), (2, 1), (3, None), (4, None)])
    s = frame(spark, [(0, 1), (1, 3), (2, None)])
    with pytest.raises(ValueError, match="key 1"):
        fk.require_unique(r)
    assert fk.require_unique(r, within=2).count() == 5
    assert sorted(x.pos for x in fk.require_unique(r, duplicates="latest").where("key is not null").collect()) == [1, 2]
    assert pairs(fk.last_seen(r, s)) == [(2, 0)]
    with pytest.raises(ValueError):
        fk.require_unique(r, duplicates="first")


def test_latest_drops_a_row_only_for_one_within_reach(spark):
    r = frame(spark, [(0, 1), (1, 2), (2, 1), (3, 3), (4, 2), (5, 1)])
    kept = lambda within: sorted(x.pos for x in fk.require_unique(r, within, "latest").collect())
    assert kept(3) == [1, 2, 3, 4, 5] and kept(4) == [3, 4, 5] and kept(2) == [0, 1, 2, 3, 4, 5] and kept(None) == [3, 4, 5]


def test_padding(spark):
    rng = np.random.default_rng(5)
    r, s = frame(spark, [(i, i) for i in range(20)]), frame(spark, random_stream(rng, 30, 20, nulls=False))
    a, b = joins.sides(r, s, (8, 8), (4, 5))
    result = joins.delta(r, s, (8, 8), (4, 5))
    batches = max(a.batches, b.batches)
    from pyspark.sql import functions as F

    size = padding.merge_size(a, b, F.col("k"))
    padded = padding.pad(result, batches, size)
    assert triples(padding.trim(padded)) == triples(result)
    by_k = {x.k: x["count"] for x in padded.groupBy("k").count().collect()}
    assert by_k[0] == (8 + 5) + (8 + 4) + (4 + 5)
    assert by_k[4] == (8 + 2) + (8 + 0) + (0 + 2)
    empty = padding.pad(joins.delta(r, s, (20, 30), (4, 5)), 0, size)
    assert empty.count() == 0


def test_either_side_of_a_band_may_be_copied(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    r, s = frame(spark, random_stream(rng, 60, 3)), frame(spark, random_stream(rng, 70, 3))
    found = {c: pairs(joins.band(r, s, "r", "s", F.col("pos") - 7, F.col("pos") + 4, 11, c)) for c in ("probe", "build")}
    rr, ss = r.select("pos", "key").collect(), s.select("pos", "key").collect()
    assert found["probe"] == found["build"] == sorted((a.pos, b.pos) for a in rr for b in ss if a.key is not None and a.key == b.key and a.pos - 7 <= b.pos < a.pos + 4)


@pytest.mark.parametrize("seed,config", [(20, (40, 200, 6, (9, 5), (2, 3))), (21, (200, 40, 6, (5, 9), (1, 7))), (22, (30, 300, 4, (12, 12), (1, 1))), (23, (45, 44, 3, (30, 4), (16, 1)))])
def test_delta_is_one_join_whichever_stream_ends_first(spark, seed, config):
    nr, ns, keys, window, batch = config
    rng = np.random.default_rng(seed)
    r, s = random_stream(rng, nr, keys), random_stream(rng, ns, keys)
    found = joins.delta(frame(spark, r), frame(spark, s), window, batch)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert triples(found) == sorted(by_batch(r, s, window, batch, "delta"))


@pytest.mark.parametrize("most", [0, 30, 1 << 13])
def test_eager_with_few_times_equals_a_step_by_step_run(spark, monkeypatch, most):
    """Of some times' windows no row, some or all are sent to the tasks."""
    monkeypatch.setattr(joins, "MAX_SENT", most)
    rng = np.random.default_rng(7)
    for window, times in (((7, 30), 1), ((5, 9), 4), ((1, 40), 12)):
        r, s = ([(int(t), int(k)) for t, k in zip(sorted(rng.integers(0, times, n)), rng.integers(0, 6, n))] for n in (120, 200))
        for extra in (0, 1):
            prefill = (window[0] + extra, window[1] + extra)
            assert pairs(joins.eager(frame(spark, r), frame(spark, s), window, prefill)) == sorted(eager(r, s, window, prefill))


def test_only_the_windows_of_few_times_are_sent(spark):
    spans = lambda ends, least, window: sorted(x.pos for x in joins._reached(frame(spark, [(0, 0)] * 60), ends, least, window).collect())
    assert spans({0, 3, 20, 22}, 8, 4) == [*range(4, 8), *range(16, 22)]
    assert spans({2}, 1, 9) == [0, 1]
    assert joins._reached(frame(spark, [(0, 0)]), {10 ** 6}, 1, joins.MAX_SENT + 1) is None


def test_dummies_are_made_in_all_partitions(spark):
    """A row a batch is so little that an adaptive plan puts all in one partition: its dummies were one task's work."""
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        result = spark.range(40).select((F.col("id") % 10).alias("k"), F.col("id").alias("r_pos"))
        padded = padding.pad(result, 100, F.lit(500))
        made = padded.where("is_dummy").groupBy(F.spark_partition_id()).count().collect()
        assert len(made) > 30 and sum(x["count"] for x in made) == 100 * 500 - 40
        assert padding.trim(padded).count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_dummies_are_counted_without_the_rows_that_are_none(spark):
    result = spark.range(40).select((F.col("id") % 10).alias("k"), F.col("id").alias("r_pos"))
    counted = padding.count_dummies(padding.pad(result, 100, F.lit(500)))
    assert counted.first().dummies == 100 * 500 - 40 and counted.dtypes == [("dummies", "bigint")]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Range") == 2
    assert padding.count_dummies(padding.pad(result.where("k < 0"), 0, F.lit(500))).first().dummies == 0
