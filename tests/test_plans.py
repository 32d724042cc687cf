import json

import pytest
from helpers import frame
from pyspark.sql import functions as F

from braidwin.plans import metrics, registry
from braidwin.plans.config import DATASETS, JoinConfig
from braidwin.plans.sources import streams
from braidwin.sources import generators, tables


def pairs(df):
    return sorted((x.r_pos, x.s_pos) for x in df.collect())


@pytest.fixture(scope="module")
def pk_fk(spark):
    r = generators.unique_keys(spark, 64, rate=1000).cache()
    s = generators.foreign_keys(spark, 150, 64, rate=3000).cache()
    return r, s


def test_strategies_of_one_join_agree(spark, pk_fk):
    r, s = pk_fk
    base = JoinConfig(r_window=16, s_window=24, r_batch=4, s_batch=8, fk_join=True)
    at = lambda alg, **more: registry.run(r, s, JoinConfig(**{**base.__dict__, "alg": alg, **more}))
    eager = pairs(at("SHJ-L1"))
    for alg in ("SHJ-L2", "FK-MERG-L2"):
        assert pairs(at(alg)) == eager
    assert pairs(at("SHJ", no_sgx=True)) == pairs(at("SHJ-L0", no_sgx=True)) == pairs(at("anything", no_sgx=True)) == eager
    assert pairs(at("FK-MERG-L3")) == pairs(at("FK-SORT-L3")) == pairs(at("FK-SORT-L4")) == pairs(at("FK-MERG-L4"))
    assert pairs(at("SHJ-L3")) == pairs(at("SHJ-L4"))
    assert set(pairs(at("FK-MERG-L3"))) <= set(pairs(at("NFK-JOIN-L3")))
    assert set(pairs(at("FK-SORT-L2"))) <= set(pairs(at("NFK-JOIN-L2")))
    assert at("FK-EPHI-L2").count() > 0 and at("NLJ-L4").count() > 0


def test_padded_results(spark, pk_fk):
    r, s = pk_fk
    for alg in ("FK-MERG-L4", "FK-SORT-L4", "SHJ-L4", "NLJ-L4"):
        config = JoinConfig(alg=alg, r_window=16, s_window=24, r_batch=4, s_batch=8, fk_join=True)
        padded = registry.padded(r, s, config)
        row = metrics.measured(r, s, config).first()
        assert (padded.count(), padded.where("not is_dummy").count()) == (row.emitted, row.matches)
        assert row.emitted > row.matches and row.input_tuples == 64 - row_window(alg, 16, 4) + 150 - row_window(alg, 24, 8)


def row_window(alg, window, batch):
    return window + batch if alg == "SHJ-L4" else window


def test_refusals(spark, pk_fk):
    r, s = pk_fk
    for bad in (
        dict(alg="nonsense"), dict(alg="SHJ-L0"), dict(alg="FK-MERG-L2"), dict(alg="FK-MERG-L3", r_batch=1, s_batch=1), dict(alg="NFK-JOIN-L3"), dict(alg="FK-EPHI-L2", fk_join=True, r_window=4, s_window=4, r_batch=4, s_batch=4),
    ):
        with pytest.raises(ValueError):
            registry.run(r, s, JoinConfig(**{"r_window": 16, "s_window": 16} | bad))
    with pytest.raises(ValueError):
        JoinConfig(r_window=0)
    twice = frame(spark, [(i, i % 3) for i in range(40)])
    with pytest.raises(ValueError, match="more than once"):
        registry.run(twice, s, JoinConfig(alg="FK-MERG-L2", fk_join=True, r_window=8, s_window=8))
    assert registry.run(twice, None, JoinConfig(alg="SHJ-L1", self_join=True, r_window=8, s_window=8)).count() > 0


def test_settings_from_a_command_line():
    config = JoinConfig.from_args(["--alg", "FK-MERG-L3", "--dataset", "synth-2", "--r-window", "100", "--self-join", "--skew", "0.5"])
    assert (config.alg, config.s_rate, config.r_window, config.fk_join, config.self_join, config.skew) == ("FK-MERG-L3", 4096, 100, True, True, 0.5)
    assert set(DATASETS) == {"synth-1", "synth-2", "tpch-1"} and JoinConfig.from_args([]) == JoinConfig()
    with pytest.raises(SystemExit):
        JoinConfig.from_args(["--dataset", "none"])


def test_generators(spark):
    pk = [x.key for x in generators.unique_keys(spark, 500).orderBy("pos").collect()]
    assert sorted(pk) == list(range(1, 501)) and pk != sorted(pk)
    rows = generators.foreign_keys(spark, 250, 100).orderBy("pos").collect()
    keys = [x.key for x in rows]
    assert sorted(keys[:100]) == sorted(keys[100:200]) == list(range(1, 101)) and sorted(keys[200:]) == list(range(1, 51)) and keys[:100] != keys[100:200]
    assert all(a.ts <= b.ts for a, b in zip(rows[:-1], rows[1:], strict=True)) and all(x.payload == x.key for x in rows)
    gap = generators.uniform_keys(spark, 20000, 50, rate=1000).agg((F.max("ts") / F.count("*")).alias("gap"), F.min("key").alias("a"), F.max("key").alias("b")).first()
    assert abs(gap.gap - 1e6) < 3e4 and (gap.a, gap.b) == (1, 50)
    top = sorted((x["count"] for x in generators.zipf_keys(spark, 20000, 1000, 1.0).groupBy("key").count().collect()), reverse=True)
    assert abs(top[0] / 20000 - 1 / 7.485) < 0.02 and top[0] > 1.5 * top[1] > 1.5 * top[3]
    assert [x.key for x in generators.spread_keys(spark, 4, 100).orderBy("pos").collect()] == [1, 26, 51, 76]
    first = generators.uniform_keys(spark, 100, 7, seed=5).orderBy("pos").collect()
    assert first == generators.uniform_keys(spark, 100, 7, seed=5).repartition(3).orderBy("pos").collect()
    assert generators.unique_keys(spark, 0).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "keys").write_text("5\n7\nx\n0\n-3\n7\n\n")
    assert sorted(x.key for x in tables.read_keys(spark, str(tmp_path / "keys"), 100).collect()) == [5, 7, 7]
    stream = generators.uniform_keys(spark, 300, 40, rate=3)
    tables.write_dump(stream, str(tmp_path / "dump"))
    lines = [x for f in sorted((tmp_path / "dump").glob("part*")) for x in f.read_text().splitlines()]
    assert lines[0] == "#TS, KEY, VAL" and len([x for x in lines if x[0] != "#"]) == 300
    again = tables.read_dump(spark, str(tmp_path / "dump"))
    assert sorted(map(tuple, again.select("ts", "key", "payload").collect())) == sorted(map(tuple, stream.select("ts", "key", "payload").collect()))
    r, s = streams(spark, JoinConfig(alg="SHJ-L1", r_path=str(tmp_path / "keys"), s_size=20, r_size=20, skew=0.5))
    assert (r.count(), s.count()) == (3, 20)
    row = metrics.measured(stream, stream, JoinConfig(alg="SHJ-L1", r_window=16, s_window=16))
    tables.write_metrics(row, str(tmp_path / "figures"))
    tables.write_metrics(row, str(tmp_path / "figures"))
    assert spark.read.option("header", True).csv(str(tmp_path / "figures")).count() == 2


def test_command_line(spark, capsys, monkeypatch):
    from braidwin import __main__

    __main__.main(["--alg", "FK-MERG-L3", "--fk-join", "--r-size", "64", "--s-size", "128", "--r-window", "16", "--s-window", "16", "--r-batch", "4", "--s-batch", "8"])
    row = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert row["algorithm"] == "FK-MERG-L3" and row["matches"] > 0
