import numpy as np
import pytest
from helpers import frame, random_stream
from simulator import by_batch, eager

from braidwin.operators import joins
from braidwin.streaming.batches import STREAM, BatchJoin, as_files, batches_a_trigger, read_result
from braidwin.streaming.eager import eager_stream


def files(spark, folder, triggers):
    """A file for each trigger, of (side, ts, key, payload, seq) rows."""
    import os
    import time

    for n, rows in enumerate(triggers):
        spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if not f.name.startswith("t"):
                f.rename(folder / f"t{n:04}.parquet")
        os.utime(folder / f"t{n:04}.parquet", (time.time() - 1000 + n,) * 2)
    return spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(str(folder))


def sliced(r, s, window, batch):
    rows = lambda side, data, lo, hi: [(side, t, k, i, i) for i, (t, k) in enumerate(data) if lo <= i < hi]
    out = [rows("R", r, 0, window[0]) + rows("S", s, 0, window[1])]
    i, j = window
    while i < len(r) or j < len(s):
        out.append(rows("R", r, i, i + batch[0]) + rows("S", s, j, j + batch[1]))
        i, j = i + batch[0], j + batch[1]
    return out


@pytest.mark.parametrize("mode", ["delta", "rect", "snapshot"])
def test_stream_equals_replay(spark, tmp_path, mode):
    rng = np.random.default_rng(3)
    r, s, window, batch = random_stream(rng, 26, 4), random_stream(rng, 40, 4), (6, 8), (5, 9)
    (tmp_path / "in").mkdir()
    stream = files(spark, tmp_path / "in", sliced(r, s, window, batch))
    join = BatchJoin(str(tmp_path / "out"), str(tmp_path / "state"), window, mode)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(join).trigger(availableNow=True).start().awaitTermination(120)
    found = sorted((x.k - 1, x.r_pos, x.s_pos) for x in read_result(spark, str(tmp_path / "out")).collect())
    assert found == sorted(by_batch(r, s, window, batch, mode))
    # A batch that is run again overwrites its own result and changes nothing else.
    again = spark.createDataFrame(sliced(r, s, window, batch)[2], STREAM)
    join(again, 2)
    assert sorted((x.k - 1, x.r_pos, x.s_pos) for x in read_result(spark, str(tmp_path / "out")).collect()) == found


def test_static_stream_is_a_plain_join_while_the_windows_hold_all(spark, tmp_path):
    rng = np.random.default_rng(4)
    r, s = random_stream(rng, 20, 4), random_stream(rng, 20, 4)
    join = BatchJoin(str(tmp_path / "out"), str(tmp_path / "state"), (100, 100), "static")
    for k in range(4):
        join(spark.createDataFrame([(side, t, key, i, i) for side, rows in (("R", r), ("S", s)) for i, (t, key) in enumerate(rows) if i // 5 == k], STREAM), k)
    found = sorted((x.r_pos, x.s_pos) for x in read_result(spark, str(tmp_path / "out")).collect())
    assert found == sorted((x.r_pos, x.s_pos) for x in joins.static(frame(spark, r), frame(spark, s)).collect())
    with pytest.raises(ValueError):
        BatchJoin("o", "s", (1, 1), "other")


def test_eager_stream_equals_replay(spark, tmp_path):
    rng = np.random.default_rng(5)
    window = (5, 7)
    r, s = random_stream(rng, 40, 4), random_stream(rng, 50, 4)
    # The prefill came before all other rows; times of the rest begin after it.
    late = max(r[window[0] - 1][0], s[window[1] - 1][0])
    r, s = ([(t if i < w else t + late, k) for i, (t, k) in enumerate(x)] for x, w in ((r, window[0]), (s, window[1])))
    rows = [("R", t, k, 100 + i, i) for i, (t, k) in enumerate(r)] + [("S", t, k, 100 + i, i) for i, (t, k) in enumerate(s)]
    first = [x for x in rows if x[4] < window[0 if x[0] == "R" else 1]]
    rest = sorted((x for x in rows if x not in first), key=lambda x: (x[1], x[0] == "R", x[4]))
    cut = [i for i in range(1, len(rest)) if rest[i][1] != rest[i - 1][1]]
    triggers = [first, rest[: cut[10]], rest[cut[10] : cut[25]], rest[cut[25] :]]
    (tmp_path / "in").mkdir()
    query = eager_stream(files(spark, tmp_path / "in", triggers), window).writeStream.format("memory").queryName("eager_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((x.r_pos, x.s_pos) for x in spark.table("eager_out").collect()) == sorted(eager(r, s, window))


@pytest.mark.parametrize("together", [1, 3])
def test_a_trigger_of_several_batches_equals_the_replay(spark, tmp_path, together):
    rng = np.random.default_rng(6)
    r, s, window, batch = random_stream(rng, 40, 4), random_stream(rng, 90, 4), (6, 8), (5, 9)
    cuts = [(window[0] + k * batch[0], window[1] + k * batch[1]) for k in range(0, 10, together)]
    stream = as_files(frame(spark, r), frame(spark, s), cuts, str(tmp_path / "in"))
    join = BatchJoin(str(tmp_path / "out"), str(tmp_path / "state"), window, "delta", batch)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(join).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len(cuts) + 1
    assert sorted((x.k, x.r_pos, x.s_pos) for x in read_result(spark, str(tmp_path / "out")).collect()) == sorted(by_batch(r, s, window, batch, "delta"))


def test_triggers_do_not_grow_with_the_batches():
    assert [batches_a_trigger(n, 500) for n in (1, 8, 9, 240, 2400, 10**6)] == [1, 1, 2, 30, 300, 1000]
    with pytest.raises(ValueError):
        BatchJoin("o", "s", (1, 1), "rect", (1, 1))
