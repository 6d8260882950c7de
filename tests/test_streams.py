"""The endless source of batches, leases, and the table function."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import windows_udtf
from gridloom.streaming import batches, leases


def run(spark, frame, sink, at, once=True):
    q = frame.writeStream.format("parquet").option("checkpointLocation", at).option("path", sink)
    q = q.trigger(availableNow=True).start() if once else q.start()
    return q


def test_batches_are_the_same_in_two_runs_and_after_a_restart(spark, tmp_path):
    batches.register(spark)
    frames = spark.createDataFrame([(k, float(w)) for k, w in enumerate((1, 0, 5, 2.5, 100, 0.0004, 3))], "frame long, weight double")
    spans = batches.frame_spans(frames, "frame", "weight", cells=16)

    def rows(name, restart):
        sink, at = str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")
        for _ in range(2 if restart else 1):
            stream = spark.readStream.format("training_batches").option("seed", "7").option("draws", "40").option("part", "16").load()
            q = batches.batches_of(stream, spans, "frame", 16).writeStream.format("parquet").option("checkpointLocation", at).option("path", sink).start()
            import time

            end = time.time() + 60
            while time.time() < end and (q.lastProgress is None or q.lastProgress["batchId"] < (1 if not restart else 1)):
                time.sleep(0.2)
            q.stop()
        return sorted(map(tuple, spark.read.parquet(sink).collect()))

    one, two = rows("one", False), rows("two", True)
    assert len({r[0] for r in one}) >= 1 and len({r[0] for r in two}) >= 2
    for found in (one, two):
        whole = max(r[0] for r in found)
        assert [r[:2] for r in found] == [(b, d) for b in range(whole + 1) for d in range(40)]  # no batch twice, none left out
    both = min(len(one), len(two))
    assert one[:both] == two[:both]
    table = batches.batches_of(spark.read.format("training_batches").option("seed", "7").option("draws", "40").option("batches", "1").load(), spans, "frame", 16)
    assert sorted(map(tuple, table.collect())) == one[:40]
    assert {r[2] for r in one} <= {0, 2, 3, 4, 6}


def test_draws_go_by_weight(spark):
    batches.register(spark)
    frames = spark.createDataFrame([(k, float(k)) for k in range(5)], "frame long, weight double")
    table = batches.batches_of(spark.read.format("training_batches").option("draws", "5000").load(), batches.frame_spans(frames, "frame", "weight"), "frame")
    n = {r["frame"]: r["count"] for r in table.groupBy("frame").count().collect()}
    assert 0 not in n and all(abs(n[k] / 5000 - k / 10) < 0.03 for k in range(1, 5))


def test_no_entry_has_two_workers_and_none_is_lost():
    pick = random.Random(3)
    queue, held, ended, now = leases.Queue(lease=30), {}, set(), 0.0
    for k in range(40):
        queue.answer(now, "add", k, k % 5, None)
    for _ in range(4000):
        now += pick.random() * 4
        worker = f"w{pick.randrange(6)}"
        kind = pick.choice(["ask", "ask", "beat", "done", "nothing"])
        entry = next((e for e, w in held.items() if w == worker), pick.randrange(40))
        if kind == "nothing":
            continue
        for said, one, to in queue.answer(now, kind, entry if kind != "ask" else None, None, worker):
            if said == "granted":
                assert one not in held and one not in ended
                held[one] = to
            elif said == "lapsed":
                assert held.pop(one) == to
            elif said in ("completed", "error"):
                assert held.pop(one) == to
                ended.add(one)
            elif said == "refused":
                assert held.get(one) != to
    assert len(ended) + len(queue.entries) == 40 and len(ended) > 20


def test_hours_and_order():
    queue = leases.Queue(lease=10, hours=(20, 6))
    for k, p in ((5, 1), (3, 2), (4, 2)):
        queue.answer(0, "add", k, p, None)
    noon, night = 12 * 3600.0, 21 * 3600.0
    assert queue.answer(noon, "ask", None, None, "a") == [("none", None, "a")]
    assert queue.answer(night, "ask", None, None, "a") == [("granted", 3, "a")]
    assert queue.answer(night + 1, "ask", None, None, "b") == [("granted", 4, "b")]
    assert queue.answer(night + 5, "done", 4, None, "a") == [("refused", 4, "a")]
    assert queue.answer(night + 5, "beat", 3, None, "a") == [("extended", 3, "a")]
    assert queue.answer(night + 12, "ask", None, None, "c") == [("lapsed", 4, "b"), ("granted", 4, "c")]
    assert queue.answer(night + 12, "done", 4, None, "b") == [("refused", 4, "b")]


def test_stream_grants_once_and_returns_lapsed_entries(spark, tmp_path):
    path, sink, at = (str(tmp_path / x) for x in ("messages", "answers", "checkpoint"))
    t = lambda s: f"2024-01-01 00:00:{s:02d}" if s < 60 else f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    steps = [
        [("r", t(0), "add", 1, 5, None), ("r", t(0), "add", 2, 9, None), ("r", t(1), "ask", None, None, "a"), ("r", t(2), "ask", None, None, "b"), ("r", t(3), "ask", None, None, "c"), ("s", t(3), "ask", None, None, "c")],
        [("r", t(10), "done", 2, None, "a"), ("s", t(200), "add", 8, 1, None)],  # b is lost: its lease ends at 32
        [("s", t(201), "ask", None, None, "d")],  # the watermark passes 32, a timer lapses b's lease
        [("r", t(210), "ask", None, None, "c")],
    ]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, "run_name string, ts string, kind string, id long, priority int, worker string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
        stream = leases.grants(spark.readStream.schema(leases.MESSAGES).parquet(path), lease=30, late="1 second")
        run(spark, stream, sink, at).awaitTermination(120)
    got = sorted((r["run_name"], r["kind"], r["id"], r["worker"]) for r in spark.read.parquet(sink).collect())
    want = [("r", "granted", 2, "a"), ("r", "granted", 1, "b"), ("r", "none", None, "c"), ("s", "none", None, "c"), ("r", "completed", 2, "a"), ("r", "lapsed", 1, "b"), ("s", "granted", 8, "d"), ("r", "granted", 1, "c")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_table_function(spark):
    windows_udtf.register(spark)
    ring = [[1.0 if 0 < y < 6 and 0 < x < 6 and not (y == 3 and x == 3) else 0.0 for x in range(8)] for y in range(8)]
    spark.createDataFrame([("a", sum(ring, [])), ("b", None), ("c", [0.0] * 64), ("d", [1.0] * 9)], "name string, tile array<double>").createOrReplaceTempView("own_windows")
    out = spark.sql("select * from window_polygons(table(own_windows), key => 'name', tile => 'tile', threshold => 0.5)")
    assert out.columns == ["name", "label", "area", "rings"]
    rows = {r["name"]: r for r in out.collect()}
    assert set(rows) == {"a", "d"} and rows["a"]["area"] == 24 and rows["a"]["label"] == 10
    assert [[(p["x"], p["y"]) for p in ring] for ring in rows["a"]["rings"]] == [[(1, 1), (6, 1), (6, 6), (1, 6), (1, 1)], [(3, 4), (4, 4), (4, 3), (3, 3), (3, 4)]] or len(rows["a"]["rings"]) == 2
    assert len(rows["d"]["rings"]) == 1 and rows["d"]["area"] == 9
    with pytest.raises(Exception, match="no column"):
        spark.sql("select * from window_polygons(table(own_windows), key => 'nothing', tile => 'tile', threshold => 0.5)")
