from __future__ import annotations

from datetime import datetime, timedelta

from bibspark.streaming import events as ev

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_debounce(spark):
    rows = spark.createDataFrame([("a", at(0)), ("a", at(9)), ("a", at(30)), ("b", at(5))], "lib string, ts timestamp")
    got = sorted((r.lib, r.n, (r.last - r["first"]).seconds) for r in ev.debounced(rows, "lib").collect())
    assert got == [("a", 1, 0), ("a", 2, 9), ("b", 1, 0)]


def test_debounce_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", at(0)), ("a", at(9)), ("a", at(30)), ("z", at(1000))], "lib string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    q = ev.debounced(stream, "lib").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.lib, r.n) for r in spark.table("bursts").collect()) == [("a", 1), ("a", 2)]


def test_coalesce(spark):
    rows = spark.createDataFrame([("x", 1, "old"), ("y", 2, "y"), ("x", 3, "new"), ("", 4, "p"), ("", 5, "q")], "k string, seq long, data string")
    assert sorted(map(tuple, ev.coalesced(rows, "k").collect())) == [("", 4, "p"), ("", 5, "q"), ("x", 1, "new"), ("y", 2, "y")]


def test_queue(spark):
    rows = spark.createDataFrame([(7, 1, False), (8, 2, False), (7, 3, True)], "lib long, seq long, force boolean")
    assert sorted(map(tuple, ev.queued(rows, "lib").collect())) == [(7, 1, True), (8, 2, False)]


def test_throttle(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 100, 249, 250, 400, 501, 800)] + [("b", 5)], "k string, ms long")
    assert sorted(map(tuple, ev.throttled(rows, "k").collect())) == [("a", 0), ("a", 250), ("a", 501), ("a", 800), ("b", 5)]


def test_throttle_at_once_flush_and_many_keys(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", rng.randrange(40_000), rng.random() < 0.02) for i in range(3000)]
    events = spark.createDataFrame(rows, "k string, ms long, total boolean")
    for every in (1, 250, 5000):
        want = []
        for k in ("a", "b", None, "hot"):
            last, own = None, sorted((t, u) for x, t, u in rows if x == k)
            for t, u in own:
                if last is None or u or t >= last + every:
                    want.append((k, t))
                    last = t
            if own[-1][0] != last:
                want.append((k, own[-1][0]))
        got = [tuple(r) for r in ev.throttled(events, "k", every=every, at_once="total", flush=True).collect()]
        assert sorted(set(got), key=str) == sorted(set(want), key=str)
    assert ev.throttled(events.limit(0), "k").count() == 0


def test_watch_sees_new_folders(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "1.fb2").write_text("x")
    start = lambda: ev.watched(spark, f"file://{tmp_path}/in", glob="*.fb2").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    seen = lambda: sorted(r.path.rpartition("/in/")[2] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    start()
    assert seen() == ["a/1.fb2"]
    (tmp_path / "in" / "b" / "c").mkdir(parents=True)
    (tmp_path / "in" / "b" / "c" / "2.fb2").write_text("xy")
    (tmp_path / "in" / "b" / "note.txt").write_text("x")
    start()
    assert seen() == ["a/1.fb2", "b/c/2.fb2"]


def test_serve_one_at_a_time(spark):
    rows = spark.createDataFrame([("x", 3, 5), ("y", 1, 2), ("z", 9, 1)], "lib string, place long, seconds long")
    assert sorted((r.lib, r.start, r.end) for r in ev.served(rows).collect()) == [("x", 2, 7), ("y", 0, 2), ("z", 7, 8)]


def test_throttle_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", t) for t in (0, 100, 249, 250, 400, 501, 800)] + [("b", 5)], "k string, ms long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ev.throttled_stream(stream, "k").writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("throttled").collect())) == [("a", 0), ("a", 250), ("a", 501), ("a", 800), ("b", 5)]


def test_intervals(spark):
    jobs = lambda rows: spark.createDataFrame(rows, "library_id long, every int")
    got = sorted(map(tuple, ev.interval_changes(jobs([(1, 60), (2, 120), (4, 5)]), jobs([(2, 60), (3, 60), (4, 5)])).collect()))
    assert got == [(1, "add"), (2, "replace"), (3, "remove")]
