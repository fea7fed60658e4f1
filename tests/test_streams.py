"""Streams that go on: several micro-batches, late readings, and queries that start again where they ended."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cirrostrat.streaming import incremental

HOUR = 3600


class Feed:
    """A folder that gets one file for each micro-batch, in order."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.files = spark, folder, schema, 0
        (folder / "in").mkdir()

    def add(self, *batches):
        names = [part.split()[0] for part in self.schema.split(", ")]
        for rows in batches:
            path = self.folder / "in" / f"{self.files}.parquet"
            pd.DataFrame(rows, columns=names).to_parquet(path, index=False)
            os.utime(path, (1_700_000_000 + self.files,) * 2)
            self.files += 1
        return self

    def stream(self):
        raw = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{self.folder}/in")
        return raw.withColumn("ts", F.timestamp_seconds("t"))

    def run(self, out):
        """Rows of the sink after all files so far; the same progress is used by every call."""
        sink, progress = f"file://{self.folder}/out", f"file://{self.folder}/progress"
        query = out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.schema(out.schema).parquet(sink)


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path, schema)


def test_bins_take_readings_that_are_late_but_not_too_late(feed):
    at = lambda hour, v: (hour * HOUR + 600, v)  # noqa: E731  (the record fills the first ten minutes of the hour)
    f = feed("t long, v double").add([at(1, 1.0), at(2, 4.0)], [at(3, 5.0), at(6, 7.0), at(2, 6.0)], [at(8, 2.0)], [at(1, 99.0)], [at(20, 1.0)])
    out = f.run(incremental.running_bins(f.stream().withColumns({"field": F.lit("a"), "len": F.lit(600).cast("long")}), ["field"], "ts", "len", "v"))
    got = {r.bin // HOUR: r.ave for r in out.select(F.col("bin").cast("long").alias("bin"), "ave").collect()}
    assert got == {2: 1.0, 3: 5.0, 4: 5.0, 7: 7.0, 9: 2.0}  # by the bin's end; 99 came after its bin was out, a batch after the watermark had passed


def test_steps_are_kept_as_state_over_batches_and_a_restart(feed):
    f = feed("sensor long, t long, v double").add([(1, 600, 3.0), (1, 0, 1.0), (2, 0, 4.0)], [(1, 1200, 2.0), (1, 300, 9.0)])
    steps = lambda: incremental.stateful_steps(f.stream().select("sensor", "ts", "v"), "sensor", "ts", "v", 60)
    f.run(steps())
    f.add([(1, 1800, 2.5)], [(1, 9000, 5.0), (2, 60, 1.0)])
    got = {(r.sensor, r.t): r.change for r in f.run(steps()).select("sensor", F.col("ts").cast("long").alias("t"), "change").collect()}
    assert got == {(1, 0): None, (1, 600): 2.0, (1, 1200): 1.0, (1, 1800): 0.5, (1, 9000): None, (2, 0): None, (2, 60): 3.0}


def test_sessions_grow_over_batches(feed):
    f = feed("sensor long, t long").add([(1, 0), (1, HOUR)], [(1, 3 * HOUR), (2, 10 * HOUR)], [(1, 9 * HOUR)], [(3, 300 * HOUR)])
    out = f.run(incremental.sessions(f.stream(), ["sensor"], "ts", "3 hours"))
    got = sorted((r.sensor, r.s // HOUR, r.e // HOUR, r.n) for r in out.select("sensor", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "n").collect())
    assert got == [(1, 0, 6, 3), (1, 9, 12, 1), (2, 10, 13, 1)]


def test_sessions_part_at_a_gap_of_exactly_their_length(feed):
    f = feed("sensor long, t long").add([(1, 0), (1, 3 * HOUR)], [(1, 6 * HOUR), (1, 9 * HOUR - 1)], [(3, 300 * HOUR)])
    out = f.run(incremental.sessions(f.stream(), ["sensor"], "ts", "3 hours"))
    got = sorted((r.s, r.e, r.n) for r in out.filter("sensor = 1").select(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "n").collect())
    assert got == [(0, 3 * HOUR, 1), (3 * HOUR, 6 * HOUR, 1), (6 * HOUR, 12 * HOUR - 1, 2)]


def test_sliding_means_over_batches(feed):
    day = 24 * HOUR
    f = feed("t long, v double").add([(0, 1.0)], [(day, 3.0)], [(HOUR, 2.0)], [(5 * day, 0.0)])
    out = f.run(incremental.sliding_means(f.stream().withColumn("field", F.lit("a")), ["field"], "ts", "v", "2 days", "1 day"))
    got = {r.u // day: (r.mean, r.n) for r in out.select(F.col("until").cast("long").alias("u"), "mean", "n").collect()}
    assert got == {1: (1.5, 2), 2: (2.0, 3), 3: (3.0, 1)}


def test_repeats_in_later_batches_are_passed_over(feed):
    f = feed("id long, t long").add([(1, 5), (1, 5)], [(2, 10), (1, 5)])
    out = lambda: incremental.unseen(f.stream(), ["id"])
    f.run(out())
    f.add([(2, 10), (3, 20)])
    assert sorted(r.id for r in f.run(out()).collect()) == [1, 2, 3]


def test_corrections_of_several_batches_reach_only_their_weeks(spark, feed, tmp_path):
    f = feed("id long, t long, v double, arrival long").add([(1, 0, 1.0, 0), (2, 0, 2.0, 0), (3, 7 * 86400, 3.0, 0)], [(2, 0, 2.5, 2), (2, 0, 2.4, 1), (4, 0, 4.0, 0)])
    store, progress = f"file://{tmp_path}/store", f"file://{tmp_path}/merged"
    run = lambda: incremental.corrections(f.stream().select("id", F.expr("t DIV 604800").alias("week"), "v", "arrival"), store, ["id"], "week", progress).awaitTermination()
    run()
    untouched = sorted(os.listdir(tmp_path / "store" / "week=1"))
    f.add([(4, 0, None, 3)], [(1, 0, 1.5, 4)])
    run()
    run()  # nothing new
    got = {r.id: r.v for r in spark.read.parquet(store).collect()}
    assert got == {1: 1.5, 2: 2.5, 3: 3.0, 4: 4.0}  # a null doesn't replace a value
    assert sorted(os.listdir(tmp_path / "store" / "week=1")) == untouched


def test_silent_sensors_leave_the_state(spark, feed):
    """Timers over several batches and a restart: a sensor that is silent for ten days gives one row, and begins anew when it comes back."""
    day, old = 24 * HOUR, 100 * 24 * HOUR
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, incremental.ROCKS)
    at = lambda *rows: [(k, old + t, v) for k, t, v in rows]
    f = feed("sensor long, t long, v double").add(at((1, 0, 1.0), (2, 0, 5.0), (1, 600, 2.0)), at((1, 5 * day, 4.0), (1, 5 * day + 1200, 7.0)))
    out = lambda: incremental.watched_steps(f.stream(), "sensor", "ts", "v", 60, 10 * day)
    events = lambda df: {(r.sensor, r.t - old, r.event, r.change) for r in df.select("sensor", F.col("ts").cast("long").alias("t"), "event", "change").collect()}
    first = events(f.run(out()))
    assert first == {(1, 0, "reading", None), (2, 0, "reading", None), (1, 600, "reading", 1.0), (1, 5 * day, "reading", None), (1, 5 * day + 1200, "reading", 3.0)}
    f.add(at((1, 14 * day, 8.0)), at((1, 14 * day + 600, 8.5)), at((3, 30 * day, 1.0)), at((2, 30 * day, 6.0)))
    got = events(f.run(out())) - first
    silent = {e[:2] for e in got if e[2] == "silent"}
    assert silent == {(1, 14 * day + 600), (2, 0)}
    assert {e for e in got if e[2] == "reading"} == {(1, 14 * day, "reading", None), (1, 14 * day + 600, "reading", 0.5), (3, 30 * day, "reading", None), (2, 30 * day, "reading", None)}
    spark.conf.set(store, before)


def test_forecasts_wait_for_their_observation(spark, tmp_path):
    """Late, missing and double observations over four batches: each forecast comes out once, with the first observation of its hour or as not validated."""
    feeds = {}
    for name, schema in (("f", "station long, t long, v double"), ("o", "station long, t long, obs double")):
        (tmp_path / name).mkdir()
        feeds[name] = Feed(spark, tmp_path / name, schema)
    hours = [1, 2, 3, 4, 6, 30, 31]
    feeds["f"].add([(1, h * HOUR, float(h)) for h in hours[:3]], [(1, h * HOUR, float(h)) for h in hours[3:5]], [(1, 30 * HOUR, 30.0)], [(1, 31 * HOUR, 31.0)], [(1, 60 * HOUR, 60.0)])
    feeds["o"].add([(1, HOUR + 100, 10.0)], [(1, 4 * HOUR - 200, 40.0), (1, 3 * HOUR, 30.0), (2, 2 * HOUR, 99.0)], [(1, HOUR + 200, 11.0), (1, 30 * HOUR, 300.0)], [(1, 31 * HOUR, 310.0)], [(1, 60 * HOUR, 600.0)])
    valid = feeds["f"].stream().withColumnRenamed("ts", "valid").drop("t")
    out = incremental.validated(valid, feeds["o"].stream(), ["station"], "valid", "ts", "obs")
    got = sorted((r.t // HOUR, r.v, r.obs, r.validated) for r in feeds["f"].run(out).select(F.col("valid").cast("long").alias("t"), "v", "obs", "validated").collect())
    want = {1: 10.0, 3: 30.0, 4: 40.0, 30: 300.0, 31: 310.0, 60: 600.0}
    assert got == [(h, float(h), want.get(h), h in want) for h in (*hours, 60)]


def test_silent_sensors_ask_for_their_state_once_a_batch():
    """Each call of the handle is an exchange with the JVM; timers were listed and all deleted for each key and batch."""
    calls = []

    class Handle:
        def __getattr__(self, name):
            return lambda *args: calls.append((name, *args))

    class State:
        kept = None

        def get(self):
            calls.append(("get",))
            return self.kept

        def update(self, value):
            calls.append(("update",))
            self.kept = value

    watch = incremental._Watched("sensor", "ts", "v", 60, HOUR)
    watch.handle, watch.last = Handle(), State()
    frame = pd.DataFrame({"ts": pd.to_datetime([600, 0], unit="s"), "v": [2.0, 1.0]})
    out = pd.concat(watch.handleInputRows((1,), iter([frame]), None))
    assert out["change"].fillna(-1).tolist() == [-1.0, 1.0] and calls == [("get",), ("update",), ("registerTimer", 4_200_000)]
    calls.clear()
    list(watch.handleInputRows((1,), iter([frame.assign(ts=frame["ts"] + pd.Timedelta(seconds=1200))]), None))
    assert calls == [("get",), ("update",), ("deleteTimer", 4_200_000), ("registerTimer", 5_400_000)]
