"""Incremental and streaming forms: upserts, late corrections, running bins, sessions, a stateful check, restarts. A watermark starts at 1970, so
that streams take older readings as late; the batch forms (`fresh_readings`, `upsert`) take any time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cirrostrat.functions.times import nearest_hour, seconds
from cirrostrat.operators.binning import pieces
from cirrostrat.operators.join import fill_over


def unseen(stream: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Readings of a stream without repeats that come within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])


def fresh_readings(new: DataFrame, stored: DataFrame, keys: Sequence[str], ts: str, overlap: int = 86400) -> DataFrame:
    """New readings from a day before each key's high-water mark on; all of a key that isn't stored yet."""
    marks = stored.groupBy(*keys).agg(F.max(seconds(ts)).alias("_mark"))
    met = new.join(marks, list(keys), "left")
    return met.filter(F.col("_mark").isNull() | (seconds(ts) > F.col("_mark") - overlap)).drop("_mark")


def upsert(spark: SparkSession, batch: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Put a batch over the stored rows of the partitions that it touches; the others are neither read nor rewritten. Of readings with one
    key in a batch the last by `arrival` wins, where there is such a column; among equals the one of the largest hash. A partition is replaced as a whole,
    but not all partitions at once: readers may see some old and some new ones while it runs."""
    values = [c for c in batch.columns if c not in (*keys, "arrival")]
    at = ([F.col("arrival")] if "arrival" in batch.columns else []) + [F.xxhash64(*values)]
    # One row for each key, combined before the shuffle.
    batch = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*at)).alias("_v")).select(*keys, "_v.*")
    touched = [r[0] for r in batch.select(partition).distinct().collect()]  # values of the partition column, such as days
    if not touched:
        return
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # the store is new
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        batch.write.mode("overwrite").partitionBy(partition).parquet(path)
        return
    old = stored.filter(F.col(partition).isin(touched))
    from cirrostrat.runtime import stash

    merged = stash(fill_over(batch, old.select(*batch.columns), list(dict.fromkeys([*keys, partition]))), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def corrections(stream: DataFrame, path: str, keys: Sequence[str], partition: str, checkpoint: str) -> StreamingQuery:
    """A running query that upserts each micro-batch; a batch that is repeated after a failure gives the same store."""
    spark = stream.sparkSession
    write = lambda batch, _: upsert(spark, batch, path, keys, partition)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_bins(stream: DataFrame, keys: Sequence[str], ts: str, length: str, value: str, width: int = 3600, late: str = "2 hours") -> DataFrame:
    """Hourly interval-weighted means of a stream. The watermark must exceed a record's length and the bin's together, as a record may reach into
    the bin before."""
    shared = pieces(stream.withColumn("_ts", F.col(ts)), ts, F.col(length), width).withColumn("bin_ts", F.timestamp_seconds("bin"))
    w = F.when(F.col(value).isNotNull(), F.col("weight"))
    binned = shared.withWatermark("bin_ts", late).groupBy(*keys, F.window("bin_ts", f"{width} seconds").alias("w"))
    return binned.agg((F.sum(w * F.col(value)) / F.sum(w)).alias("ave")).select(*keys, F.col("w.end").alias("bin"), "ave")


def sliding_means(stream: DataFrame, keys: Sequence[str], ts: str, value: str, width: str = "7 days", every: str = "1 day", late: str = "1 day") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, every).alias("w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(*keys, F.col("w.end").alias("until"), "mean", "n")


def sessions(stream: DataFrame, keys: Sequence[str], ts: str, gap: str, late: str = "1 day") -> DataFrame:
    """Spans of readings without a gap of that length or more; the end is the last reading's time plus the gap. Spark joins sessions that only
    touch, so that its own windows are a microsecond, the grain of timestamps, shorter."""
    out = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, f"{gap} -1 microseconds").alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.expr("w.end + INTERVAL 1 MICROSECOND").alias("end"), "n")


def stateful_steps(stream: DataFrame, key: str, ts: str, value: str, minutes: int, late: str = "1 day") -> DataFrame:
    """(key, ts, change): differences from the last reading of the key, kept as state, if it is recent enough. Readings of a micro-batch are ordered
    first; one older than the state is passed over."""

    def steps(group: tuple, frames: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values([ts, value])
        out = []
        for at, v in zip(rows[ts], rows[value]):
            s = at.timestamp()
            if last is not None and s < last[0]:
                continue
            change = abs(v - last[1]) if last is not None and s - last[0] <= minutes * 60 else None
            out.append((group[0], at, change))
            last = (s, float(v))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[key, ts, "change"]).astype({"change": "float64"})

    kind = dict(stream.dtypes)[key]
    return stream.withWatermark(ts, late).groupBy(key).applyInPandasWithState(steps, f"{key} {kind}, {ts} timestamp, change double", "s double, v double", "append", "NoTimeout")


class _Watched(StatefulProcessor):
    """Of each sensor the time and value of its last reading, and a timer that ends when it has been silent for `silence` seconds."""

    def __init__(self, key: str, ts: str, value: str, minutes: int, silence: int) -> None:
        self.key, self.ts, self.value, self.minutes, self.silence = key, ts, value, minutes, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "s double, v double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # Each call of the handle is an exchange with the JVM, and there is one of these for each key and batch: state is asked for once, and the only timer
        # of a key is the one that its last reading set.
        last = before = self.last.get()
        for frame in rows:  # a piece of the batch at a time, whatever the key holds
            out = []
            frame = frame.sort_values([self.ts, self.value])
            for at, v in zip(frame[self.ts], frame[self.value]):
                s = at.timestamp()
                if last is not None and s < last[0]:
                    continue
                change = abs(v - last[1]) if last is not None and s - last[0] <= self.minutes * 60 else None
                out.append((key[0], at, "reading", change))
                last = (s, float(v))
            yield self._events(out)
        if last is not None:
            self.last.update(last)
            if before is None or self._due(before) != self._due(last):
                if before is not None:
                    self.handle.deleteTimer(self._due(before))
                self.handle.registerTimer(self._due(last))

    def _due(self, last: tuple) -> int:
        return int((last[0] + self.silence) * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        self.last.clear()
        yield self._events([(key[0], pd.Timestamp(last[0], unit="s"), "silent", None)])

    def close(self) -> None:
        pass

    def _events(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "ts", "event", "change"]).astype({"ts": "datetime64[ns]", "change": "float64"})


#: Timers need this store of state, by the setting `spark.sql.streaming.stateStore.providerClass`.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watched_steps(stream: DataFrame, key: str, ts: str, value: str, minutes: int, silence: int = 180 * 86400, late: str = "1 day") -> DataFrame:
    """(key, ts, event, change): the readings of a stream, each with the step from the key's last one if that is recent enough, and one row `silent` at the
    last reading of a key that has sent none for `silence` seconds of event time. A silent key leaves the state; its next reading begins anew.
    Readings older than the last of their key are passed over; those of a batch come in order if they arrive in one piece (10,000 rows). The session
    that starts the stream needs `ROCKS` as its store of state."""
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, ts, value).withWatermark(ts, late).groupBy(key)
    return rows.transformWithStateInPandas(_Watched(key, ts, value, minutes, silence), f"{key} {kind}, ts timestamp, event string, change double", "Append", "EventTime")


def validated(forecasts: DataFrame, observations: DataFrame, keys: Sequence[str], valid: str, ts: str, obs: str, late: str = "6 hours", apart: int = 1800) -> DataFrame:
    """Streams of forecasts and observations: each forecast with the observation of its hour, `validated` being false for those of which none came in
    time. An observation belongs to the hour that it is nearest to, half past to the next; of several the first to come counts. Both sides are kept
    as state until the watermark has passed what could still meet them."""
    f = forecasts.withWatermark(valid, late).withColumn("_hour", nearest_hour(valid))
    seen = observations.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(ts).alias("_ts"), F.col(obs).alias(obs), nearest_hour(ts).alias("_of"))
    o = seen.withWatermark("_ts", late).dropDuplicatesWithinWatermark([*(f"_{k}" for k in keys), "_of"])
    near = F.expr(f"_ts >= `{valid}` - INTERVAL {2 * apart} SECONDS AND _ts <= `{valid}` + INTERVAL {2 * apart} SECONDS")
    same = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_hour") == F.col("_of"), near]
    return f.join(o, same, "left_outer").withColumn("validated", F.col("_ts").isNotNull()).drop(*(f"_{k}" for k in keys), "_ts", "_of", "_hour")


def not_validated(forecasts: DataFrame, errors: DataFrame, start: str = "start") -> DataFrame:
    """Run starts of forecasts without errors, and which is the earliest."""
    left = forecasts.select(start).distinct().join(errors.select(start).distinct(), start, "left_anti")
    return left.join(F.broadcast(left.agg(F.min(start).alias("earliest"))))  # one row


def restarted(spark: SparkSession, runs: DataFrame, done_path: str, process: Callable[[DataFrame], DataFrame], start: str = "start") -> int:
    """Process the runs that no written part holds, and append the result; how many there were."""
    try:
        done = spark.read.parquet(done_path).select(start).distinct()
        left = runs.join(done, start, "left_anti")
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        left = runs
    n = left.select(start).distinct().count()
    if n:
        process(left).write.mode("append").parquet(done_path)
    return n
