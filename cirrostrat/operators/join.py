"""Joins of forecasts, observations, metadata and events in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions.physics import mixing_ratio
from cirrostrat.functions.times import nearest_hour, seconds
from cirrostrat.operators import scan


def align(forecasts: DataFrame, observations: DataFrame, keys: Sequence[str] = ("station",), valid: str = "valid", ts: str = "ts", value: str = "obs") -> DataFrame:
    """Each forecast row with the observation of its valid time, rounded to the hour; null where there is none. One observation serves
    every run that covers its hour. Long stations make hot keys; the hour is part of the key, so rows of a station spread."""
    seen = observations.select(*keys, seconds(ts).alias("_hour"), value)
    return forecasts.withColumn("_hour", nearest_hour(valid)).join(seen, [*keys, "_hour"], "left").drop("_hour")


def errors(aligned: DataFrame, model: str, obs: str, step: str = "step", accumulated: bool = False) -> DataFrame:
    """`error` = model - observation; the first step of an accumulated variable has none."""
    e = F.col(model) - F.col(obs)
    return aligned.withColumn("error", F.when(F.col(step) != 0, e) if accumulated else e)


def observed_mixing_ratio(rh: DataFrame, temp: DataFrame, pressure_kpa: DataFrame, keys: Sequence[str] = ("station", "ts")) -> DataFrame:
    """Mixing ratio where relative humidity, temperature (K) and pressure (kPa) were all read. Each table has columns keys and v."""
    three = rh.withColumnRenamed("v", "_rh").join(temp.withColumnRenamed("v", "_t"), list(keys)).join(pressure_kpa.withColumnRenamed("v", "_p"), list(keys))
    return three.select(*keys, mixing_ratio(F.col("_rh"), F.col("_t"), F.col("_p") * 1000).alias("w"))


def fill_over(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and columns of both; a new value wins, an old one fills its nulls."""
    values = list(dict.fromkeys(c for c in (*new.columns, *old.columns) if c not in keys))
    a = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys))
    b = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys))
    both = a.join(b, list(keys), "full_outer")
    pick = lambda c: F.coalesce(*(F.col(f"{p}{c}") for p, d in (("_n_", new), ("_o_", old)) if c in d.columns)).alias(c)
    return both.select(*keys, *map(pick, values))


def continued(old: DataFrame, new: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Old rows before the first new time of their key, then the new rows."""
    first = new.groupBy(*keys).agg(F.min(ts).alias("_first"))
    kept = old.join(first, list(keys), "left").filter(F.col("_first").isNull() | (F.col(ts) < F.col("_first"))).drop("_first")
    return kept.unionByName(new)


def merged_sensors(*tables: DataFrame) -> DataFrame:
    """One row per sensor: the widest span of times, and the lowest elevation, which mends signs that were lost."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    return union.groupBy("sensor").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("elev").alias("elev"))


def station_history(snapshots: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """Per station and column the value of the latest snapshot that has one."""
    return snapshots.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in columns))


def update_spans(sensors: DataFrame, stored: DataFrame, key: str, now: int, overlap: int = 86400, drop: int = 180 * 86400) -> DataFrame:
    """(key, from_s): where to read on: the last stored time less an overlap, or the sensor's first time. Sensors silent for `drop` seconds are left out."""
    met = sensors.join(stored.select(key, F.col("last").alias("_stored")), key, "left")
    silent = F.lit(now) - F.coalesce(F.col("_stored"), F.col("first")) >= drop
    return met.filter(~silent).select(key, F.coalesce(F.col("_stored") - overlap, F.col("first")).alias("from_s"))


def key_logic(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): `a`, `b` or `both`; nulls count nowhere."""
    x, y = a.select(key).dropna().distinct(), b.select(key).dropna().distinct()
    part = lambda d, side: d.withColumn("side", F.lit(side))
    return part(x.join(y, key, "left_anti"), "a").unionByName(part(y.join(x, key, "left_anti"), "b")).unionByName(part(x.join(y, key, "left_semi"), "both"))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str, right_ts: str | None = None, width: int = scan.MONTH) -> DataFrame:
    """Each left row with the last right value at or before its time, however old. Both sides go through one scan by key and span of time, so that
    nothing multiplies and a key with most of the rows is shared among tasks."""
    others = [c for c in left.columns if c not in (*keys,)]
    a = left.select(*keys, seconds(ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.struct(*others).alias("_row"))
    b = right.select(*keys, seconds(right_ts or ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    out = scan.held(scan.spans(a.unionByName(b), "_t", width), keys, ["_t", "_side"], {"_held": F.col("_v")}).filter("_side = 1")
    return out.select(*keys, "_row.*", F.col("_held").alias(value))


def nearest_before(left: DataFrame, runs: DataFrame, ts: str, start: str, within: int) -> DataFrame:
    """Each time with the nearest run start not after it, no more than `within` seconds old. Runs are put into buckets of that width."""
    b = runs.select(seconds(start).alias("_s")).distinct().withColumn("_b", F.expr(f"_s DIV {within}"))
    spots = left.withColumn("_t", seconds(ts)).withColumn("_b", F.explode(F.expr(f"array(_t DIV {within} - 1, _t DIV {within})")))
    met = spots.join(b, "_b").filter((F.col("_s") <= F.col("_t")) & (F.col("_t") - F.col("_s") <= within))
    found = met.groupBy(ts).agg(F.max("_s").alias("run"))
    return left.join(found, ts, "left")


def nearest_in_time(left: DataFrame, right: DataFrame, ts: str, right_ts: str, within: int) -> DataFrame:
    """Each time with the nearest right time within so many seconds; the earlier on a tie."""
    b = right.select(seconds(right_ts).alias("_s")).distinct().withColumn("_b", F.expr(f"_s DIV {within}"))
    spots = left.select(ts).distinct().withColumn("_t", seconds(ts)).withColumn("_b", F.explode(F.expr(f"sequence(_t DIV {within} - 1, _t DIV {within} + 1)")))
    near = spots.join(b, "_b").withColumn("_d", F.abs(F.col("_t") - F.col("_s"))).filter(F.col("_d") <= within)
    found = near.groupBy(ts).agg(F.min_by("_s", F.struct("_d", "_s")).alias("nearest"))
    return left.join(found, ts, "left")


def interval_sums(events: DataFrame, passes: DataFrame, keys: Sequence[str], ts: str, value: str, pass_ts: str, closed: str = "right", bucket: int = 86400) -> DataFrame:
    """Sums of events in the intervals between consecutive passes of a key: (start, end], or [start, end] with closed="both".
    Intervals are spread over the buckets of time that they touch, so that the join has an equality on key and bucket."""
    times = scan.spans(passes.select(*keys, seconds(pass_ts).alias("_a")).distinct(), "_a")
    spans = scan.beside(times, keys, ["_a"], after={"_e": F.col("_a")}).filter("_e IS NOT NULL").drop("_span")
    spread = spans.withColumn("_b", F.explode(F.expr(f"sequence(_a DIV {bucket}, _e DIV {bucket})")))
    rain = events.select(*keys, seconds(ts).alias("_t"), F.col(value).alias("_v")).withColumn("_b", F.expr(f"_t DIV {bucket}"))
    inside = (F.col("_t") <= F.col("_e")) & ((F.col("_t") >= F.col("_a")) if closed == "both" else (F.col("_t") > F.col("_a")))
    sums = spread.join(rain, [*keys, "_b"]).filter(inside).groupBy(*keys, "_a", "_e").agg(F.sum("_v").alias("total"), F.count("_v").alias("n"))
    return spans.join(sums, [*keys, "_a", "_e"], "left").select(*keys, F.col("_a").alias("start"), F.col("_e").alias("end"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def complete_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    return a.join(b, list(keys)).filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def lagged_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], ts: str, lags: Sequence[int], value: str = "v") -> DataFrame:
    """(keys, lag, x, y): the value of a, and that of b `lag` seconds earlier, for every lag."""
    moved = b.select(*keys, seconds(ts).alias("_t"), F.col(value).alias("y")).withColumn("lag", F.explode(F.array(*(F.lit(n).cast("long") for n in lags))))
    moved = moved.withColumn("_t", F.col("_t") + F.col("lag"))
    return a.select(*keys, seconds(ts).alias("_t"), F.col(value).alias("x")).join(moved, [*keys, "_t"]).select(*keys, F.col("_t").alias("s"), "lag", "x", "y")


def elevation_difference(df: DataFrame, stations: DataFrame, model_elev: Column, key: str = "station") -> DataFrame:
    """dz = model elevation - station elevation, from the small station table."""
    return df.join(stations.select(key, F.col("elev").alias("_z")), key).withColumn("dz", model_elev - F.col("_z")).drop("_z")


def lagged_ensemble(forecasts: DataFrame, observations: DataFrame, n: int) -> DataFrame:
    """Per station and valid time, all runs beside the observation: (station, valid, obs, runs, mean, spread, ages)."""
    age = F.pmod(F.floor(seconds("start") / 86400), F.lit(n)).cast("int")
    groups = forecasts.groupBy("station", "valid").agg(F.count("*").alias("runs"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("spread"), F.sort_array(F.collect_set(age)).alias("ages"))
    return groups.join(observations.select("station", F.col("h").alias("valid"), F.col("v").alias("obs")), ["station", "valid"], "left")
