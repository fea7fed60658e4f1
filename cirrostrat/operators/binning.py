"""True hourly values from logger records: a record stands for the time before its stamp, and is shared out between bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.functions.times import floor_to, seconds

LABELS = {"start": 0.0, "middle": 0.5, "end": 1.0}


def pieces(df: DataFrame, ts: str, length: Column, width: int, start: int = 0) -> DataFrame:
    """Adds `bin`, `weight` and `most`: one row for each bin that a record covering (ts - length, ts] touches; weights are seconds. `most`
    holds in bins that it fills, and in the one with its largest part, the earliest of equal ones."""
    t = seconds(ts)
    first = (t - length - start) - F.pmod(t - length - start, F.lit(width)) + start
    last = F.greatest(first, F.ceil((t - start) / width) * width - width + start)
    parts = F.transform(F.sequence(first.cast("long"), last.cast("long"), F.lit(width).cast("long")), lambda b: F.struct(b.alias("bin"), (F.least(t, b + width) - F.greatest(t - length, b)).cast("long").alias("weight")))
    rows = df.withColumn("_parts", parts).withColumn("_weights", F.transform("_parts", lambda p: p["weight"]))
    rows = rows.withColumn("_best", F.array_position("_weights", F.array_max("_weights")) - 1)
    most = (F.col("_p.weight") == width) | (F.col("_k") == F.col("_best"))
    return rows.select(*df.columns, "_best", F.posexplode("_parts").alias("_k", "_p")).select(*df.columns, "_p.bin", "_p.weight", most.alias("most"))


def weighted_bins(df: DataFrame, keys: Sequence[str], ts: str, length: Column, *, ave: str = "ave", low: str = "min", high: str = "max", width: int = 3600, start: int = 0, label: str = "end") -> DataFrame:
    """keys, bin, ave, min, max. The mean weighs each record by its seconds in the bin (records without a value weigh nothing); the
    minimum and maximum of a record count in the bins that it fills and in the one that holds its largest part, the earliest of equal ones."""
    rows = df.withColumn("_len", length.cast("long"))
    shared = pieces(rows, ts, F.col("_len"), width, start)
    w = F.when(F.col(ave).isNotNull(), F.col("weight"))
    out = shared.groupBy(*keys, "bin").agg((F.sum(w * F.col(ave)) / F.sum(w)).alias("ave"), F.min(F.when(F.col("most"), F.col(low))).alias("min"), F.max(F.when(F.col("most"), F.col(high))).alias("max"))
    return out.withColumn("bin", (F.col("bin") + int(width * LABELS[label])).cast("long"))


def minute_weights(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """(keys, mark, length): the seconds of the hour at which records of a key come, and how long before it the mark before is."""
    marks = df.select(*keys, (seconds(ts) % 3600).alias("mark")).distinct()
    w = Window.partitionBy(*keys).orderBy("mark")
    last = F.max("mark").over(Window.partitionBy(*keys))
    return marks.withColumn("length", F.col("mark") - F.coalesce(F.lag("mark").over(w), last - 3600))


def hourly_by_marks(df: DataFrame, keys: Sequence[str], ts: str, *, ave: str = "ave", low: str = "min", high: str = "max", label: str = "end", centred: bool = False) -> DataFrame:
    """Hourly bins with record lengths from the usual marks in the hour; `centred` bins run from half past to half past."""
    met = df.withColumn("mark", seconds(ts) % 3600).join(minute_weights(df, keys, ts), [*keys, "mark"])
    return weighted_bins(met, keys, ts, F.col("length"), ave=ave, low=low, high=high, start=1800 if centred else 0, label="middle" if centred else label)


def trapezoid_hours(df: DataFrame, keys: Sequence[str], ts: str, value: str, centred: bool = False) -> DataFrame:
    """Hourly integral of the valid points over the time that they span; stamps first move back by half the smallest step. The label is the end of the
    hour, or its middle; hours with one point have no mean."""
    s = seconds(ts)
    w = Window.partitionBy(*keys).orderBy("_s")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, s.alias("_s"), F.col(value).alias("_v"))
    steps = rows.withColumn("_d", F.col("_s") - F.lag("_s").over(w)).groupBy(*keys).agg(F.min("_d").alias("_least"))
    moved = rows.join(steps, list(keys)).withColumn("_s", F.col("_s") - F.coalesce(F.col("_least"), F.lit(0)) / 2 - (F.lit(-1800) if centred else F.lit(0)))
    moved = moved.withColumn("_h", (F.col("_s") - F.pmod(F.col("_s"), F.lit(3600))).cast("long"))
    inside = Window.partitionBy(*keys, "_h").orderBy("_s")
    seg = moved.withColumn("_dt", F.col("_s") - F.lag("_s").over(inside)).withColumn("_a", (F.col("_v") + F.lag("_v").over(inside)) / 2 * F.col("_dt"))
    out = seg.groupBy(*keys, "_h").agg((F.sum("_a") / F.sum("_dt")).alias("ave"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    return out.select(*keys, (F.col("_h") + (0 if centred else 3600)).alias("bin"), "ave", "min", "max")


def hours_with_backfilled_length(df: DataFrame, keys: Sequence[str], ts: str, value: str, longest: int | None = None) -> DataFrame:
    """Hourly means whose record lengths are the steps from the record before, the first record taking that of the next (an hour, if there is
    none). A step over `longest` seconds, if given, is a gap: the record stands for that long only."""
    w = Window.partitionBy(*keys).orderBy(ts)
    step = seconds(ts) - F.lag(seconds(ts)).over(w)
    step = F.coalesce(step, F.lead(seconds(ts)).over(w) - seconds(ts), F.lit(3600))
    rows = df.withColumn("_step", step if longest is None else F.least(F.lit(longest), step))
    return weighted_bins(rows, keys, ts, F.col("_step"), ave=value, low=value, high=value).select(*keys, "bin", "ave")


def binned_hours(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Plain hourly mean by calendar hour."""
    return df.groupBy(*keys, floor_to(ts, 3600).alias("bin")).agg(F.avg(value).alias("ave"))
