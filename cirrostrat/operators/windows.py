"""Windows over time series: gaps, steps, filters, anomalies, extremes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrostrat.functions.times import floor_to, seconds
from cirrostrat.operators import scan
from cirrostrat.operators.aggregate import modal_step
from cirrostrat.runtime import stash


def _chunks(df: DataFrame, ts: str, reach: int) -> DataFrame:
    """Rows with `_chunk`, a span of 30 days or 16 times `reach` seconds, whichever is longer. Rows of the last `reach` seconds of a span stand in the
    next one as well, not `_own` there: a window that looks back no further can so be partitioned by time too, and a long series isn't one task."""
    width, s = max(30 * 86400, 16 * reach), seconds(ts)
    span = F.floor(s / width)
    both = F.when(s >= (span + 1) * width - reach, F.array(span, span + 1)).otherwise(F.array(span))
    return df.withColumn("_chunk", F.explode(both)).withColumn("_own", F.col("_chunk").eqNullSafe(span))


def islands(df: DataFrame, keys: Sequence[str], ts: str, flag: Column) -> DataFrame:
    """(keys, start, end, length) of runs of rows for which `flag` holds."""
    marked = scan.spans(df.withColumn("_f", F.coalesce(flag, F.lit(False))), ts)
    runs = scan.numbered(marked, keys, [ts], "_run", F.col("_f"), lambda a, b: a != b).filter("_f")
    return runs.groupBy(*keys, "_run").agg(F.min(seconds(ts)).alias("start"), F.max(seconds(ts)).alias("end"), F.count("*").alias("length")).drop("_run")


def irregular(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows whose steps before and after both differ from the usual one, with the number of adjacent ones; 1 is a lonely row."""
    s = seconds(ts)
    steps = scan.beside(scan.spans(df, ts), keys, [ts], {"_b": s}, {"_a": s}).withColumn("_b", s - F.col("_b")).withColumn("_a", F.col("_a") - s)
    odd = steps.join(modal_step(df, keys, ts), list(keys)).withColumn("_f", F.coalesce(F.expr("_b <> step AND _a <> step"), F.lit(False)))
    odd = scan.numbered(odd, keys, [ts], "_run", F.col("_f"), lambda a, b: a != b).filter("_f").drop("_b", "_a", "_f", "step", "_span")
    return odd.join(odd.groupBy(*keys, "_run").agg(F.count("*").alias("together")), [*keys, "_run"]).select(*df.columns, "together")


def step_changes(df: DataFrame, keys: Sequence[str], ts: str, low: str, high: str, minutes: int, ties: Sequence[str] = ()) -> DataFrame:
    """`change`: the largest difference of a record's and the last one's extremes, if that is recent enough. Records of one time are ordered by
    `ties`; without it any order may come out."""
    w = Window.partitionBy(*keys, "_chunk").orderBy(ts, *ties)
    s = seconds(ts)
    change = F.greatest(F.abs(F.lag(high).over(w) - F.col(low)), F.abs(F.col(high) - F.lag(low).over(w)))
    steps = _chunks(df, ts, minutes * 60).withColumn("change", F.when(s - F.lag(s).over(w) <= minutes * 60, change))
    return steps.filter("_own").drop("_chunk", "_own")


def out_of_range(df: DataFrame, limits: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`flag` where a value is under range_min or over range_max of its key."""
    return df.join(limits, list(keys), "left").withColumn("flag", (F.col(value) < F.col("range_min")) | (F.col(value) > F.col("range_max"))).drop("range_min", "range_max")


def persistence(df: DataFrame, keys: Sequence[str], ts: str, value: str, least_std: float, records: int = 24, least_spread: float = 0.0) -> DataFrame:
    """Days that hardly vary: `flat` for a low deviation over many records or none at all, `narrow` for a small (max - min) / std."""
    day = df.groupBy(*keys, floor_to(ts, 86400).alias("day")).agg(F.stddev_samp(value).alias("std"), F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("_r"))
    flat = ((F.col("std") < least_std) & (F.col("n") > records)) | (F.col("std") == 0)
    return day.withColumn("flat", F.coalesce(flat, F.lit(False))).withColumn("narrow", F.coalesce(F.try_divide(F.col("_r"), F.col("std")) < least_spread, F.lit(False))).drop("_r")


def amounts(df: DataFrame, keys: Sequence[str], ts: str, total: str, resets_to_zero: bool = False) -> DataFrame:
    """`amount` from an accumulated total: differences, the first as it is; negative ones null (or 0)."""
    x = scan.beside(scan.spans(df, ts), keys, [ts], {"_b": F.col(total), "_some": F.lit(True)})
    d = F.col(total) - F.col("_b")
    return x.withColumn("amount", F.when(F.col("_some").isNull(), F.col(total)).when(d < 0, F.lit(0.0) if resets_to_zero else F.lit(None)).otherwise(d)).drop("_b", "_some", "_span")


def without_spikes(df: DataFrame, keys: Sequence[str], ts: str, total: str) -> DataFrame:
    """An accumulated series without rows that go up by some amount and down again by the same."""
    x = scan.beside(scan.spans(df, ts), keys, [ts], {"_b": F.col(total)}, {"_a": F.col(total)})
    up, down = F.col(total) - F.col("_b"), F.col("_a") - F.col(total)
    return x.filter(~F.coalesce((up > 0) & (up == -down), F.lit(False))).drop("_b", "_a", "_span")


def breaks(df: DataFrame, keys: Sequence[str], ts: str, longest: int = 86400) -> DataFrame:
    """Longest gap in seconds, number of gaps over `longest`, and the start of what follows the last of these."""
    s = seconds(ts)
    gaps = scan.beside(scan.spans(df, ts), keys, [ts], {"_b": s}).withColumn("_g", s - F.col("_b"))
    return gaps.groupBy(*keys).agg(F.max("_g").alias("longest"), F.count(F.when(F.col("_g") > longest, 1)).alias("gaps"), F.max(F.when(F.col("_g") > longest, s)).alias("resumed"))


def interval_segments(df: DataFrame, keys: Sequence[str], ts: str, least: int = 3, width: int = scan.MONTH) -> DataFrame:
    """Per row its `interval` (the smaller of the steps before and after) and `segment`. Runs of fewer than `least` rows of one interval
    take the interval of the long run before them (of the one after at the start), and a segment begins where the interval then changes.

    Rows are numbered by runs, and the rest is work on runs, of which there are fewer."""
    s, change = seconds(ts), lambda a, b: a != b
    x = scan.beside(scan.spans(df, ts, width), keys, [ts], {"_b": s}, {"_a": s})
    x = x.withColumn("_i", F.least(s - F.col("_b"), F.col("_a") - s)).drop("_b", "_a")
    rows = stash(scan.numbered(x, keys, [ts], "_run", F.col("_i"), change).drop("_span"), "runs")
    # A run begins where the interval changes; one without an interval is that of a single row.
    runs = rows.groupBy(*keys, "_run").agg(F.max("_i").alias("_i"), F.count("*").alias("_n"))
    runs = scan.spans(runs.withColumn("_long", F.when(F.col("_n") >= least, F.col("_i"))), "_run", 100_000)
    runs = scan.held(runs, keys, ["_run"], {"_last": F.col("_long")})
    runs = stash(scan.held(runs, keys, ["_run"], {"_next": F.col("_long")}, forward=False).withColumn("interval", F.coalesce("_last", "_next", "_i")), "runs")
    runs = scan.numbered(runs, keys, ["_run"], "segment", F.col("interval"), change).select(*keys, "_run", "interval", "segment")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate((*keys, "_run"))]
    return rows.join(runs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "_run"))), "interval", "segment"), same).select(*df.columns, "interval", "segment")


def backward_pieces(df: DataFrame, order: str, ts: str, keys: Sequence[str] = (), width: int = 100_000) -> DataFrame:
    """`piece`: a new one begins where time doesn't go forward in file order. Spans are of `width` numbers of that order."""
    return scan.numbered(scan.spans(df, order, width), keys, [order], "piece", seconds(ts), lambda a, b: b <= a).drop("_span")


def regular(df: DataFrame, keys: Sequence[str], ts: str, step: int, value: str, interpolate: bool = False, width: int = scan.MONTH) -> DataFrame:
    """A row for every step between the first and last time of a key, times in seconds; gaps are null or filled in by straight lines.
    The steps are made span by span, and a gap of any length is bridged by the values before and behind it."""
    rows = df.select(*keys, floor_to(ts, step).alias("s"), value)
    wide = -(-width // step) * step
    ends = rows.groupBy(*keys).agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"))
    parts = ends.withColumn("_from", F.explode(F.sequence("_lo", "_hi", F.lit(wide).cast("long"))))
    last = F.least(F.col("_from") + wide - step, F.col("_hi"))
    spine = parts.select(*keys, F.explode(F.sequence("_from", last, F.lit(step).cast("long"))).alias("s"))
    out = spine.join(rows, [*keys, "s"], "left")
    if not interpolate:
        return out
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("s").alias("t"), F.col(value).alias("v")))
    x = scan.held(scan.spans(out, "s", wide), keys, ["s"], {"_0": known})
    x = scan.held(x, keys, ["s"], {"_1": known}, forward=False)
    a, b = F.col("_0"), F.col("_1")
    return x.withColumn(value, F.coalesce(F.col(value), a["v"] + (b["v"] - a["v"]) * (F.col("s") - a["t"]) / (b["t"] - a["t"]))).drop("_0", "_1", "_span")


def filled(df: DataFrame, keys: Sequence[str], ts: str, value: str, forward: bool = True, width: int = scan.MONTH) -> DataFrame:
    """The last value that is not null in place of nulls, however far back it stands; or the next one."""
    return scan.held(scan.spans(df, ts, width), keys, [ts], {value: F.col(value)}, forward).drop("_span")


def rolling_mean(df: DataFrame, keys: Sequence[str], ts: str, value: str, width: int, out: str) -> DataFrame:
    """Mean over the last `width` seconds, the present one included: (t - width, t]."""
    w = Window.partitionBy(*keys, "_chunk").orderBy(seconds(ts)).rangeBetween(-(width - 1), 0)
    return _chunks(df, ts, width - 1).withColumn(out, F.avg(value).over(w)).filter("_own").drop("_chunk", "_own")


def lanczos_weights(period: int, a: int = 3) -> list[float]:
    """Weights of a low-pass filter that cuts at `period` samples: period * a + 1 taps."""
    n = period * a + 1
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    xs = [-a + 2 * a * i / (n - 1) for i in range(n)]
    return [sinc(x) * sinc(x / a) for x in xs]


def ricker_weights(width: int, reach: int = 5) -> list[float]:
    norm = 2 / (math.sqrt(3 * width) * math.pi**0.25)
    return [norm * (1 - (x / width) ** 2) * math.exp(-((x / width) ** 2) / 2) for x in range(-reach * width, reach * width + 1)]


def fir(df: DataFrame, keys: Sequence[str], index: str, value: str, kernels: dict[str, list[float]], renormalise: bool = True, chunk: int = 8192) -> DataFrame:
    """(keys, index, kernel, filtered): centred filters of an evenly spaced series. `index` counts samples. Null and missing samples
    take no part, and what is left is divided by the sum of its weights, so that edges are handled too. Samples at one index add up.

    A series is cut into chunks of many samples that overlap by the reach of the kernels, so that a row moves once (twice near a cut)
    however many taps there are, and a long series is shared among tasks."""
    reach = max(map(len, kernels.values()))
    size = max(chunk, 4 * reach)
    at = F.col(index)
    spread = df.filter(at.isNotNull()).select(*keys, at.cast("long").alias("_i"), F.col(value).cast("double").alias("_v"))
    near = F.sequence(F.floor((F.col("_i") - reach) / size), F.floor((F.col("_i") + reach) / size))
    spread = spread.withColumn("_chunk", F.explode(near))
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*(fields[k] for k in keys), T.StructField("_i", T.LongType()), T.StructField("kernel", T.StringType()), T.StructField("filtered", T.DoubleType())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        *group, number = key
        first = number.as_py() * size
        i = rows.column("_i").to_numpy() - (first - reach)
        here = rows.column("_v").is_valid().to_numpy()
        v = rows.column("_v").fill_null(0.0).to_numpy()
        width = size + 2 * reach
        sums, counts = (np.bincount(i[here], x, width) for x in (v[here], np.ones(here.sum())))
        wanted = np.unique(i) - reach
        wanted = wanted[(wanted >= 0) & (wanted < size)]
        out = []
        for name, weights in kernels.items():
            left = reach - len(weights) // 2
            of = lambda x, w: np.correlate(x[left : left + size + len(w) - 1], w, "valid")[wanted]
            w = np.array(weights, float)
            filtered, reached = of(sums, w), of(counts, np.ones(len(w))) > 0.5
            if renormalise:
                total = of(counts, w)
                reached_sum = total != 0
                filtered = np.divide(filtered, total, out=np.zeros(len(total)), where=reached_sum)
            k, n = wanted[reached], int(reached.sum())
            values = pa.array(filtered[reached], mask=~reached_sum[reached] if renormalise else None)
            out.append(pa.Table.from_arrays([*(pa.repeat(g, n) for g in group), pa.array(k + first), pa.array([name] * n, pa.string()), values], names=schema.names))
        return pa.concat_tables(out)

    filtered = spread.groupBy(*keys, "_chunk").applyInArrow(run, schema)
    return filtered.select(*keys, F.col("_i").cast(fields[index].dataType).alias(index), "kernel", "filtered")


def local_extrema(df: DataFrame, keys: Sequence[str], ts: str, value: str, order: int, minima: bool = True) -> DataFrame:
    """Rows strictly below (or above) their `order` neighbours on each side; the first and last rows are none."""
    w = scan.inside(keys, ts)
    best = F.min if minima else F.max
    before, after = best(value).over(w.rowsBetween(-order, -1)), best(value).over(w.rowsBetween(1, order))
    v = F.col(value)
    hit = (v < before) & (v < after) if minima else (v > before) & (v > after)
    return scan.near(scan.spans(df, ts), keys, [ts], order).withColumn("_hit", hit).filter("_hit AND _own").select(*df.columns)


def rolling_peak_times(df: DataFrame, keys: Sequence[str], ts: str, value: str, rows: int = 10) -> DataFrame:
    """Distinct times at which the largest of the last `rows` values stood; only full windows count."""
    w = scan.inside(keys, ts).rowsBetween(-(rows - 1), 0)
    peak = F.max_by(seconds(ts), F.struct(F.col(value), -seconds(ts))).over(w)
    return scan.near(scan.spans(df, ts), keys, [ts], rows).withColumn("peak", peak).filter((F.col("_n") >= rows) & F.col("_own")).select(*keys, "peak").distinct()


def anomaly(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values less the mean of their key. Means are summed before they are shuffled, and joined back."""
    means = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.avg(value).alias("_m"))
    met = df.join(means, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return met.withColumn(value, F.col(value) - F.col("_m")).select(*df.columns)


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A natural cubic spline through (x, y), straight beyond the ends."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    a = np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    rhs = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, rhs)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    inner = m[k] * u**3 / (6 * h[k]) + m[k + 1] * v**3 / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v
    slope0 = (y[1] - y[0]) / h[0] - h[0] * m[1] / 6
    slope1 = (y[-1] - y[-2]) / h[-1] + h[-1] * m[-2] / 6
    return np.where(at < x[0], y[0] + slope0 * (at - x[0]), np.where(at > x[-1], y[-1] + slope1 * (at - x[-1]), inner))


def deseasonalised(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Values less a spline through the mean of each calendar month, set at its middle. Only monthly means reach a spline."""
    day = F.date_trunc("month", F.timestamp_seconds(seconds(ts)))
    middle = (day.cast("long") + F.add_months(day.cast("date"), 1).cast("timestamp").cast("long")) / 2
    months = df.groupBy(*keys, middle.alias("_x")).agg(F.avg(value).alias("_y"))
    knots = months.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_x", "_y"))).alias("_k"))

    @F.pandas_udf(T.DoubleType())
    def seasonal(t: pd.Series, k: pd.Series) -> pd.Series:
        out = np.empty(len(t))
        keyed = pd.Series(["|".join(f"{r['_x']},{r['_y']}" for r in rows) for rows in k])
        for _, at in keyed.groupby(keyed).groups.items():
            rows = k.iloc[at[0]]
            out[at] = natural_spline(np.array([r["_x"] for r in rows], float), np.array([r["_y"] for r in rows], float), t.to_numpy(float)[at])
        return pd.Series(out)

    return df.join(knots, list(keys)).withColumn(value, F.col(value) - seasonal(seconds(ts).cast("double"), F.col("_k"))).drop("_k")


def local_line(df: DataFrame, keys: Sequence[str], ts: str, value: str, at: DataFrame, scale: int) -> DataFrame:
    """Local straight-line regression at the times `at` (keys, s), with weights exp(-(dt / scale)^2 / 2) out to four scales. Times are put into
    buckets of four scales, so that only neighbouring buckets meet."""
    wide = 4 * scale
    data = df.filter(F.col(value).isNotNull()).select(*keys, seconds(ts).alias("_t"), F.col(value).alias("_v")).withColumn("_b", F.expr(f"_t DIV {wide}"))
    spots = at.withColumn("_b", F.explode(F.expr(f"sequence(s DIV {wide} - 1, s DIV {wide} + 1)")))
    near = spots.join(data, [*keys, "_b"]).withColumn("_d", (F.col("_t") - F.col("s")).cast("double") / scale).filter("abs(_d) <= 4")
    near = near.withColumn("_w", F.exp(-0.5 * F.col("_d") * F.col("_d")))
    s = near.groupBy(*keys, "s").agg(*(F.sum(F.expr(e)).alias(n) for n, e in (("s0", "_w"), ("s1", "_w * _d"), ("s2", "_w * _d * _d"), ("y0", "_w * _v"), ("y1", "_w * _d * _v"))))
    det = "s0 * s2 - s1 * s1"
    return s.select(*keys, "s", F.expr(f"CASE WHEN {det} > 1e-9 * s0 * s2 THEN (s2 * y0 - s1 * y1) / ({det}) ELSE y0 / s0 END").alias("smooth"))


def decay_times(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """`quotient` of each value and the one before, and `efold` = 1 / ln of it; without ones and zeros."""
    x = scan.beside(scan.spans(df, ts), keys, [ts], {"_b": F.col(value)})
    x = x.withColumn("quotient", F.try_divide(F.col(value), F.col("_b"))).filter("quotient > 0 AND quotient <> 1").drop("_b", "_span")
    return x.withColumn("efold", 1 / F.log("quotient"))


def autoregression(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """`residual` of a first-order autoregression by key, and `pulse`: over one deviation, and followed by a positive one."""
    x = stash(scan.beside(scan.spans(df, ts), keys, [ts], {"_p": F.col(value)}, {"_n": F.col(value)}).drop("_span"), "lagged")
    residual = lambda v, p: F.col(v) - F.col("_a") - F.col("_b") * F.col(p)
    fit = x.groupBy(*keys).agg(F.regr_slope(F.col(value), F.col("_p")).alias("_b"), F.regr_intercept(F.col(value), F.col("_p")).alias("_a"))
    x = x.join(fit, list(keys)).withColumn("residual", residual(value, "_p")).withColumn("_next", residual("_n", value))
    std = x.groupBy(*keys).agg(F.stddev_samp("residual").alias("_std"))
    x = x.join(std, list(keys))
    return x.withColumn("pulse", F.coalesce((F.col("residual") > F.col("_std")) & (F.col("_next") > 0), F.lit(False))).select(*df.columns, "residual", "pulse")


def rises(df: DataFrame, keys: Sequence[str], ts: str, value: str, other: str) -> DataFrame:
    """Rows where `value` rises: the increment, and what `other` is in the next record."""
    x = scan.beside(scan.spans(df, ts), keys, [ts], {"_b": F.col(value)}, {"next": F.col(other)})
    return x.withColumn("rise", F.col(value) - F.col("_b")).filter("rise > 0").select(*df.columns, "rise", "next")


def context(df: DataFrame, keys: Sequence[str], ts: str, at: Column, rows: int = 20) -> DataFrame:
    """The rows within `rows` of one for which `at` holds."""
    around = scan.inside(keys, ts).rowsBetween(-rows, rows)
    hit = F.max(F.coalesce(at, F.lit(False)).cast("int")).over(around)
    return scan.near(scan.spans(df, ts), keys, [ts], rows).withColumn("_hit", hit).filter("_hit = 1 AND _own").select(*df.columns)


def merged_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int = scan.MONTH) -> DataFrame:
    """The union of intervals: those that touch or overlap become one. An interval may reach over any number of spans."""
    order = [start, end]
    x = scan.running(scan.spans(df, start, width), keys, order, "_reach", F.col(end), "max", before=True)
    first = F.when(~F.coalesce(F.col(start) <= F.col("_reach"), F.lit(False)), F.col(start))
    x = scan.held(x, keys, order, {"_start": first})
    return x.groupBy(*keys, "_start").agg(F.max(end).alias("end")).select(*keys, F.col("_start").alias("start"), "end")


def local_polynomial(df: DataFrame, keys: Sequence[str], ts: str, value: str, at: DataFrame, scale: int, degree: int = 2) -> DataFrame:
    """As `local_line`, of any degree: moments are summed by Spark, and the small system of each spot is solved in batches."""
    wide, p = 4 * scale, 2 * degree + 1
    data = df.filter(F.col(value).isNotNull()).select(*keys, seconds(ts).alias("_t"), F.col(value).alias("_v")).withColumn("_b", F.expr(f"_t DIV {wide}"))
    spots = at.withColumn("_b", F.explode(F.expr(f"sequence(s DIV {wide} - 1, s DIV {wide} + 1)")))
    near = spots.join(data, [*keys, "_b"]).withColumn("_d", (F.col("_t") - F.col("s")).cast("double") / scale).filter("abs(_d) <= 4")
    w = F.exp(-0.5 * F.col("_d") * F.col("_d"))
    power = lambda k: F.pow("_d", F.lit(k)) if k else F.lit(1.0)
    sums = near.groupBy(*keys, "s").agg(F.array(*(F.sum(w * power(k)) for k in range(p))).alias("_m"), F.array(*(F.sum(w * power(k) * F.col("_v")) for k in range(degree + 1))).alias("_r"))

    @F.pandas_udf(T.DoubleType())
    def solve(m: pd.Series, r: pd.Series) -> pd.Series:
        moments, right = np.stack(m.to_numpy()), np.stack(r.to_numpy())
        at_ij = np.arange(degree + 1)[:, None] + np.arange(degree + 1)
        return pd.Series([np.linalg.lstsq(a[at_ij], b, rcond=None)[0][0] for a, b in zip(moments, right)])

    return sums.select(*keys, "s", solve("_m", "_r").alias("smooth"))
