"""Queries over windows of time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.operators import windows
from cirrostrat.plans.registry import Tables, query

STEPS = "s AS (SELECT *, h - lag(h) OVER w AS b, lead(h) OVER w - h AS a, row_number() OVER w AS n FROM series WINDOW w AS (PARTITION BY field ORDER BY h))"
ISLAND = "x AS (SELECT field, h, v > 50 AS f, row_number() OVER (PARTITION BY field ORDER BY h) AS n FROM series), r AS (SELECT *, n - row_number() OVER (PARTITION BY field ORDER BY h) AS run FROM x WHERE f)"
SPINE = "s AS (SELECT field, unnest(range(min(h), max(h) + 1, 3600)) AS s FROM series GROUP BY field), r AS (SELECT s.field, s.s, x.v FROM s LEFT JOIN series x ON x.field = s.field AND x.h = s.s)"
#: The series as samples numbered by hour.
NUMBERED = "num AS (SELECT field, h // 3600 AS k, v FROM series)"


def numbered(t: Tables) -> DataFrame:
    return t.series.select("field", F.expr("h DIV 3600").alias("k"), "v")


@query("w1_irregular", f"{STEPS}, mc AS (SELECT field, b AS step, count(*) AS k FROM s WHERE b IS NOT NULL GROUP BY ALL), m AS (SELECT field, step FROM mc QUALIFY row_number() OVER (PARTITION BY field ORDER BY k DESC, step) = 1), o AS (SELECT s.field, h, n - row_number() OVER (PARTITION BY s.field ORDER BY h) AS run FROM s JOIN m ON m.field = s.field WHERE b <> step AND a <> step) SELECT field, h, count(*) OVER (PARTITION BY field, run) AS together FROM o")
def _(t: Tables) -> DataFrame:
    return windows.irregular(t.series, ["field"], "h").select("field", "h", "together")


@query("w2_step_changes", "SELECT id, CASE WHEN t - lag(t) OVER w <= 3600 THEN greatest(abs(lag(v + 1) OVER w - v), abs(v + 1 - lag(v) OVER w)) END AS change FROM obs WINDOW w AS (PARTITION BY station, field ORDER BY t, id)", "change")
def _(t: Tables) -> DataFrame:
    s = t.obs.select("id", "station", "field", "v", (F.col("v") + 1).alias("high"), "t")
    return windows.step_changes(s, ["station", "field"], "t", "v", "high", 60, ["id"]).select("id", "change")


@query("w3_range", "SELECT id, v < sensor % 5 OR v > 100 + sensor AS flag FROM obs")
def _(t: Tables) -> DataFrame:
    limits = t.obs.select("sensor").distinct().withColumn("range_min", F.col("sensor") % 5).withColumn("range_max", F.col("sensor") + 100)
    return windows.out_of_range(t.obs, limits, ["sensor"], "v").select("id", "flag")


@query("w4_persistence", "d AS (SELECT station, t - t % 86400 AS day, stddev_samp(v) AS std, count(v) AS n, max(v) - min(v) AS r FROM obs GROUP BY ALL) SELECT station, day, std, n, coalesce((std < 45 AND n > 24) OR std = 0, FALSE) AS flat, coalesce(r / nullif(std, 0) < 4, FALSE) AS narrow FROM d", "std")
def _(t: Tables) -> DataFrame:
    return windows.persistence(t.obs, ["station"], "t", "v", 45.0, least_spread=4.0)


@query("w5_amounts", "SELECT station, h, CASE WHEN row_number() OVER w = 1 THEN v WHEN v - lag(v) OVER w >= 0 THEN v - lag(v) OVER w END AS amount FROM seen WINDOW w AS (PARTITION BY station ORDER BY h)", "amount")
def _(t: Tables) -> DataFrame:
    return windows.amounts(t.seen, ["station"], "h", "v").select("station", "h", "amount")


@query("w6_spikes", "x AS (SELECT field, h, floor(v / 20)::BIGINT AS v FROM series), d AS (SELECT *, v - lag(v) OVER w AS up, lead(v) OVER w - v AS down FROM x WINDOW w AS (PARTITION BY field ORDER BY h)) SELECT field, h, v FROM d WHERE NOT coalesce(up > 0 AND up = -down, FALSE)")
def _(t: Tables) -> DataFrame:
    return windows.without_spikes(t.series.withColumn("v", F.floor(F.col("v") / 20)), ["field"], "h", "v").select("field", "h", "v")


@query("w7_breaks", "g AS (SELECT sensor, t, t - lag(t) OVER (PARTITION BY sensor ORDER BY t) AS g FROM obs) SELECT sensor, max(g) AS longest, count(*) FILTER (g > 86400) AS gaps, max(t) FILTER (g > 86400) AS resumed FROM g GROUP BY sensor")
def _(t: Tables) -> DataFrame:
    return windows.breaks(t.obs, ["sensor"], "t")


@query("w8_interval_segments", """
    i AS (SELECT field, h, least(h - lag(h) OVER w, lead(h) OVER w - h) AS i FROM series WINDOW w AS (PARTITION BY field ORDER BY h)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY field ORDER BY h) AS run FROM (SELECT *, CASE WHEN i <> lag(i) OVER (PARTITION BY field ORDER BY h) THEN 1 ELSE 0 END AS ch FROM i)),
    l AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY field, run) >= 3 THEN i END AS long FROM r),
    f AS (SELECT field, h, coalesce(last_value(long IGNORE NULLS) OVER (PARTITION BY field ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(long IGNORE NULLS) OVER (PARTITION BY field ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), i) AS interval FROM l)
    SELECT field, h, interval, (sum(ch) OVER (PARTITION BY field ORDER BY h))::BIGINT AS segment FROM (SELECT *, CASE WHEN interval <> lag(interval) OVER (PARTITION BY field ORDER BY h) THEN 1 ELSE 0 END AS ch FROM f)""")
def _(t: Tables) -> DataFrame:
    return windows.interval_segments(t.series, ["field"], "h").select("field", "h", "interval", "segment")


@query("w9_islands", f"{ISLAND} SELECT field, min(h) AS start, max(h) AS \"end\", count(*) AS length FROM r GROUP BY field, run")
def _(t: Tables) -> DataFrame:
    return windows.islands(t.series, ["field"], "h", F.col("v") > 50)


@query("w10_backward_pieces", "SELECT field, piece, count(*) AS n FROM (SELECT field, (sum(b) OVER (PARTITION BY field ORDER BY id))::BIGINT AS piece FROM (SELECT field, id, CASE WHEN x <= lag(x) OVER (PARTITION BY field ORDER BY id) THEN 1 ELSE 0 END AS b FROM (SELECT *, t - (id % 7) * 4000 AS x FROM obs))) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    rows = t.obs.withColumn("x", F.col("t") - (F.col("id") % 7) * 4000)
    return windows.backward_pieces(rows, "id", "x", ["field"]).groupBy("field", "piece").agg(F.count("*").alias("n"))


@query("w11_regular", f"{SPINE}, f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN s END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN v IS NOT NULL THEN s END IGNORE NULLS) OVER a AS t1, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1 FROM r WINDOW b AS (PARTITION BY field ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY field ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT field, s, coalesce(v, v0 + (v1 - v0) * (s - t0) / (t1 - t0)) AS v FROM f", "v")
def _(t: Tables) -> DataFrame:
    return windows.regular(t.series, ["field"], "h", 3600, "v", interpolate=True)


@query("w12_filled", f"{SPINE} SELECT field, s, last_value(v IGNORE NULLS) OVER (PARTITION BY field ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM r", "v")
def _(t: Tables) -> DataFrame:
    return windows.filled(windows.regular(t.series, ["field"], "h", 3600, "v"), ["field"], "s", "v")


@query("w13_rolling_bias", "SELECT station, h, v - avg(v) OVER (PARTITION BY station ORDER BY h RANGE BETWEEN 604799 PRECEDING AND CURRENT ROW) AS v FROM seen", "v")
def _(t: Tables) -> DataFrame:
    out = windows.rolling_mean(t.seen, ["station"], "h", "v", 7 * 86400, "m")
    return out.select("station", "h", (F.col("v") - F.col("m")).alias("v"))


LANCZOS = ", ".join(f"({i - 36}, {w!r}::DOUBLE)" for i, w in enumerate(windows.lanczos_weights(24)))


@query("w14_lanczos", f"{NUMBERED}, taps(o, w) AS (VALUES {LANCZOS}) SELECT a.field, a.k, sum(w * b.v) / sum(w) AS filtered FROM num a JOIN taps ON TRUE JOIN num b ON b.field = a.field AND b.k = a.k + o GROUP BY a.field, a.k", "filtered")
def _(t: Tables) -> DataFrame:
    return windows.fir(numbered(t), ["field"], "k", "v", {"lanczos": windows.lanczos_weights(24)}).drop("kernel")


RICKER = ", ".join(f"('{s}', {i - 5 * s}, {w!r}::DOUBLE)" for s in (6, 12) for i, w in enumerate(windows.ricker_weights(s)))


@query("w15_wavelets", f"{NUMBERED}, taps(kernel, o, w) AS (VALUES {RICKER}) SELECT a.field, a.k, kernel, sum(w * b.v) AS filtered FROM num a JOIN taps ON TRUE JOIN num b ON b.field = a.field AND b.k = a.k + o GROUP BY ALL", "filtered")
def _(t: Tables) -> DataFrame:
    return windows.fir(numbered(t), ["field"], "k", "v", {str(s): windows.ricker_weights(s) for s in (6, 12)}, renormalise=False)


@query("w16_minima", "SELECT field, h, v FROM (SELECT *, min(v) OVER (PARTITION BY field ORDER BY h ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, min(v) OVER (PARTITION BY field ORDER BY h ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM series) WHERE v < a AND v < b", "v")
def _(t: Tables) -> DataFrame:
    return windows.local_extrema(t.series, ["field"], "h", "v", 5)


@query("w17_peak_times", "SELECT DISTINCT field, peak FROM (SELECT field, arg_max(h, v) OVER w AS peak, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY field ORDER BY h ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10")
def _(t: Tables) -> DataFrame:
    return windows.rolling_peak_times(t.series, ["field"], "h", "v")


@query("w18_anomaly", "SELECT station, field, h, v - avg(v) OVER (PARTITION BY station, field, h % 86400) AS v FROM hourly", "v")
def _(t: Tables) -> DataFrame:
    return windows.anomaly(t.hourly.withColumn("hour", F.col("h") % 86400), ["station", "field", "hour"], "v").drop("hour")


@query("w19_deseasonalised", rounds="v")
def _(t: Tables) -> DataFrame:
    return windows.deseasonalised(t.daily.withColumn("s", F.col("d") * 86400), ["field"], "s", "v").select("field", "d", "v")


@query("w20_local_line", """
    spot AS (SELECT field, unnest(range(min(h), max(h), 86400)) AS s FROM series GROUP BY field), n AS (SELECT a.field, a.s, x.v, (x.h - a.s) / 10800::DOUBLE AS d FROM spot a JOIN series x ON x.field = a.field AND abs(x.h - a.s) <= 43200),
    w AS (SELECT *, exp(-0.5 * d * d) AS w FROM n), s AS (SELECT field, s, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * v) AS y0, sum(w * d * v) AS y1 FROM w GROUP BY field, s)
    SELECT field, s, CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s2 THEN (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) ELSE y0 / s0 END AS smooth FROM s""", "smooth")
def _(t: Tables) -> DataFrame:
    at = t.series.groupBy("field").agg(F.explode(F.sequence(F.min("h"), F.max("h") - 1, F.lit(86400).cast("long"))).alias("s"))
    return windows.local_line(t.series, ["field"], "h", "v", at, 10800)


@query("w21_decay", "SELECT field, h, q AS quotient, 1 / ln(q) AS efold FROM (SELECT field, h, v / nullif(lag(v) OVER (PARTITION BY field ORDER BY h), 0) AS q FROM series) WHERE q > 0 AND q <> 1", "quotient efold")
def _(t: Tables) -> DataFrame:
    return windows.decay_times(t.series, ["field"], "h", "v").select("field", "h", "quotient", "efold")


@query("w22_autoregression", "p AS (SELECT *, lag(v) OVER (PARTITION BY field ORDER BY h) AS p FROM series), f AS (SELECT field, regr_slope(v, p) AS b, regr_intercept(v, p) AS a FROM p GROUP BY field), r AS (SELECT field, h, v - a - b * p AS residual FROM p JOIN f USING (field)) SELECT field, h, residual, coalesce(residual > stddev_samp(residual) OVER (PARTITION BY field) AND lead(residual) OVER (PARTITION BY field ORDER BY h) > 0, FALSE) AS pulse FROM r", "residual")
def _(t: Tables) -> DataFrame:
    return windows.autoregression(t.series, ["field"], "h", "v").select("field", "h", "residual", "pulse")


@query("w23_rises", "SELECT field, h, rise, next FROM (SELECT field, h, v - lag(v) OVER w AS rise, lead(v) OVER w AS next FROM series WINDOW w AS (PARTITION BY field ORDER BY h)) WHERE rise > 0", "rise next")
def _(t: Tables) -> DataFrame:
    return windows.rises(t.series, ["field"], "h", "v", "v").select("field", "h", "rise", "next")


@query("w24_context", "SELECT field, h FROM (SELECT field, h, max(CASE WHEN v > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY field ORDER BY h ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS hit FROM series) WHERE hit = 1")
def _(t: Tables) -> DataFrame:
    return windows.context(t.series, ["field"], "h", F.col("v") > 150).select("field", "h")


@query("w25_merged_intervals", "x AS (SELECT field, h - 10800 AS s, h + 10800 AS e FROM series WHERE v > 90), m AS (SELECT *, max(e) OVER (PARTITION BY field ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM x), p AS (SELECT *, sum(CASE WHEN s > r THEN 1 ELSE 0 END) OVER (PARTITION BY field ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM m) SELECT field, min(s) AS start, max(e) AS \"end\" FROM p GROUP BY field, part")
def _(t: Tables) -> DataFrame:
    marks = t.series.filter("v > 90").select("field", (F.col("h") - 10800).alias("s"), (F.col("h") + 10800).alias("e"))
    return windows.merged_intervals(marks, ["field"], "s", "e")


@query("w26_ranks", "SELECT station, field, (rank() OVER (PARTITION BY station ORDER BY avg(v) DESC))::INT AS place FROM hourly GROUP BY station, field")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    means = t.hourly.groupBy("station", "field").agg(F.avg("v").alias("m"))
    return means.select("station", "field", F.rank().over(Window.partitionBy("station").orderBy(F.desc("m"))).alias("place"))
