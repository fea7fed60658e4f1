"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.operators import aggregate as agg
from cirrostrat.plans.registry import Tables, query

PAIRS = "pairs AS (SELECT f.station, f.start, f.step, f.valid, f.v AS model, o.v AS obs, f.v - o.v AS error FROM fcst f JOIN seen o ON o.station = f.station AND o.h = f.valid)"
MONTHLY = "monthly AS (SELECT field, year(date) * 12 + month(date) AS month, avg(v) AS v FROM daily GROUP BY ALL)"
CELLS = "cells AS (SELECT l_suppkey % 20 AS i, l_partkey % 10 AS j, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS month, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), idx AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS month, avg(o_totalprice) AS x FROM orders GROUP BY ALL)"


def pairs(t: Tables) -> DataFrame:
    both = t.fcst.withColumnRenamed("v", "model").join(t.seen.select("station", F.col("h").alias("valid"), F.col("v").alias("obs")), ["station", "valid"])
    return both.withColumn("error", F.col("model") - F.col("obs"))


def month_number(c: str) -> F.Column:
    return (F.year(c) * 12 + F.month(c)).cast("long")


def cells(t: Tables) -> DataFrame:
    return t("lineitem").groupBy((F.col("l_suppkey") % 20).alias("i"), (F.col("l_partkey") % 10).alias("j"), month_number("l_shipdate").alias("month")).agg(F.avg("l_extendedprice").alias("v"))


def index(t: Tables) -> DataFrame:
    return t("orders").groupBy(month_number("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("x"))


@query("a5_resample", """
    SELECT 'hour' AS kind, field, t - t % 3600 AS period, avg(v) AS mean, max(v) AS high, count(v) AS n FROM obs GROUP BY ALL
    UNION ALL SELECT 'season', field, epoch(make_date(year(date - INTERVAL 2 MONTHS - INTERVAL 0 DAYS)::BIGINT, ((month(date) + 9) % 12 // 3 * 3 + 3)::BIGINT, 1)::TIMESTAMP)::BIGINT, avg(v), max(v), count(v) FROM daily GROUP BY ALL
    UNION ALL SELECT 'month', field, epoch(date_trunc('month', date)::TIMESTAMP)::BIGINT, avg(v), max(v), count(v) FROM daily GROUP BY ALL""", "mean high")
def _(t: Tables) -> DataFrame:
    how = (F.avg("v").alias("mean"), F.max("v").alias("high"), F.count("v").alias("n"))
    days = t.daily.withColumn("s", F.col("d") * 86400)
    out = agg.resample(t.obs, ["field"], "t", "hour", *how).withColumn("kind", F.lit("hour"))
    for kind in ("season", "month"):
        out = out.unionByName(agg.resample(days, ["field"], "s", kind, *how).withColumn("kind", F.lit(kind)))
    return out


@query("a6_shifted_day", "SELECT station, (h - 28800) - (h - 28800) % 86400 AS period, avg(v) * 24 AS total FROM hourly WHERE field = 'view' GROUP BY ALL", "total")
def _(t: Tables) -> DataFrame:
    return agg.resample(t.seen, ["station"], "h", "day", (F.avg("v") * 24).alias("total"), offset=-28800)


@query("a8_season_year", "SELECT field, epoch(make_date((year(date) - CASE WHEN month(date) < 3 THEN 1 ELSE 0 END)::BIGINT, 12, 1)::TIMESTAMP)::BIGINT AS period, avg(v) AS v FROM daily WHERE month(date) IN (12, 1, 2) GROUP BY ALL", "v")
def _(t: Tables) -> DataFrame:
    return agg.season_year(t.daily.withColumn("s", F.col("d") * 86400), ["field"], "s", "v")


@query("a9_water_years", "SELECT field, (year(date) - CASE WHEN month(date) < 9 THEN 1 ELSE 0 END)::INT AS water_year, avg(v) AS v, count(*) AS n FROM daily WHERE (month(date) - 9 + 12) % 12 < 8 GROUP BY ALL", "v")
def _(t: Tables) -> DataFrame:
    return agg.water_years(t.daily, ["field"], "date", 9, 8, F.avg("v").alias("v"), F.count("*").alias("n"))


@query("a10_error_statistics", f"{PAIRS} SELECT station, count(error) AS n, avg(error) AS bias, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae, stddev_samp(error) AS std FROM pairs GROUP BY station", "bias rmse mae std")
def _(t: Tables) -> DataFrame:
    return agg.error_statistics(pairs(t), ["station"])


@query("a11_unbiased_statistics", f"{PAIRS}, c AS (SELECT station, error - avg(error) OVER (PARTITION BY station, valid // 86400) AS error FROM pairs) SELECT station, count(error) AS n, avg(error) AS bias, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae, stddev_samp(error) AS std FROM c GROUP BY station", "bias rmse mae std")
def _(t: Tables) -> DataFrame:
    return agg.error_statistics(agg.unbiased(pairs(t).withColumn("day", F.expr("valid DIV 86400")), ["station", "day"]), ["station"])


@query("a12_error_by_step", f"{PAIRS} SELECT step, step // 24 AS lead, count(error) AS n, avg(error) AS bias, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae, stddev_samp(error) AS std FROM pairs GROUP BY ALL", "bias rmse mae std")
def _(t: Tables) -> DataFrame:
    return agg.error_statistics(pairs(t).withColumn("lead", F.expr("step DIV 24")), ["step", "lead"])


@query("a13_lead_summary", f"{PAIRS} SELECT station, avg(error) AS mean, min(error) AS low, max(error) AS high, count(*) AS n FROM pairs WHERE step // 24 = 1 GROUP BY station", "mean low high")
def _(t: Tables) -> DataFrame:
    return pairs(t).filter("step DIV 24 = 1").groupBy("station").agg(F.avg("error").alias("mean"), F.min("error").alias("low"), F.max("error").alias("high"), F.count("*").alias("n"))


@query("a14_daily_extremes", f"{PAIRS}, day AS (SELECT station, valid // 86400 AS d, min(obs) AS no, max(obs) AS xo, min(model) AS nm, max(model) AS xm FROM pairs GROUP BY ALL) SELECT station, avg(nm - no) AS min_bias, avg(xm - xo) AS max_bias, avg((xm - xo) - (nm - no)) AS range_bias FROM day GROUP BY station", "min_bias max_bias range_bias")
def _(t: Tables) -> DataFrame:
    return agg.daily_extremes_bias(pairs(t), ["station"], "valid", "obs", "model")


@query("a15_threat_score", f"{PAIRS}, e AS (SELECT station, obs > 40 AS o, model > 45 AS f FROM pairs), s AS (SELECT station, count(*) FILTER (o AND f) AS a, count(*) FILTER (f AND NOT o) AS b, count(*) FILTER (o AND NOT f) AS c, count(*) AS n FROM e GROUP BY station) SELECT station, a, b, c, n, n - a - b - c AS d, a / nullif(a + b + c, 0) AS threat FROM s", "threat")
def _(t: Tables) -> DataFrame:
    return agg.contingency(pairs(t), ["station"], F.col("obs") > 40, F.col("model") > 45)


@query("a16_shape", "SELECT field, skewness(v) AS skew, kurtosis(v) AS kurt FROM obs GROUP BY field", "skew kurt")
def _(t: Tables) -> DataFrame:
    return agg.shape_statistics(t.obs, ["field"], "v")


@query("a17_annual_cycle", "m AS (SELECT field, month(date)::INT AS m, avg(v) AS v, stddev_samp(v) AS s FROM daily GROUP BY ALL) SELECT field, max(v) - min(v) AS amplitude, arg_max(m, v) AS peak, avg(s) AS std_mean, max(s) - min(s) AS std_range FROM m GROUP BY field", "amplitude std_mean std_range")
def _(t: Tables) -> DataFrame:
    return agg.annual_cycle(t.daily, ["field"], F.month("date"), "v")


@query("a18_active_days", "d AS (SELECT sensor, t - t % 86400 AS day, count(*) AS n FROM obs GROUP BY ALL), s AS (SELECT sensor, unnest(range(min(day), max(day) + 1, 86400)) AS day FROM d GROUP BY sensor) SELECT s.sensor, s.day, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (sensor, day)")
def _(t: Tables) -> DataFrame:
    return agg.active_days(t.obs, "sensor", "t", "v")


@query("a19_missing_days", "d AS (SELECT DISTINCT o_custkey AS k, epoch(o_orderdate)::BIGINT AS day FROM orders), s AS (SELECT k, unnest(range(min(day), max(day) + 1, 86400)) AS day FROM d GROUP BY k) SELECT s.k, epoch(date_trunc('month', make_timestamp(s.day * 1000000)))::BIGINT AS month, count(*) FILTER (d.k IS NULL) AS missing FROM s LEFT JOIN d ON d.k = s.k AND d.day = s.day GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return agg.missing_days(t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit(1).alias("v")), "k", "ts", "v")


@query("a20_coverage", "SELECT sensor, field, min(t) AS first, max(t) AS last FROM obs GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return agg.coverage(t.obs, ["sensor", "field"], "t", "v")


@query("a21_minutes", "m AS (SELECT sensor, list_sort(list(DISTINCT (t % 3600 // 60)::INT)) AS minutes FROM obs GROUP BY sensor) SELECT sensor, array_to_string(minutes, ',') AS minutes, array_to_string(list_filter(minutes, lambda x: x NOT IN (0, 15, 30, 45)), ',') AS unexpected FROM m")
def _(t: Tables) -> DataFrame:
    out = agg.minutes_of_hour(t.obs, ["sensor"], "t", expected=[0, 15, 30, 45])
    return out.select("sensor", F.array_join("minutes", ",").alias("minutes"), F.array_join("unexpected", ",").alias("unexpected"))


@query("a22_modal_step", "s AS (SELECT field, h - lag(h) OVER (PARTITION BY field ORDER BY h) AS step FROM series), c AS (SELECT field, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY ALL) SELECT field, step FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, step) = 1")
def _(t: Tables) -> DataFrame:
    return agg.modal_step(t.series, ["field"], "h")


@query("a23_two_rates", "h AS (SELECT field, t - t % 3600 AS h, count(*) AS per_hour FROM obs GROUP BY ALL), c AS (SELECT field, per_hour, count(*) AS hours, min(h) AS first FROM h GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY field ORDER BY hours DESC, per_hour))::INT AS rank, 3600 / per_hour AS interval FROM c QUALIFY rank <= 2", "interval")
def _(t: Tables) -> DataFrame:
    return agg.two_rates(t.obs, ["field"], "t")


@query("a24_binned_statistic", "e AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT least(50, floor((s_acctbal - lo) / (hi - lo) * 50) + 1)::INT AS bin, count(*) AS n, avg(s_suppkey) AS mean, stddev_pop(s_suppkey) AS std, min(s_suppkey) AS min, max(s_suppkey) AS max FROM supplier, e GROUP BY 1", "mean std")
def _(t: Tables) -> DataFrame:
    return agg.binned_statistic(t("supplier"), "s_acctbal", "s_suppkey", 50)


@query("a25_density", """
    s AS (SELECT field, count(v) AS n, stddev_samp(v) * pow(count(v), -0.2) AS h, min(v) AS low, max(v) AS high FROM obs GROUP BY field),
    c AS (SELECT field, n, h, low, high, (floor((v - low) / h * 10) + 0.5) * h / 10 + low AS x, count(*) AS k FROM obs JOIN s USING (field) GROUP BY ALL),
    g AS (SELECT *, low + (high - low) * point / 99 AS "at" FROM c, (SELECT unnest(range(100))::INT AS point))
    SELECT field, point, "at", sum(exp(-0.5 * pow(("at" - x) / h, 2)) * k) / any_value(n * h * 2.5066282746310002::DOUBLE) AS density FROM g GROUP BY field, point, "at" """, "at density")
def _(t: Tables) -> DataFrame:
    return agg.kernel_density(t.obs, ["field"], "v")


LSQ = "regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt, sqrt(CASE WHEN regr_r2(y, x) > 1 THEN 0 ELSE (1 - regr_r2(y, x)) * regr_syy(y, x) / count(*) END) AS rmse, 1 - (1 - regr_r2(y, x)) * (count(*) - 1) / nullif(count(*) - 2, 0) AS r2_adj"


@query("a26_line_fit", f"{PAIRS}, p AS (SELECT station, obs AS x, model AS y FROM pairs) SELECT station, 'line' AS kind, count(*) AS n, {LSQ} FROM p GROUP BY station UNION ALL SELECT station, 'origin', count(*), sum(x * y) / sum(x * x), 0, sqrt((sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x)) / count(*)), 1 - (sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x)) / sum(y * y) * count(*) / (count(*) - 1) FROM p GROUP BY station", "slope icpt rmse r2_adj")
def _(t: Tables) -> DataFrame:
    p = pairs(t)
    line = agg.line_fit(p, ["station"], "obs", "model").withColumn("kind", F.lit("line"))
    return line.unionByName(agg.line_fit(p, ["station"], "obs", "model", intercept=False).withColumn("kind", F.lit("origin")))


@query("a27_plane_fit", f"{PAIRS}, s AS (SELECT station, count(*) AS n, avg(obs) AS m1, avg(step) AS m2, avg(model) AS my, var_pop(obs) AS c11, var_pop(step) AS c22, covar_pop(obs, step) AS c12, covar_pop(obs, model) AS c1y, covar_pop(step, model) AS c2y FROM pairs GROUP BY station), b AS (SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM s) SELECT station, n, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM b", "b0 b1 b2")
def _(t: Tables) -> DataFrame:
    return agg.plane_fit(pairs(t), ["station"], "obs", "step", "model")


@query("a28_common_slope", f"{PAIRS}, c AS (SELECT station, avg(obs) OVER w AS mx, avg(model) OVER w AS my, obs - avg(obs) OVER w AS x, model - avg(model) OVER w AS y FROM pairs WINDOW w AS (PARTITION BY station)), b AS (SELECT sum(x * y) / sum(x * x) AS slope FROM c) SELECT station, slope, any_value(my) - slope * any_value(mx) AS offset FROM c, b GROUP BY station, slope", "slope offset")
def _(t: Tables) -> DataFrame:
    return agg.common_slope(pairs(t), "station", "obs", "model")


@query("a29_lapse_table", f"""{PAIRS}, x AS (SELECT station % 2 AS model, station, step - 36 AS x, error AS y FROM pairs), c AS (SELECT *, unnest(list_filter(['all', CASE WHEN x > 0 THEN 'above' END, CASE WHEN x < 0 THEN 'below' END], lambda z: z IS NOT NULL)) AS class FROM x),
    m AS (SELECT model, class, station, avg(x) AS x, avg(y) AS y FROM c GROUP BY ALL)
    SELECT model, class, 'rows' AS kind, count(*) AS n, {LSQ} FROM c GROUP BY ALL UNION ALL SELECT model, class, 'means', count(*), {LSQ.replace(' AS slope', '').replace(' AS icpt', '').replace(' AS rmse', '').replace(' AS r2_adj', '')} FROM m GROUP BY ALL""", "slope icpt rmse r2_adj")
def _(t: Tables) -> DataFrame:
    rows = pairs(t).select((F.col("station") % 2).alias("model"), "station", (F.col("step") - 36).alias("dz"), "error")
    return agg.lapse_table(rows, "model", "dz", "error", "station")


@query("a30_regression_map", f"{CELLS} SELECT i, j, count(*) AS n, regr_slope(c.v, x.x) AS slope, corr(c.v, x.x) AS r, CASE WHEN count(*) > 2 AND abs(corr(c.v, x.x)) < 1 THEN corr(c.v, x.x) * sqrt((count(*) - 2) / (1 - corr(c.v, x.x) * corr(c.v, x.x))) END AS t FROM cells c JOIN idx x ON c.month = x.month + 2 GROUP BY i, j", "slope r t")
def _(t: Tables) -> DataFrame:
    return agg.regression_map(cells(t), index(t), ["i", "j"], lag=2)


@query("a30_regression_map_p", rounds="slope r t p")
def _(t: Tables) -> DataFrame:
    return agg.regression_map(cells(t), index(t), ["i", "j"], p_value=True)


@query("a31_field_regression", f"{CELLS} SELECT a.i, a.j, count(*) AS n, regr_slope(b.v, a.v) AS slope, regr_r2(b.v, a.v) AS r2 FROM cells a JOIN (SELECT i, j, month + 1 AS month, v FROM cells) b ON a.i = b.i AND a.j = b.j AND a.month = b.month GROUP BY a.i, a.j", "slope r2")
def _(t: Tables) -> DataFrame:
    return agg.field_regression(cells(t), cells(t).withColumn("month", F.col("month") + 1), ["i", "j"])


@query("a32_correlation", f"{PAIRS} SELECT station, step // 24 AS lead, count(*) AS n, corr(obs, model) AS r, CASE WHEN count(*) > 2 AND abs(corr(obs, model)) < 1 THEN corr(obs, model) * sqrt((count(*) - 2) / (1 - corr(obs, model) * corr(obs, model))) END AS t FROM pairs GROUP BY ALL", "r t")
def _(t: Tables) -> DataFrame:
    return agg.correlation(pairs(t).withColumn("lead", F.expr("step DIV 24")), ["station", "lead"], "obs", "model")


@query("a33_trend", "SELECT field, regr_slope(v, d * 86400.0::DOUBLE) * (3600 * 24 * 365.24) AS per_year, count(v) AS n FROM daily GROUP BY field", "per_year")
def _(t: Tables) -> DataFrame:
    return agg.trend(t.daily.withColumn("s", F.col("d") * 86400), ["field"], "s", "v")


@query("a33_detrended", "SELECT field, d, v - avg(v) OVER w - regr_slope(v, d * 86400.0::DOUBLE) OVER w * (d * 86400.0::DOUBLE - avg(d * 86400.0::DOUBLE) OVER w) AS v FROM daily WINDOW w AS (PARTITION BY field)", "v")
def _(t: Tables) -> DataFrame:
    return agg.detrended(t.daily.withColumn("s", F.col("d") * 86400), ["field"], "s", "v").select("field", "d", "v")


@query("a34_area_mean", "SELECT d, sum(v * cos(radians(lat))) / sum(cos(radians(lat))) AS mean FROM grid GROUP BY d", "mean")
def _(t: Tables) -> DataFrame:
    return agg.area_mean(t.grid, ["d"], "lat", "v")


@query("a35_box_flux", "e AS (SELECT max(i) AS n FROM grid) SELECT d, avg(v) FILTER (j = 0) AS west, avg(v) FILTER (j = 49) AS east, avg(lon) FILTER (i = 0) AS south, avg(lon) FILTER (i = n) AS north, avg(v) FILTER (j = 0) - avg(v) FILTER (j = 49) + avg(lon) FILTER (i = 0) - avg(lon) FILTER (i = n) AS net FROM grid, e GROUP BY d", "west east south north net")
def _(t: Tables) -> DataFrame:
    return agg.box_flux(t.grid, ["d"], "j", "i", "v", "lon")


@query("a36_eddy_flux", "g AS (SELECT j, avg(v) OVER w AS mv, avg(d) OVER w AS md, v, d FROM grid WINDOW w AS (PARTITION BY i, j)) SELECT j, avg(mv * md) AS mean_part, avg((v - mv) * (d - md)) AS eddy_part FROM g GROUP BY j", "mean_part eddy_part")
def _(t: Tables) -> DataFrame:
    return agg.eddy_flux(t.grid, ["i", "j"], ["j"], "v", "d")


@query("a37_coarsened", "SELECT d, i // 4 AS i, j // 4 AS j, avg(v) AS v, count(v) AS n FROM grid GROUP BY 1, 2, 3", "v")
def _(t: Tables) -> DataFrame:
    return agg.coarsened(t.grid, ["d"], "i", "j", "v", 4)


@query("a37_refined", "SELECT d, i * 2 + a AS i, j * 2 + b AS j, v FROM grid, (VALUES (0), (1)) AS x(a), (VALUES (0), (1)) AS y(b)", "v")
def _(t: Tables) -> DataFrame:
    return agg.refined(t.grid, "i", "j", 2).select("d", "i", "j", "v")


@query("a38_zonal", "SELECT d, avg(v) AS v FROM grid WHERE lon BETWEEN -71.5 AND -70.5 AND lat BETWEEN -31.9 AND -30 GROUP BY d", "v")
def _(t: Tables) -> DataFrame:
    return t.grid.filter("lon BETWEEN -71.5 AND -70.5 AND lat BETWEEN -31.9 AND -30").groupBy("d").agg(F.avg("v").alias("v"))


@query("a39_gaussian_mean", "SELECT d, sum(v * exp(-pow(((lon + 71) * (lon + 71) + (lat + 31) * (lat + 31)) / 0.3, 2))) / sum(exp(-pow(((lon + 71) * (lon + 71) + (lat + 31) * (lat + 31)) / 0.3, 2))) AS mean FROM grid GROUP BY d", "mean")
def _(t: Tables) -> DataFrame:
    far = (F.col("lon") + 71) * (F.col("lon") + 71) + (F.col("lat") + 31) * (F.col("lat") + 31)
    return agg.gaussian_mean(t.grid, ["d"], far, "v", 0.3)


@query("a40_run_statistics", "SELECT l_shipmode_ AS mode, avg(l_tax) AS mean, stddev_samp(l_tax) AS std FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_, l_tax, l_linenumber FROM lineitem) GROUP BY 1", "mean std")
def _(t: Tables) -> DataFrame:
    return t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("mode")).agg(F.avg("l_tax").alias("mean"), F.stddev_samp("l_tax").alias("std"))


@query("a41_covariance", "SELECT x.station AS a, y.station AS b, count(*) AS n, covar_samp(x.v, y.v) AS cov FROM seen x JOIN seen y ON x.h = y.h AND x.station <= y.station GROUP BY 1, 2", "cov")
def _(t: Tables) -> DataFrame:
    return agg.covariance(t.seen, "station", "h", "v")


@query("a42_twelve_hour_change", "SELECT a.station, a.h // 86400 AS day, a.v - b.v AS change FROM seen a JOIN seen b ON a.station = b.station AND a.h = b.h + 43200 WHERE a.h % 86400 = 43200", "change")
def _(t: Tables) -> DataFrame:
    late = t.seen.filter("h % 86400 = 43200").select("station", F.expr("h DIV 86400").alias("day"), F.col("v").alias("a"))
    early = t.seen.filter("h % 86400 = 0").select("station", F.expr("h DIV 86400").alias("day"), F.col("v").alias("b"))
    return late.join(early, ["station", "day"]).select("station", "day", (F.col("a") - F.col("b")).alias("change"))


@query("a43_mean_of_means", f"{MONTHLY} SELECT field, avg(v) AS mean, stddev_samp(v) AS std, count(v) AS n FROM monthly GROUP BY field", "mean std")
def _(t: Tables) -> DataFrame:
    return agg.mean_of_means(t.daily.withColumn("month", month_number("date")), ["field", "month"], ["field"], "v")


@query("a44_levels_summary", f"{PAIRS} SELECT station % 2 AS model, station, avg(abs(error)) AS pooled, count(error) AS n, grouping_id(station % 2, station)::BIGINT AS level FROM pairs GROUP BY ROLLUP (station % 2, station)", "pooled")
def _(t: Tables) -> DataFrame:
    return agg.levels_summary(pairs(t).withColumn("model", F.col("station") % 2), "model", "station", "error")


@query("a45_predictors", "w AS (SELECT field, (year(date) - CASE WHEN month(date) < 6 THEN 1 ELSE 0 END)::INT AS y, avg(v) AS v FROM daily WHERE (month(date) - 6 + 12) % 12 < 6 GROUP BY ALL), s AS (SELECT field, (year(date) - CASE WHEN month(date) < 12 THEN 1 ELSE 0 END)::INT AS y, avg(v) AS v FROM daily WHERE (month(date) - 12 + 12) % 12 < 5 GROUP BY ALL) SELECT field, y AS water_year, 0.3 * w.v + 0.7 * s.v AS predictor FROM w JOIN s USING (field, y)", "predictor")
def _(t: Tables) -> DataFrame:
    winter = agg.water_years(t.daily, ["field"], "date", 6, 6, F.avg("v").alias("a"))
    summer = agg.water_years(t.daily, ["field"], "date", 12, 5, F.avg("v").alias("b"))
    return winter.join(summer, ["field", "water_year"]).select("field", "water_year", F.expr("0.3D * a + 0.7D * b").alias("predictor"))


@query("a46_twice_daily", "x AS (SELECT station, field, t - t % 43200 AS h, sum(v) AS v FROM obs GROUP BY ALL) SELECT station, field, (h - 3600) - (h - 3600) % 86400 AS day, sum(v) AS total FROM x GROUP BY ALL HAVING count(v) = 2", "total")
def _(t: Tables) -> DataFrame:
    halves = t.obs.groupBy("station", "field", F.expr("t - t % 43200").alias("h")).agg(F.sum("v").alias("v"))
    return agg.twice_daily_totals(halves, ["station", "field"], "h", "v")


@query("a47_period_difference", "SELECT station, field, avg(v) FILTER (h >= 1705276800) - avg(v) FILTER (h < 1705276800) AS change FROM hourly GROUP BY ALL", "change")
def _(t: Tables) -> DataFrame:
    return agg.period_difference(t.hourly, ["station", "field"], "v", F.col("h") >= 1705276800)


@query("a48_curve_extremes", f"{PAIRS}, c AS (SELECT station, step % 24 AS hour, avg(error) AS e FROM pairs GROUP BY ALL), a AS (SELECT station, e - avg(e) OVER (PARTITION BY station) AS e FROM c) SELECT a.station, max(e) AS peak, min(e) AS trough, any_value(elev) AS elev FROM a JOIN stations s ON s.station = a.station GROUP BY a.station", "peak trough elev")
def _(t: Tables) -> DataFrame:
    curve = pairs(t).groupBy("station", (F.col("step") % 24).alias("hour")).agg(F.avg("error").alias("error"))
    ends = agg.unbiased(curve, ["station"]).groupBy("station").agg(F.max("error").alias("peak"), F.min("error").alias("trough"))
    return ends.join(t.stations.select("station", "elev"), "station")


@query("a49_daily_mean_fit", f"{PAIRS}, m AS (SELECT station, valid // 86400 AS d, avg(obs) AS x, avg(model) AS y FROM pairs GROUP BY ALL) SELECT station, count(*) AS n, {LSQ} FROM m GROUP BY station", "slope icpt rmse r2_adj")
def _(t: Tables) -> DataFrame:
    means = pairs(t).groupBy("station", F.expr("valid DIV 86400").alias("day")).agg(F.avg("obs").alias("x"), F.avg("model").alias("y"))
    return agg.line_fit(means, ["station"], "x", "y")


@query("a50_diurnal_cycle", "SELECT field, h % 86400 // 3600 AS hour, avg(v) AS v, count(v) AS n FROM hourly GROUP BY ALL", "v")
def _(t: Tables) -> DataFrame:
    return t.hourly.groupBy("field", F.expr("h % 86400 DIV 3600").alias("hour")).agg(F.avg("v").alias("v"), F.count("v").alias("n"))
