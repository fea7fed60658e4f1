"""Queries over joins, comparisons and binning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.operators import aggregate, binning, compare, join
from cirrostrat.plans.registry import Tables, query

ALIGNED = "aligned AS (SELECT f.station, f.start, f.step, f.valid, f.v, o.v AS obs FROM (SELECT *, (valid + 20 + 1800) - (valid + 20 + 1800) % 3600 AS hr FROM fcst) f LEFT JOIN seen o ON o.station = f.station AND o.h = f.hr)"
#: Two versions of the hourly table: the second lacks some rows, has others, and changes and blanks values.
VERSIONS = "va AS (SELECT field, h, CASE WHEN h // 3600 % 11 = 0 THEN NULL ELSE v END AS v FROM series WHERE h // 3600 % 13 <> 0), vb AS (SELECT field, h, CASE WHEN h // 3600 % 11 = 0 OR h // 3600 % 19 = 0 THEN NULL WHEN h // 3600 % 17 = 0 THEN v + h // 3600 % 5 ELSE v END AS v FROM series WHERE h // 3600 % 29 <> 0)"


def aligned(t: Tables) -> DataFrame:
    late = t.fcst.withColumn("t", F.col("valid") + 20)
    return join.align(late, t.seen.select("station", "h", F.col("v").alias("obs")), valid="t", ts="h").drop("t")


def versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.expr("h DIV 3600")
    a = t.series.filter(k % 13 != 0).select("field", "h", F.when(k % 11 != 0, F.col("v")).alias("v"))
    b = t.series.filter(k % 29 != 0).select("field", "h", F.when((k % 11 != 0) & (k % 19 != 0), F.when(k % 17 == 0, F.col("v") + k % 5).otherwise(F.col("v"))).alias("v"))
    return a, b


@query("j1_align", f"{ALIGNED} SELECT station, start, step, v, obs FROM aligned", "v obs")
def _(t: Tables) -> DataFrame:
    return aligned(t).select("station", "start", "step", "v", "obs")


@query("j2_errors", f"{ALIGNED} SELECT station, start, step, CASE WHEN step <> 0 THEN v - obs END AS error FROM aligned", "error")
def _(t: Tables) -> DataFrame:
    return join.errors(aligned(t), "v", "obs", accumulated=True).select("station", "start", "step", "error")


@query("j3_humidity", "x AS (SELECT r.station, r.h, r.v % 100 AS rh, 270 + t.v % 30 AS t, (90 + p.v % 10) * 1000 AS p FROM hourly r JOIN hourly t ON t.station = r.station AND t.h = r.h AND t.field = 'view' JOIN hourly p ON p.station = r.station AND p.h = r.h AND p.field = 'error' WHERE r.field = 'click'), e AS (SELECT *, 610.94 * exp(17.625 * (t - 273.15) / (t - 30.11)) AS es FROM x) SELECT station, h, rh * (0.622 * es / (p - es)) / 100 AS w FROM e", "w")
def _(t: Tables) -> DataFrame:
    part = lambda field, v: t.hourly.filter(F.col("field") == field).select("station", "h", v.alias("v"))
    return join.observed_mixing_ratio(part("click", F.col("v") % 100), part("view", 270 + F.col("v") % 30), part("error", 90 + F.col("v") % 10), ("station", "h"))


@query("j4_fill_over", f"{VERSIONS} SELECT coalesce(a.field, b.field) AS field, coalesce(a.h, b.h) AS h, coalesce(a.v, b.v) AS v, b.x FROM va a FULL JOIN (SELECT *, v * 2 AS x FROM vb) b ON a.field = b.field AND a.h = b.h", "v x")
def _(t: Tables) -> DataFrame:
    a, b = versions(t)
    return join.fill_over(a, b.withColumn("x", F.col("v") * 2), ["field", "h"])


@query("j5_continued", "SELECT field, h, v FROM series WHERE h < 1705276800 UNION ALL SELECT field, h, v + 1 FROM series WHERE h >= 1705276800", "v")
def _(t: Tables) -> DataFrame:
    new = t.series.filter("h >= 1705276800").withColumn("v", F.col("v") + 1)
    first = new.groupBy("field").agg(F.min("h").alias("h"))
    return join.continued(t.series.unionByName(first.withColumn("v", F.lit(-1.0))), new, ["field"], "h")


@query("j6_merged_sensors", "x AS (SELECT sensor, min(t) AS first, max(t) AS last, (sensor % 3)::DOUBLE AS elev FROM obs WHERE field = 'view' GROUP BY sensor UNION ALL SELECT sensor, min(t), max(t), -(sensor % 3)::DOUBLE FROM obs WHERE field = 'click' GROUP BY sensor) SELECT sensor, min(first) AS first, max(last) AS last, min(elev) AS elev FROM x GROUP BY sensor", "elev")
def _(t: Tables) -> DataFrame:
    part = lambda field, sign: t.obs.filter(F.col("field") == field).groupBy("sensor").agg(F.min("t").alias("first"), F.max("t").alias("last")).withColumn("elev", (F.col("sensor") % 3 * sign).cast("double"))
    return join.merged_sensors(part("view", 1), part("click", -1))


@query("j7_station_history", "SELECT sensor, arg_max(CASE WHEN v > 20 THEN v END, id) FILTER (v > 20) AS a, arg_max(field, id) AS b FROM obs GROUP BY sensor", "a")
def _(t: Tables) -> DataFrame:
    shots = t.obs.select("sensor", "id", F.when(F.col("v") > 20, F.col("v")).alias("a"), F.col("field").alias("b"))
    return join.station_history(shots, "sensor", "id", ["a", "b"])


@query("j8_update_spans", "s AS (SELECT sensor, min(t) AS first FROM obs GROUP BY sensor), l AS (SELECT sensor, max(t) AS last FROM obs WHERE field = 'view' AND sensor % 3 > 0 GROUP BY sensor) SELECT s.sensor, coalesce(last - 86400, first) AS from_s FROM s LEFT JOIN l USING (sensor) WHERE NOT 1706572800 - coalesce(last, first) >= 5 * 86400")
def _(t: Tables) -> DataFrame:
    stored = t.obs.filter("field = 'view' AND sensor % 3 > 0").groupBy("sensor").agg(F.max("t").alias("last"))
    return join.update_spans(t.obs.groupBy("sensor").agg(F.min("t").alias("first")), stored, "sensor", 1706572800, drop=5 * 86400)


@query("j9_key_logic", "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'a' WHEN a.k IS NULL THEN 'b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k")
def _(t: Tables) -> DataFrame:
    part = lambda s: t("orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return join.key_logic(part("F"), part("P"), "k")


@query("j10_as_of", "l AS (SELECT id, field, t FROM obs), r AS (SELECT field, h AS t, v AS price FROM series) SELECT id, l.field, price FROM l ASOF LEFT JOIN r ON l.field = r.field AND l.t >= r.t", "price")
def _(t: Tables) -> DataFrame:
    right = t.series.select("field", "h", F.col("v").alias("price"))
    return join.as_of(t.obs.select("id", "field", "t"), right, ["field"], "t", "price", right_ts="h").select("id", "field", "price")


@query("j11_nearest", "l AS (SELECT DISTINCT t FROM obs), r AS (SELECT DISTINCT h FROM seen), n AS (SELECT l.t, (SELECT max(h) FROM r WHERE h <= l.t AND l.t - h <= 21600) AS run FROM l), m AS (SELECT l.t, arg_min(h, abs(l.t - h) * 1e6 + (h - l.t)) AS nearest FROM l JOIN r ON abs(l.t - h) <= 21600 GROUP BY l.t) SELECT n.t, run, nearest FROM n LEFT JOIN m USING (t)")
def _(t: Tables) -> DataFrame:
    times, runs = t.obs.select("t").distinct(), t.seen.select("h").distinct()
    return join.nearest_in_time(join.nearest_before(times, runs, "t", "h", 21600), runs, "t", "h", 21600)


@query("j12_interval_sums", "p AS (SELECT station, h AS a, lead(h) OVER (PARTITION BY station ORDER BY h) AS e FROM hourly WHERE field = 'signup') SELECT p.station, a AS start, e AS \"end\", coalesce(sum(v), 0) AS total, count(v) AS n FROM p LEFT JOIN obs o ON o.station = p.station AND o.field = 'view' AND o.t > a AND o.t <= e WHERE e IS NOT NULL GROUP BY ALL", "total")
def _(t: Tables) -> DataFrame:
    passes = t.hourly.filter("field = 'signup'").select("station", "h")
    return join.interval_sums(t.obs.filter("field = 'view'"), passes, ["station"], "t", "v", "h")


@query("j13_complete_pairs", f"{VERSIONS} SELECT field, h, a.v AS x, b.v AS y FROM va a JOIN vb b USING (field, h) WHERE a.v IS NOT NULL AND b.v IS NOT NULL", "x y")
def _(t: Tables) -> DataFrame:
    a, b = versions(t)
    return join.complete_pairs(a.withColumnRenamed("v", "x"), b.withColumnRenamed("v", "y"), ["field", "h"])


@query("j14_lag_correlation", "SELECT x.field, lag::BIGINT AS lag, count(*) AS n, corr(x.v, y.v) AS r FROM series x, (VALUES (0), (3600), (7200)) AS l(lag), series y WHERE y.field = x.field AND y.h + lag = x.h GROUP BY ALL", "r")
def _(t: Tables) -> DataFrame:
    return aggregate.correlation(join.lagged_pairs(t.series, t.series, ["field"], "h", [0, 3600, 7200]), ["field", "lag"], "x", "y").drop("t")


@query("j27_elevation", "SELECT f.station, start, step, 500 - elev AS dz, CASE WHEN elev < 500 THEN 'above' ELSE 'below' END AS class FROM fcst f JOIN stations s ON s.station = f.station", "dz")
def _(t: Tables) -> DataFrame:
    out = join.elevation_difference(t.fcst, t.stations, F.lit(500.0))
    return out.select("station", "start", "step", "dz", F.when(F.col("dz") > 0, F.lit("above")).otherwise(F.lit("below")).alias("class"))


@query("j28_ensemble", "g AS (SELECT station, valid, count(*) AS runs, avg(v) AS mean, stddev_samp(v) AS spread, array_to_string(list_sort(list(DISTINCT (start // 86400 % 5)::INT)), ',') AS ages FROM fcst GROUP BY ALL) SELECT g.*, s.v AS obs FROM g LEFT JOIN seen s ON s.station = g.station AND s.h = g.valid", "mean spread obs")
def _(t: Tables) -> DataFrame:
    return join.lagged_ensemble(t.fcst, t.seen, 5).withColumn("ages", F.array_join("ages", ","))


@query("t1_largest_mismatches", f"{VERSIONS}, x AS (SELECT field, h, floor(a.v)::BIGINT AS a, floor(b.v)::BIGINT AS b FROM va a JOIN vb b USING (field, h)) SELECT field, h, a, b, abs(a - b) AS diff FROM x WHERE abs(a - b) > 0 AND h < (SELECT least((SELECT max(h) FROM va), (SELECT max(h) FROM vb))) ORDER BY diff DESC, field, h LIMIT 20")
def _(t: Tables) -> DataFrame:
    a, b = (v.withColumn("v", F.floor("v")) for v in versions(t))
    return compare.largest_mismatches(a, b, ["field", "h"], "h", "v", 20)


@query("t2_dominating", "SELECT station, h, v AS a, elev_ AS b, v / elev_ AS ratio FROM (SELECT station, h, v, (station + 1)::DOUBLE AS elev_ FROM seen) WHERE v / elev_ > 10 ORDER BY ratio, station, h LIMIT 10", "a b ratio")
def _(t: Tables) -> DataFrame:
    rows = t.seen.select("station", "h", F.col("v").alias("a"), (F.col("station") + 1).cast("double").alias("b"))
    return compare.dominating(rows, "a", "b", 10.0, 10, ["station", "h"])


@query("t3_candidates", "SELECT field, station, h, row_number() OVER (PARTITION BY field ORDER BY v DESC, station, h)::INT AS place FROM hourly")
def _(t: Tables) -> DataFrame:
    return compare.candidates(t.hourly, "v", ["field", "station", "h"]).drop("v")


@query("t4_ends", "SELECT station, h, v FROM seen QUALIFY row_number() OVER (PARTITION BY station ORDER BY h DESC) <= 3", "v")
def _(t: Tables) -> DataFrame:
    return compare.ends(t.seen, ["station"], "h", 3, last=True)


@query("t4_longest_record", "SELECT station, count(v) AS n FROM hourly GROUP BY station ORDER BY n DESC, station LIMIT 1")
def _(t: Tables) -> DataFrame:
    return compare.longest_record(t.hourly, "station", "v")


@query("t5_joined_runs", "x AS (SELECT station, start, step, v, NULL::DOUBLE AS w, 0 AS k FROM fcst WHERE start % 172800 = 0 AND step < 60 UNION ALL SELECT station, start, step, v, v * 2, 1 FROM fcst WHERE start % 172800 <> 0), r AS (SELECT min(m) AS m FROM (SELECT max(step) AS m FROM x GROUP BY k)) SELECT station, start, step, v, w FROM x, r WHERE step <= m", "v w")
def _(t: Tables) -> DataFrame:
    a = t.fcst.filter("start % 172800 = 0 AND step < 60").select("station", "start", "step", "v")
    b = t.fcst.filter("start % 172800 <> 0").select("station", "start", "step", "v", (F.col("v") * 2).alias("w"))
    return compare.joined_runs([a, b], "step")


@query("t6_first_of_each", "SELECT sensor, field, id FROM obs QUALIFY row_number() OVER (PARTITION BY sensor, field ORDER BY t, id) = 1")
def _(t: Tables) -> DataFrame:
    return compare.first_of_each(t.obs, ["sensor", "field"], ["t", "id"]).select("sensor", "field", "id")


SETS = "a AS (SELECT DISTINCT sensor AS k FROM obs WHERE v > 150), b AS (SELECT DISTINCT sensor AS k FROM obs WHERE field = 'view' AND v > 100)"


@query("t7_key_sets", f"{SETS} SELECT k, 'all' AS how FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'first' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'odd' FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a))")
def _(t: Tables) -> DataFrame:
    sets = [t.obs.filter("v > 150").select(F.col("sensor").alias("k")), t.obs.filter("field = 'view' AND v > 100").select(F.col("sensor").alias("k"))]
    out = [compare.key_sets(sets, "k", how).withColumn("how", F.lit(how)) for how in ("all", "first", "odd")]
    return out[0].unionByName(out[1]).unionByName(out[2])


FULL = "f AS (SELECT coalesce(a.field, b.field) AS field, coalesce(a.h, b.h) AS h, a.v AS a, b.v AS b, a.h IS NOT NULL AS ia, b.h IS NOT NULL AS ib FROM va a FULL JOIN vb b ON a.field = b.field AND a.h = b.h)"


@query("t8_table_diff", f"{VERSIONS}, {FULL} SELECT field, count(*) FILTER (ia AND NOT ib) AS only_a, count(*) FILTER (ib AND NOT ia) AS only_b, count(*) FILTER (ia AND ib AND a IS DISTINCT FROM b) AS unequal, min(h) FILTER (ia AND ib) AS start, max(h) FILTER (ia AND ib) AS \"end\" FROM f GROUP BY field")
def _(t: Tables) -> DataFrame:
    return compare.table_diff(*versions(t), "field", ["h"], "h", "v")


@query("t9_inequality", f"{VERSIONS}, {FULL} SELECT field, count(*) FILTER (a IS NOT DISTINCT FROM b) AS equal, count(*) FILTER (a IS DISTINCT FROM b) AS unequal, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS missing, min(h) FILTER (a IS DISTINCT FROM b) AS first_unequal FROM f WHERE ia AND ib GROUP BY field")
def _(t: Tables) -> DataFrame:
    return compare.inequality(*versions(t), "field", "h", "v")


@query("t10_spread_differences", f"{VERSIONS}, {FULL} SELECT field, max(h) - min(h) AS span FROM f WHERE ia AND ib AND a IS DISTINCT FROM b GROUP BY field HAVING max(h) > min(h)")
def _(t: Tables) -> DataFrame:
    return compare.spread_differences(*versions(t), "field", "h", "v")


@query("t11_differing_cells", f"{VERSIONS}, {FULL} SELECT field, h, a, b FROM f WHERE ia AND ib AND a <> b", "a b")
def _(t: Tables) -> DataFrame:
    return compare.differing_cells(*versions(t), ["field", "h"], "v")


#: Records of 5, 15 or 60 minutes by sensor, stamped a little off the hour.
RECORDS = "rec AS (SELECT sensor, t, [300, 900, 3600][sensor % 3 + 1]::BIGINT AS len, CASE WHEN id % 10 > 0 THEN v END AS ave, v - 1 AS lo, v + 1 AS hi FROM obs)"


def records(t: Tables) -> DataFrame:
    length = F.element_at(F.array(*(F.lit(x).cast("long") for x in (300, 900, 3600))), (F.col("sensor") % 3 + 1).cast("int"))
    return t.obs.select("sensor", "t", length.alias("len"), F.when(F.col("id") % 10 > 0, F.col("v")).alias("ave"), (F.col("v") - 1).alias("min"), (F.col("v") + 1).alias("max"))


BINS = """{r}, a AS (SELECT *, (t - len - {s}) - (((t - len - {s}) % 3600) + 3600) % 3600 + {s} AS b FROM rec), o AS (SELECT *, t - b - 3600 AS over FROM a),
    p AS (SELECT sensor, t, len, ave, lo, hi, b AS bin, CASE WHEN over > 0 THEN len - over ELSE len END AS w, over FROM o UNION ALL SELECT sensor, t, len, ave, lo, hi, b + 3600, over, over FROM o WHERE over > 0),
    q AS (SELECT *, w * 2 > len OR (w * 2 = len AND t > bin + 3600) AS larger FROM p)
    SELECT sensor, (bin + {l})::BIGINT AS bin, sum(CASE WHEN ave IS NOT NULL THEN w END * ave) / sum(CASE WHEN ave IS NOT NULL THEN w END) AS ave, min(lo) FILTER (larger) AS min, max(hi) FILTER (larger) AS max FROM q GROUP BY sensor, bin"""


@query("a1_weighted_bins", BINS.format(r=RECORDS, s=0, l=3600), "ave min max")
def _(t: Tables) -> DataFrame:
    return binning.weighted_bins(records(t), ["sensor"], "t", F.col("len"))


#: Stamps rounded to ten minutes, so that there are six marks.
MARKED = "m0 AS (SELECT field AS sensor, t - t % 600 AS t, avg(v) AS ave, min(v) AS lo, max(v) AS hi FROM obs GROUP BY ALL), mk AS (SELECT DISTINCT sensor, t % 3600 AS mark FROM m0), ml AS (SELECT sensor, mark, mark - coalesce(lag(mark) OVER (PARTITION BY sensor ORDER BY mark), max(mark) OVER (PARTITION BY sensor) - 3600) AS len FROM mk), rec AS (SELECT m0.*, len FROM m0 JOIN ml ON ml.sensor = m0.sensor AND ml.mark = m0.t % 3600)"


@query("a2_hourly_by_marks", BINS.format(r=MARKED, s=1800, l=1800), "ave min max")
def _(t: Tables) -> DataFrame:
    rows = t.obs.groupBy(F.col("field").alias("sensor"), F.expr("t - t % 600").alias("t")).agg(F.avg("v").alias("ave"), F.min("v").alias("min"), F.max("v").alias("max"))
    return binning.hourly_by_marks(rows, ["sensor"], "t", centred=True)


@query("a3_trapezoid", "r AS (SELECT field, t - t % 300 AS s, avg(v) AS v FROM obs GROUP BY ALL), l AS (SELECT field, min(d) AS d FROM (SELECT field, s - lag(s) OVER (PARTITION BY field ORDER BY s) AS d FROM r) GROUP BY field), m AS (SELECT r.field, s - d / 2 AS s, v, ((s - d / 2) - (s - d / 2) % 3600)::BIGINT AS h FROM r JOIN l USING (field)), g AS (SELECT *, s - lag(s) OVER w AS dt, (v + lag(v) OVER w) / 2 * (s - lag(s) OVER w) AS a FROM m WINDOW w AS (PARTITION BY field, h ORDER BY s)) SELECT field, h + 3600 AS bin, sum(a) / sum(dt) AS ave, min(v) AS min, max(v) AS max FROM g GROUP BY field, h", "ave min max")
def _(t: Tables) -> DataFrame:
    rows = t.obs.groupBy("field", F.expr("t - t % 300").alias("s")).agg(F.avg("v").alias("v"))
    return binning.trapezoid_hours(rows, ["field"], "s", "v")


@query("a4_backfilled", (BINS.format(r="x0 AS (SELECT field AS sensor, t - t % 300 AS t, avg(v) AS ave FROM obs GROUP BY ALL), rec AS (SELECT *, ave AS lo, ave AS hi, least(3600, coalesce(t - lag(t) OVER w, lead(t) OVER w - t, 3600)) AS len FROM x0 WINDOW w AS (PARTITION BY sensor ORDER BY t))", s=0, l=3600)).replace(", min(lo) FILTER (larger) AS min, max(hi) FILTER (larger) AS max", ""), "ave")
def _(t: Tables) -> DataFrame:
    rows = t.obs.groupBy(F.col("field").alias("sensor"), F.expr("t - t % 300").alias("t")).agg(F.avg("v").alias("ave"))
    return binning.hours_with_backfilled_length(rows, ["sensor"], "t", "ave", longest=3600)


@query("flagship_validation", f"{ALIGNED} SELECT station, step // 24 AS lead, count(v - obs) AS n, avg(v - obs) AS bias, sqrt(avg((v - obs) * (v - obs))) AS rmse, avg(abs(v - obs)) AS mae, stddev_samp(v - obs) AS std FROM aligned GROUP BY ALL", "bias rmse mae std")
def flagship(t: Tables) -> DataFrame:
    """Hourly errors of forecasts by station and lead day."""
    return aggregate.error_statistics(join.errors(aligned(t), "v", "obs").withColumn("lead", F.expr("step DIV 24")), ["station", "lead"])


OBSERVED = """p AS (SELECT station, field, (t - 900) - (t - 900) % 3600 AS b, t, v FROM obs WHERE field IN ('view', 'error')), q AS (SELECT station, field, b, v, 900 - greatest(0, t - b - 3600) AS w FROM p UNION ALL SELECT station, field, b + 3600, v, t - b - 3600 FROM p WHERE t > b + 3600),
    hr AS (SELECT station, field, b + 3600 AS h, sum(w * v) / sum(w) AS obs FROM q GROUP BY ALL),
    e AS (SELECT f.station, f.step, x.variable, CASE WHEN x.variable = 't2' THEN f.v - (hr.obs + 273.15) WHEN f.step <> 0 THEN f.v - hr.obs END AS error FROM fcst f CROSS JOIN (VALUES ('t2', 'view'), ('rain', 'error')) AS x(variable, field) LEFT JOIN hr ON hr.station = f.station AND hr.field = x.field AND hr.h = f.valid)"""


@query("u3_validation_report", f"{OBSERVED} SELECT variable, station, (step // 24)::INT AS lead, count(error) AS n, avg(error) AS bias, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae, stddev_samp(error) AS std FROM e GROUP BY ALL", "bias rmse mae std")
def _(t: Tables) -> DataFrame:
    from cirrostrat.plans import validation

    found = [validation.variable_errors(t.fcst, t.obs, name, F.lit(900)) for name in validation.VARIABLES]
    return validation.report(found[0].unionByName(found[1]))
