"""Queries over selections and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions import geo, physics, times
from cirrostrat.operators import compare, select
from cirrostrat.plans.registry import Tables, query

CORNERS = [(-71.013, -31.017), (-69.5, -31.23), (-69.2, -29.6), (-70.8, -29.4)]
QUAD_SQL = " AND ".join(f"({x1} - {x0}) * (lat - {y0}) - ({y1} - {y0}) * (lon - {x0}) >= 0" for (x0, y0), (x1, y1) in zip(CORNERS, CORNERS[1:] + CORNERS[:1]))


@query("p1_cross_section", "SELECT id, sensor, v FROM obs WHERE station IN (3, 4) AND field = 'view'")
def _(t: Tables) -> DataFrame:
    return select.cross_section(t.obs, station=[3, 4], field="view").select("id", "sensor", "v")


@query("p2_extract", "SELECT station, s_suppkey AS sensor, elev + 273.15 AS v FROM (SELECT s_nationkey AS station, s_suppkey, s_acctbal AS elev FROM supplier) WHERE elev <> 73.0", "v")
def _(t: Tables) -> DataFrame:
    rows = t("supplier").select(F.col("s_nationkey").alias("station"), F.col("s_suppkey").alias("sensor"), F.col("s_acctbal").alias("elev"), F.col("s_acctbal").alias("v"))
    return select.extract(rows, "v", without_elev=73.0, to_kelvin=True).drop("elev")


@query("p3_station_labels", "SELECT id, CASE WHEN (SELECT max(n) > 1 FROM (SELECT count(DISTINCT sensor) AS n FROM obs GROUP BY station)) THEN sensor ELSE station END::VARCHAR AS label FROM obs")
def _(t: Tables) -> DataFrame:
    return select.station_labels(t.obs).select("id", "label")


@query("p4_nearest_height", "SELECT s_nationkey AS station, s_suppkey AS sensor, s_acctbal AS elev FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal - 2000), s_suppkey) = 1")
def _(t: Tables) -> DataFrame:
    sensors = t("supplier").select(F.col("s_nationkey").alias("station"), F.col("s_suppkey").alias("sensor"), F.col("s_acctbal").alias("elev"))
    return select.nearest_height(sensors, ["station"], 2000.0)


@query("p5_preferred_height", "SELECT p_brand AS station, p_partkey AS sensor, p_size AS elev FROM part WHERE p_size IN (2, 5, 10, 3, 30) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY list_position([2, 5, 10, 3, 30], p_size), p_partkey) = 1")
def _(t: Tables) -> DataFrame:
    sensors = t("part").select(F.col("p_brand").alias("station"), F.col("p_partkey").alias("sensor"), F.col("p_size").alias("elev"))
    return select.preferred(sensors, ["station"], "elev", [2, 5, 10, 3, 30], "sensor")


@query("p6_box", "SELECT station FROM stations WHERE lon BETWEEN -70.6 AND -69.7 AND lat BETWEEN -30.5 AND -29.7")
def _(t: Tables) -> DataFrame:
    return t.stations.filter(geo.in_box(F.col("lon"), F.col("lat"), -70.6, -30.5, -69.7, -29.7)).select("station")


@query("p7_domain", f"SELECT station FROM stations WHERE {QUAD_SQL}")
def _(t: Tables) -> DataFrame:
    return t.stations.filter(geo.in_quadrilateral(F.col("lon"), F.col("lat"), CORNERS)).select("station")


@query("p8_polygon_sensors", f"SELECT o.id FROM obs o JOIN (SELECT station FROM stations WHERE {QUAD_SQL}) s USING (station) WHERE station IN (SELECT station FROM obs GROUP BY station HAVING count(v) > 0)")
def _(t: Tables) -> DataFrame:
    inside = t.stations.filter(geo.in_quadrilateral(F.col("lon"), F.col("lat"), CORNERS)).select("station")
    return select.with_values(t.obs.join(inside, "station", "left_semi"), ["station"], "v").select("id")


@query("p9_periods", "SELECT id FROM obs WHERE (t // 3600) % 24 IN (0, 12) AND t < epoch(TIMESTAMP '2024-01-18')")
def _(t: Tables) -> DataFrame:
    return t.obs.filter(F.hour("ts").isin(0, 12) & (F.col("ts") < F.lit("2024-01-18").cast("timestamp"))).select("id")


@query("p10_runs", "SELECT DISTINCT start FROM fcst WHERE start >= 1704326400 AND start NOT IN (SELECT h FROM seen)")
def _(t: Tables) -> DataFrame:
    runs = t.fcst.select("start").distinct().withColumn("dir", F.date_format(F.timestamp_seconds("start"), "'c01_'yyyyMMddHH"))
    return select.select_runs(runs, done=t.seen.select(F.col("h").alias("start")), pattern=r"^c01_\d{10}$", first=1704326400, hour=0).select("start")


@query("p11_lead_day", "SELECT station, start, step, v FROM fcst WHERE (valid - start) // 86400 = 1", "v")
def _(t: Tables) -> DataFrame:
    by_time = select.lead_day(t.fcst, 1)
    return select.lead_steps(by_time, 1).select("station", "start", "step", "v")


@query("p13_valid_months", "SELECT field, d, v FROM daily WHERE field IN (SELECT field FROM daily GROUP BY field HAVING count(DISTINCT date_trunc('month', date)) >= 12)", "v")
def _(t: Tables) -> DataFrame:
    return select.valid_months(t.daily.withColumn("s", F.col("d") * 86400), "field", "s", "v").select("field", "d", "v")


@query("p13_well_covered", "n AS (SELECT station, count(v) AS n FROM hourly GROUP BY station) SELECT station, count(*)::BIGINT AS n FROM hourly WHERE station IN (SELECT station FROM n WHERE n > 0.97 * (SELECT max(n) FROM n)) GROUP BY station")
def _(t: Tables) -> DataFrame:
    return select.well_covered(t.hourly, ["station"], "v", 0.97).groupBy("station").agg(F.count("*").alias("n"))


@query("p14_land_mask", "SELECT d, i, j, v FROM grid WHERE (i * 7 + j) % 3 <> 0", "v")
def _(t: Tables) -> DataFrame:
    mask = t.grid.select("i", "j").distinct().withColumn("land", ((F.col("i") * 7 + F.col("j")) % 3 != 0).cast("int"))
    return select.land_only(t.grid, mask, ["i", "j"]).select("d", "i", "j", "v")


@query("p14_never_valid", "SELECT i, j FROM grid GROUP BY i, j HAVING count(CASE WHEN (i + j) % 4 > 0 THEN v END) = 0")
def _(t: Tables) -> DataFrame:
    return select.never_valid(t.grid.withColumn("v", F.when((F.col("i") + F.col("j")) % 4 > 0, F.col("v"))), ["i", "j"], "v")


@query("p15_switches", "SELECT sensor, first, switch FROM (SELECT sensor, min(t) AS first, min(CASE WHEN v > 60 THEN t END) AS switch FROM obs GROUP BY sensor) WHERE switch - first < 5 * 86400")
def _(t: Tables) -> DataFrame:
    sensors = t.obs.groupBy("sensor").agg(F.min("t").alias("first"), F.min(F.when(F.col("v") > 60, F.col("t"))).alias("switch"))
    return select.precise_switches(sensors, "first", "switch")


@query("p16_pivot", "SELECT h - h % 86400 AS day, avg(v) FILTER (field = 'click') AS click, avg(v) FILTER (field = 'view') AS view FROM hourly GROUP BY 1", "click view")
def _(t: Tables) -> DataFrame:
    return select.wide(t.hourly.withColumn("day", times.floor_to("h", 86400)), ["day"], "field", ["click", "view"], F.avg("v"))


@query("p17_unpivot", "SELECT c_custkey AS k, 'bal' AS name, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'half', nullif(c_acctbal / 2, 0) FROM customer WHERE c_acctbal > 100", "value")
def _(t: Tables) -> DataFrame:
    rows = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.when(F.col("c_acctbal") > 100, F.nullif(F.col("c_acctbal") / 2, F.lit(0.0))).alias("half"))
    return select.long(rows, ["k"], ["bal", "half"])


@query("p18_local_cycle", "SELECT (step + 20) % 24 AS hour, avg(v) AS v FROM fcst GROUP BY 1", "v")
def _(t: Tables) -> DataFrame:
    return select.local_cycle(t.fcst, "step", 20).groupBy("hour").agg(F.avg("v").alias("v"))


@query("p19_one_match", "SELECT station FROM stations WHERE name ILIKE '%00000007' ")
def _(t: Tables) -> DataFrame:
    return select.one_match(t.stations, "name", "supplier#000000007").select("station")


@query("p20_link_kind", "SELECT page_id, contains(url, '.html') AS plain, starts_with(url, 'https:') AS secure FROM pages")
def _(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.contains("url", F.lit(".html")).alias("plain"), (F.substring_index("url", ":", 1) == "https").alias("secure"))


@query("p21_excluded_and_blanked", "SELECT id, CASE WHEN sensor % 4 = 1 AND t BETWEEN 1704844800 AND 1705276800 THEN NULL ELSE v END AS v FROM obs WHERE sensor % 10 <> 7 OR field <> 'error'")
def _(t: Tables) -> DataFrame:
    sensors = t.obs.select("sensor").distinct()
    suspicious = sensors.filter("sensor % 10 = 7").withColumn("field", F.lit("error"))
    periods = sensors.filter("sensor % 4 = 1").select("sensor", F.lit(1704844800).cast("long").alias("from_s"), F.lit(1705276800).cast("long").alias("to_s"))
    return select.blanked(select.without(t.obs, suspicious, ["sensor", "field"]), periods, "sensor", "t", "v").select("id", "v")


@query("m1_m2_m3_humidity", """
    raw_ AS (SELECT event_id AS id, 270 + value % 30 AS t, 90000 + value * 10 AS p, value % 100 AS rh FROM events),
    sat AS (SELECT *, 610.94 * exp(17.625 * (t - 273.15) / (t - 30.11)) AS es FROM raw_), w AS (SELECT *, 0.622 * es / (p - es) AS ws FROM sat)
    SELECT id, es, ws, rh * ws / 100 AS w, (rh * ws / 100) / (rh * ws / 100 + 0.622) * p AS e, greatest(0, least(100, 100 * (rh * ws / 100) / ws)) AS back FROM w""", "es ws w e back")
def _(t: Tables) -> DataFrame:
    rows = t("events").select(F.col("event_id").alias("id"), (270 + F.col("value") % 30).alias("t"), (90000 + F.col("value") * 10).alias("p"), (F.col("value") % 100).alias("rh"))
    temp, p = F.col("t"), F.col("p")
    w = physics.mixing_ratio(F.col("rh"), temp, p)
    return rows.select("id", physics.saturation_pressure(temp).alias("es"), physics.saturation_mixing_ratio(temp, p).alias("ws"), w.alias("w"), physics.vapour_pressure(w, p).alias("e"), physics.relative_humidity(w, temp, p, clip=True).alias("back"))


@query("m4_m5_m7_m10_scalars", """
    SELECT event_id AS id, (280 + value % 40) * pow((50000 + value * 50) / 100000, 0.286) AS temp, -(value % 20) * sin(radians(value)) AS u, -(value % 20) * cos(radians(value)) AS w,
           value + 0.0065 * (value * 3 - 100) AS corrected, 1013 * pow(1 - 0.0065 * value / 293, 5.26) AS p FROM events""", "temp u w corrected p")
def _(t: Tables) -> DataFrame:
    v = F.col("value")
    u, w = physics.wind_components(v % 20, v)
    return t("events").select(F.col("event_id").alias("id"), physics.temperature(280 + v % 40, 50000 + v * 50).alias("temp"), u.alias("u"), w.alias("w"), physics.elevation_corrected(v, v * 3, F.lit(100)).alias("corrected"), physics.pressure_at(v).alias("p"))


@query("m6_sounding_ratios", """
    levels AS (SELECT event_id AS id, (20000 + value * 200)::DOUBLE AS p, (value * 7 % 400 - 200)::DOUBLE AS t10, CASE WHEN event_id % 3 > 0 THEN value % 150 END AS dd, CASE WHEN event_id % 4 > 0 THEN value * 3 % 1000 END AS rh10 FROM events),
    e AS (SELECT *, 610.94 * exp(17.625 * (t10 / 10 - dd / 10) / (243.04 + t10 / 10 - dd / 10)) AS ed, 610.94 * exp(17.625 * (t10 / 10) / (243.04 + t10 / 10)) * rh10 / 1000 AS er FROM levels)
    SELECT id, 0.622 * ed / (p - ed) AS by_dew, 0.622 * er / (p - er) AS by_rh FROM e WHERE ed IS NOT NULL OR er IS NOT NULL""", "by_dew by_rh")
def _(t: Tables) -> DataFrame:
    v, k = F.col("value"), F.col("event_id")
    dew, rh = physics.sounding_mixing_ratios(20000 + v * 200, v * 7 % 400 - 200, F.when(k % 3 > 0, v % 150), F.when(k % 4 > 0, v * 3 % 1000))
    return t("events").select(k.alias("id"), dew.alias("by_dew"), rh.alias("by_rh")).filter("by_dew IS NOT NULL OR by_rh IS NOT NULL")


RADIATION_SQL = """
    sun AS (SELECT station, radians(lat) AS lat, elev, doy, 0.409 * sin(2 * pi() * doy / 365 - 1.39) AS dec, 1 + 0.033 * cos(2 * pi() * doy / 365) AS r
            FROM stations, (SELECT unnest(range(1, 366, 30)) AS doy)),
    ws AS (SELECT *, acos(greatest(-1, least(1, -tan(lat) * tan(dec)))) AS ws FROM sun),
    ang AS (SELECT *, greatest(-ws, least(ws, (h - 12) * pi() / 12)) AS a, greatest(-ws, least(ws, (h - 12) * pi() / 12 + pi() / 12)) AS b FROM ws, (VALUES (7), (12), (17)) AS x(h)),
    ra AS (SELECT *, 1367 / pi() * r * (ws * sin(lat) * sin(dec) + cos(lat) * cos(dec) * sin(ws)) AS daily,
           greatest(0, 1367 * r * (12 / pi() * ((b - a) * sin(lat) * sin(dec) + cos(lat) * cos(dec) * (sin(b) - sin(a))))) AS hourly FROM ang)
    SELECT station, doy, h, daily, hourly, (0.75 + 2e-5 * elev) * daily AS clear_daily, hourly * exp(-1.8e-4 * 900 / 0.5) AS clear_hourly,
           1.021 - 0.084 * sqrt(35 / sqrt(1224 * 0.25 + 1) * (949e-6 * 900 + 0.051)) AS scatter, 1 - 200 / daily AS cloud,
           -5.67e-8 * pow(280, 4) * (1 - 9.35e-6 * 280 * 280) + 60 * (1 - 200 / daily) AS longwave FROM ra"""


@query("m8_m9_m11_radiation", RADIATION_SQL, "daily hourly clear_daily clear_hourly scatter cloud longwave")
def _(t: Tables) -> DataFrame:
    rows = t.stations.withColumn("doy", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(365).cast("long"), F.lit(30).cast("long")))).withColumn("h", F.explode(F.array(F.lit(7), F.lit(12), F.lit(17))))
    lat, doy = F.radians("lat"), F.col("doy")
    angle = physics.wrapped_angle((F.col("h") - 12) * 3.141592653589793 / 12)
    daily, hourly = physics.extraterrestrial_daily(lat, doy), physics.extraterrestrial_hourly(lat, doy, angle)
    cloud = physics.cloud_fraction(F.lit(200.0), daily)
    return rows.select("station", "doy", "h", daily.alias("daily"), hourly.alias("hourly"), physics.clear_sky_daily(daily, F.col("elev")).alias("clear_daily"), physics.clear_sky_hourly(hourly, F.lit(0.5), F.lit(900.0)).alias("clear_hourly"), physics.transmission_scattering(F.lit(900.0), F.lit(0.5)).alias("scatter"), cloud.alias("cloud"), physics.longwave_isothermal(F.lit(280.0), cloud).alias("longwave"))


HAVERSINE_SQL = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
TO_ZERO_SQL = HAVERSINE_SQL.replace("{b}lat", "(-30)").replace("{b}lon", "(-70)").replace("{a}", "")


@query("m12_haversine", f"SELECT station, {TO_ZERO_SQL} AS metres, ((degrees(atan2(sin(radians(-70 - lon)) * cos(radians(-30)), cos(radians(lat)) * sin(radians(-30)) - sin(radians(lat)) * cos(radians(-30)) * cos(radians(-70 - lon)))) % 360) + 360) % 360 AS bearing FROM stations", "metres bearing")
def _(t: Tables) -> DataFrame:
    at = (F.col("lon"), F.col("lat"), F.lit(-70.0), F.lit(-30.0))
    return t.stations.select("station", geo.haversine(*at).alias("metres"), geo.bearing(*at).alias("bearing"))


@query("m13_times", "SELECT event_id AS id, epoch(TIMESTAMP '2000-01-01')::BIGINT + round(value * 3600)::BIGINT AS from_hours, epoch(date_trunc('second', ts - INTERVAL 4 HOURS))::BIGINT AS local FROM events")
def _(t: Tables) -> DataFrame:
    shifted = F.col("ts").cast("timestamp") - F.expr("INTERVAL 4 HOURS")
    return t("events").select(F.col("event_id").alias("id"), times.from_base(F.col("value"), "hours", "2000-01-01").cast("long").alias("from_hours"), F.floor(F.unix_micros(shifted) / 1000000).alias("local"))


@query("m14_run_blocks", """
    runs AS (SELECT start, count(DISTINCT step) AS length FROM fcst GROUP BY start),
    marked AS (SELECT *, sum(CASE WHEN length <> before THEN 1 ELSE 0 END) OVER (ORDER BY start) AS block FROM (SELECT *, lag(length) OVER (ORDER BY start) AS before FROM runs))
    SELECT block::BIGINT AS block, min(length)::BIGINT AS length, min(start) AS first, max(start) AS last, count(*)::BIGINT AS runs FROM marked GROUP BY block""")
def _(t: Tables) -> DataFrame:
    named = t.fcst.select(F.date_format(F.timestamp_seconds("start"), "'run_'yyyyMMddHH").alias("dir"), "step")
    runs = named.groupBy(times.run_start(F.col("dir")).cast("long").alias("start")).agg(F.countDistinct("step").alias("length"))
    return compare.length_blocks(runs, "start", "length")


@query("m15_attribute_changes", """
    long AS (SELECT event_id AS start, 'k' AS key, (props->>'k')::VARCHAR AS after FROM events)
    SELECT start, key, before, after FROM (SELECT *, lag(after) OVER (PARTITION BY key ORDER BY start) AS before FROM long) WHERE before IS NOT NULL AND before <> after""")
def _(t: Tables) -> DataFrame:
    runs = t("events").select(F.col("event_id").alias("start"), F.from_json("props", "map<string,string>").alias("a"))
    return compare.attribute_changes(runs, "start", "a")


@query("m17_level_arrays", "SELECT station, round(v * 2, 6) AS v FROM obs WHERE v > 50", "v")
def _(t: Tables) -> DataFrame:
    packed = t.obs.groupBy("station").agg(F.collect_list("v").alias("levels"))
    doubled = packed.withColumn("levels", F.transform(F.filter("levels", lambda x: x > 50), lambda x: x * 2))
    return doubled.select("station", F.explode("levels").alias("v"))


@query("a7_season_class", "SELECT o_orderkey AS k, floor((month(o_orderdate) % 12) / 3)::INT AS class, epoch((CASE WHEN month(o_orderdate) % 12 < 3 THEN make_date(year(o_orderdate)::BIGINT - CASE WHEN month(o_orderdate) < 3 THEN 1 ELSE 0 END, 12, 1) ELSE make_date(year(o_orderdate)::BIGINT, (month(o_orderdate) // 3 * 3)::BIGINT, 1) END)::TIMESTAMP)::BIGINT AS season, CASE WHEN (month(o_orderdate) - 4 + 12) % 12 < 6 THEN year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END END::INT AS water_year FROM orders")
def _(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t("orders").select(F.col("o_orderkey").alias("k"), times.season_class(day).alias("class"), (F.unix_date(times.season_start(day)).cast("long") * 86400).alias("season"), times.water_year(day, 4, 6).alias("water_year"))


@query("p12_without_gaps", "x AS (SELECT station, h, v > 60 AS gap, row_number() OVER (PARTITION BY station ORDER BY h) AS n FROM hourly WHERE field = 'view'), r AS (SELECT station, n - row_number() OVER (PARTITION BY station ORDER BY h) AS run FROM x WHERE gap), bad AS (SELECT DISTINCT station FROM (SELECT station, run FROM r GROUP BY ALL HAVING count(*) >= 6)) SELECT station, h FROM hourly WHERE field = 'view' AND station NOT IN (SELECT station FROM bad)")
def _(t: Tables) -> DataFrame:
    rows = t.seen.withColumn("v", F.when(F.col("v") <= 60, F.col("v")))
    return select.without_gaps(rows, ["station"], "h", "v", 6).select("station", "h")
