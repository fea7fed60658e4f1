"""Queries over readers and stores: each derives files in the format from the tables, writes them with Spark and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.operators import scan
from cirrostrat.plans.registry import Tables, query
from cirrostrat.runtime import fresh_path
from cirrostrat.sources import grids, stores, text, web


def written(t: Tables, lines: DataFrame, *, order: list[str] | None = None, by: str | None = None) -> str:
    """The path of text files that hold `line`, a folder for each `by`, in the given order inside."""
    path = fresh_path(t.spark, "text")
    out = lines.repartition(by).sortWithinPartitions(by, *order) if by else lines
    (out.select(by, "line").write.partitionBy(by) if by else out.select("line").write).text(path)
    return path


def stamp(c: str) -> F.Column:
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")


@query("s1_raw_csv", "SELECT sensor::VARCHAR AS sensor, t, v - 1 AS low, v AS ave, v + 1 AS high FROM obs", "low ave high")
def _(t: Tables) -> DataFrame:
    rows = t.obs
    body = rows.select(F.concat_ws(",", "sensor", stamp("t"), (F.col("v") - 1), "v", (F.col("v") + 1), F.lit("")).alias("line"))
    comment = rows.limit(1).select(F.lit("# s_cod,datetime,min,ave,max,").alias("line"))
    got = text.without_empty_columns(text.raw_csv(t.spark, written(t, comment.unionByName(body))))
    return got.select(F.col("s_cod").alias("sensor"), F.col("datetime").cast("long").alias("t"), F.col("min").alias("low"), "ave", F.col("max").alias("high"))


@query("s2_logger_file", "SELECT station::VARCHAR AS station, t, 'value' AS name, v AS value FROM obs UNION ALL SELECT station::VARCHAR, t, 'twice', v * 2 FROM obs", "value")
def _(t: Tables) -> DataFrame:
    rows = t.obs
    body = rows.select("station", F.lit(9).alias("n"), "id", F.concat_ws(",", F.concat(F.lit('"'), stamp("t"), F.lit('"')), "v", F.col("v") * 2).alias("line"))
    heads = ['"TOA5","x"', '"TIMESTAMP","value","twice"', '"TS","C","C"', '"","Avg","Avg"']
    top = rows.select("station").distinct().select("station", F.posexplode(F.array(*map(F.lit, heads))).alias("n", "line")).withColumn("id", F.lit(0).cast("long"))
    got = text.logger_file(t.spark, written(t, body.unionByName(top.select(*body.columns)), order=["n", "id"], by="station"))
    return got.select(F.regexp_extract("file", r"station=(\d+)", 1).alias("station"), F.col("ts").cast("long").alias("t"), "name", "value")


MONTHS = "SELECT o_custkey % 50 AS k, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, max(floor(o_totalprice / 100))::BIGINT AS v FROM orders GROUP BY ALL"


@query("s3_daily_file", f"x AS ({MONTHS}) SELECT 'ST' || lpad(k::VARCHAR, 9, '0') AS station, epoch(make_date(y::BIGINT, m::BIGINT, d::BIGINT)::TIMESTAMP)::BIGINT // 86400 AS day, v AS value, CASE WHEN d % 2 = 0 THEN 'Q' END AS qflag FROM x", "value")
def _(t: Tables) -> DataFrame:
    when = F.to_date("o_orderdate")
    days = t("orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.year(when).alias("y"), F.month(when).alias("m"), F.dayofmonth(when).alias("d")).agg(F.max(F.floor(F.col("o_totalprice") / 100)).alias("v"))
    months = days.groupBy("k", "y", "m").agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("x"))
    cell = lambda d: F.concat(F.lpad(F.coalesce(F.try_element_at("x", d), F.lit(-9999)).cast("string"), 5, " "), F.lit(" "), F.when(d % 2 == 0, "Q").otherwise(" "), F.lit("S"))
    line = F.concat(F.format_string("ST%09d%04d%02dPRCP", "k", "y", "m"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(31)), cell), ""))
    got = text.daily_file(t.spark, written(t, months.select(line.alias("line"))))
    return got.select("station", F.unix_date("date").cast("long").alias("day"), "value", "qflag")


@query("s4_station_list", "SELECT 'SU' || lpad(s_suppkey::VARCHAR, 9, '0') AS id, round(s_acctbal / 1000, 1) AS elev, s_suppkey AS number, s_name AS name FROM supplier", "elev")
def _(t: Tables) -> DataFrame:
    line = F.format_string("SU%09d %8.4f %9.4f %6.1f %2s %-30s", "s_suppkey", F.lit(-30.5), F.lit(-70.25), F.round(F.col("s_acctbal") / 1000, 1), F.lit("  "), "s_name")
    got = text.station_list(t.spark, written(t, t("supplier").select(line.alias("line"))))
    return got.select("id", "elev", "number", "name")


#: Levels of one sounding: pressures go down from 90,000 in steps of 100 and have six columns, numbers of levels have four.
LONGEST = 900


@query("s5_soundings", "x AS (SELECT station, t // 86400 AS d, (row_number() OVER (PARTITION BY station, t // 86400 ORDER BY id))::INT - 1 AS k, floor(v)::BIGINT AS v, id FROM obs) SELECT 'SND' || lpad(station::VARCHAR, 8, '0') AS station, d * 86400 AS t, k, (90000 - k * 100)::DOUBLE AS p, CASE WHEN id % 5 > 0 THEN v::DOUBLE END AS temp FROM x", "p temp")
def _(t: Tables) -> DataFrame:
    """A day's readings of a station as soundings of up to LONGEST levels, as many as the columns of the format hold. The height field tells how many soundings
    of the day come before."""
    rows = scan.running(scan.spans(t.obs.withColumn("d", F.expr("t DIV 86400")), "id", 100_000), ["station", "d"], ["id"], "k", F.lit(1), before=True)
    k = F.coalesce("k", F.lit(0)).cast("long")
    rows = rows.select("station", "d", F.floor(k / LONGEST).alias("part"), (k % LONGEST).cast("int").alias("i"), "id", "v")
    day = rows.groupBy("station", "d", "part").agg(F.sort_array(F.collect_list(F.struct("i", "id", "v"))).alias("x"))
    when = F.date_from_unix_date(F.col("d").cast("int"))
    head = F.concat(F.lit("#"), F.format_string("SND%08d", "station"), F.date_format(when, " yyyy MM dd"), F.lit(" 00 2300 "), F.lpad(F.size("x").cast("string"), 4, " "))
    temp = lambda x: F.coalesce(F.when(x["id"] % 5 > 0, F.floor(x["v"])).otherwise(F.lit(-8888)), F.lit(-9999))
    level = lambda x: F.concat(F.lit("20"), F.lit(" -9999 "), F.lpad((90000 - x["i"] * 100).cast("string"), 6, " "), F.lit(" "), F.lpad(F.col("part").cast("string"), 5, " "), F.lit(" "), F.lpad(temp(x).cast("string"), 5, " "), F.lit("  -9999   -50   180    20"))
    whole = day.select("station", F.concat_ws("\n", head, F.array_join(F.transform("x", level), "\n")).alias("line"))
    got = text.soundings(t.spark, written(t, whole))
    before = F.col("gph").cast("long") * LONGEST
    return got.select("station", F.col("ts").cast("long").alias("t"), (F.col("at") + before).cast("int").alias("k"), (F.col("p") - before * 100).alias("p"), "temp")


@query("s6_monthly_soundings", "SELECT (l_suppkey % 30)::VARCHAR AS station, year(l_shipdate)::INT * 12 + month(l_shipdate)::INT AS month, avg(l_quantity) AS value, count(*)::INT AS n FROM lineitem GROUP BY ALL", "value")
def _(t: Tables) -> DataFrame:
    x = t("lineitem").groupBy((F.col("l_suppkey") % 30).alias("s"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(F.avg("l_quantity").alias("v"), F.count("*").alias("n"))
    path = written(t, x.select(F.concat_ws("  ", "s", "y", "m", F.lit(9999), "v", "n").alias("line")))
    got = text.monthly_soundings(t.spark, path)
    return got.select("station", (F.year("month") * 12 + F.month("month")).alias("month"), "value", "n")


INDEX = "SELECT o_orderstatus AS field, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, round(avg(o_totalprice) / 1000, 2) AS v FROM orders GROUP BY ALL"


def index_lines(t: Tables, missing: str) -> DataFrame:
    x = t("orders").groupBy(F.col("o_orderstatus").alias("field"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice") / 1000, 2).alias("v"))
    years = x.groupBy("field", "y").agg(F.map_from_entries(F.collect_list(F.struct("m", "v"))).alias("x"))
    cells = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(F.try_element_at("x", m).cast("string"), F.lit(missing))), "  ")
    return years.select("field", "y", F.concat_ws("  ", F.col("y").cast("string"), cells).alias("line"))


@query("s7_s8_index_table", f"x AS ({INDEX}) SELECT field, epoch(make_date(y::BIGINT, m::BIGINT, 1)::TIMESTAMP)::BIGINT // 86400 AS day, 0::BIGINT AS block, v AS value FROM x", "value")
def _(t: Tables) -> DataFrame:
    body = index_lines(t, "-99.99")
    ends = body.select("field").distinct()
    rows = body.unionByName(ends.select("field", F.lit(0).alias("y"), F.lit(" 1995 2001").alias("line"))).unionByName(ends.select("field", F.lit(9999).alias("y"), F.lit("  -99.99\n note").alias("line")))
    got = text.index_table(t.spark, written(t, rows, order=["y"], by="field"))
    return got.select(F.regexp_extract("file", r"field=(\w+)", 1).alias("field"), F.unix_date("month").cast("long").alias("day"), F.col("block").cast("long").alias("block"), "value")


@query("s8_blocks", "SELECT o_orderstatus AS field, (max(year(o_orderdate)) - min(year(o_orderdate)) + 1)::BIGINT AS rows, 1::BIGINT AS block FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    body = index_lines(t, "-99.99")
    rows = body.unionByName(body.select("field").distinct().select("field", F.lit(0).alias("y"), F.lit("YEAR JAN FEB").alias("line")))
    got = text.blocks_by_kind(t.spark, written(t, rows, order=["y"], by="field"), r"^\d{4} ")
    return got.filter("block > 0").groupBy(F.regexp_extract("file", r"field=(\w+)", 1).alias("field"), F.col("block").cast("long").alias("block")).agg(F.count("*").alias("rows"))


@query("s9_flight_lines", "SELECT id, t - t % 60 AS t, CASE WHEN id % 360 > 180 THEN id % 360 - 360 ELSE id % 360 END::DOUBLE AS lon, v FROM obs", "lon v")
def _(t: Tables) -> DataFrame:
    when = F.timestamp_seconds("t")
    line = F.concat_ws(",", F.year(when), F.dayofyear(when), F.expr("t % 86400 - t % 60"), F.col("id") % 360, "v", "id")
    got = text.flight_lines(t.spark, written(t, t.obs.select(line.alias("line"))), "year int, doy int, sod double, lon double, v double, id long")
    return got.select("id", F.col("ts").cast("long").alias("t"), "lon", "v")


@query("s10_year_month_table", f"x AS ({INDEX}) SELECT field, epoch(make_date(y::BIGINT, m::BIGINT, 1)::TIMESTAMP)::BIGINT // 86400 AS day, v AS value, -33.5 AS lat FROM x", "value lat")
def _(t: Tables) -> DataFrame:
    path = written(t, index_lines(t, "-"), order=["y"], by="field")
    got = text.year_month_table(t.spark, path)
    return got.select(F.regexp_extract("file", r"field=(\w+)", 1).alias("field"), F.unix_date("month").cast("long").alias("day"), "value", text.hemisphere_number(F.lit("33.5S")).alias("lat"))


@query("s11_basin_table", "SELECT station::VARCHAR AS station, t, 'flow' AS name, CASE WHEN id % 7 > 0 THEN v END AS value FROM obs UNION ALL SELECT station::VARCHAR, t, 'temp', v / 2 FROM obs", "value")
def _(t: Tables) -> DataFrame:
    rows = t.obs
    body = rows.select("station", F.lit(9).alias("n"), "id", F.concat(F.concat_ws(",", stamp("t"), F.when(F.col("id") % 7 > 0, F.col("v").cast("string")).otherwise("-6999"), (F.col("v") / 2).cast("string")), F.lit("\r")).alias("line"))
    top = rows.select("station").distinct().select("station", F.posexplode(F.array(F.lit("a preamble\r"), F.lit("DateTime,flow,temp\r"))).alias("n", "line")).withColumn("id", F.lit(0).cast("long"))
    got = text.hourly_basin_table(t.spark, written(t, body.unionByName(top.select(*body.columns)), order=["n", "id"], by="station"))
    return got.select(F.regexp_extract("file", r"station=(\d+)", 1).alias("station"), F.col("ts").cast("long").alias("t"), "name", "value")


@query("s12_merged_variants", "SELECT id, v AS temp FROM obs", "temp")
def _(t: Tables) -> DataFrame:
    spelt = t.obs.select("id", F.when(F.col("id") % 2 == 0, F.col("v")).alias("Temp"), F.when(F.col("id") % 2 == 1, F.col("v")).alias("T_air"))
    return text.merged_variants(spelt, "temp", ["Temp", "T_air", "Tair"])


@query("s13_located", "SELECT d, i, j, -72 + (j + 0.5) * 0.05 AS lon, -30 - (i + 0.5) * 0.05 AS lat, epoch(TIMESTAMP '2004-02-29')::BIGINT // 86400 AS day FROM grid", "lon lat")
def _(t: Tables) -> DataFrame:
    at = grids.located(t.grid.drop("lon", "lat"), (-72.0, 0.05, 0.0, -30.0, 0.0, -0.05))
    return at.select("d", "i", "j", "lon", "lat", F.unix_date(grids.day_in_name(F.lit("MOD.A2004060.tif"))).cast("long").alias("day"))


@query("s14_granules", "SELECT i, j, d * 86400 + CASE WHEN (i + j) % 2 = 1 THEN 43200 ELSE 0 END AS s, CASE WHEN d <> 2 AND NOT (d = 3 AND (i + j) % 2 = 1) AND j % 3 > 0 THEN v END AS v FROM grid WHERE lon BETWEEN -71.6 AND -70.6 AND lat BETWEEN -32 AND -30 AND d <> 2 AND NOT (d = 3 AND (i + j) % 2 = 1)", "v")
def _(t: Tables) -> DataFrame:
    pm = (F.col("i") + F.col("j")) % 2 == 1
    gone = (F.col("d") == 2) | ((F.col("d") == 3) & pm) | (F.col("j") % 3 == 0)
    cells = t.grid.withColumn("date", F.date_from_unix_date(F.col("d").cast("int"))).withColumn("v", F.when(gone, F.lit(-9999.0)).otherwise(F.col("v")))
    return grids.granules(cells, "date", pm, "v", -9999.0, (-71.6, -32.0, -70.6, -30.0)).select("i", "j", "s", "v")


@query("s15_links", """x AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)', 1)) AS href FROM pages) SELECT DISTINCT page_id, href, '' AS scheme, href AS path FROM x WHERE regexp_matches(href, '^/[a-z]')""")
def _(t: Tables) -> DataFrame:
    return web.links(t("pages"), "^/[a-z]").select("page_id", "href", "scheme", "path")


@query("s16_accepting", "SELECT page_id, array_to_string(list_filter([CASE WHEN contains(html, '&quot;') THEN 'quoted' END, CASE WHEN contains(url, '.html') THEN 'static' END], lambda x: x IS NOT NULL), ',') AS parsers, NOT (contains(html, '&quot;') OR contains(url, '.html')) AS failed FROM pages")
def _(t: Tables) -> DataFrame:
    kinds = {"static": F.contains("url", F.lit(".html")), "quoted": F.contains("html", F.lit("&quot;"))}
    return web.accepting(t("pages"), kinds).select("page_id", F.array_join("parsers", ",").alias("parsers"), "failed")


@query("s17_s19_store", "SELECT id, field, v FROM obs WHERE field = 'view' AND t BETWEEN 1704800000 AND 1705800000", "v")
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "store")
    stores.store_by_field(t.obs.select("id", "field", "t", "v"), path, ts="t")
    return stores.read_span(t.spark, path, "view", 1704800000, 1705800000).select("id", "field", "v")


@query("s18_versions", "SELECT s_suppkey AS station, s_acctbal + 1 AS elev FROM supplier", "elev")
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "versions")
    rows = t("supplier").select(F.col("s_suppkey").alias("station"), F.col("s_acctbal").alias("elev"))
    stores.store_version(rows, path, "20240101")
    stores.store_version(rows.withColumn("elev", F.col("elev") + 1), path, "20240201")
    return stores.latest_version(t.spark, path)


@query("s20_text_table", "SELECT s_suppkey || '|' || s_name || '|' || s_nationkey AS line FROM supplier")
def _(t: Tables) -> DataFrame:
    return stores.text_table(t("supplier"), ["s_suppkey", "s_name", "s_nationkey"])
