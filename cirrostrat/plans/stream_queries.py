"""Queries over incremental and streaming jobs. Streams read the events table's files, and their sinks are files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.operators import windows
from cirrostrat.plans.registry import Tables, query
from cirrostrat.runtime import fresh_path
from cirrostrat.streaming import incremental


def readings(t: Tables) -> DataFrame:
    """The events as a stream of readings."""
    schema = t("events").schema
    raw = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parque[t]")  # a glob may be a file or a folder
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return raw.select((F.col("user_id") % 10).alias("station"), F.col("event_type").alias("field"), F.col("user_id").alias("sensor"), F.col("event_id").alias("id"), ts.alias("ts"), F.col("value").alias("v"))


def drained(t: Tables, stream: DataFrame) -> DataFrame:
    """Run a stream to the end of its input, into files, and read them."""
    path, checkpoint = fresh_path(t.spark, "sink"), fresh_path(t.spark, "progress")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


@query("i1_fresh_readings", "m AS (SELECT sensor, max(t) AS m FROM obs WHERE t < 1705276800 AND sensor % 5 > 0 GROUP BY sensor) SELECT o.id FROM obs o LEFT JOIN m USING (sensor) WHERE m IS NULL OR t > m - 86400")
def _(t: Tables) -> DataFrame:
    stored = t.obs.filter("t < 1705276800 AND sensor % 5 > 0")
    return incremental.fresh_readings(t.obs, stored, ["sensor"], "t").select("id")


@query("i1_unseen", "SELECT id FROM obs")
def _(t: Tables) -> DataFrame:
    both = readings(t).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    return drained(t, incremental.unseen(both, ["id"])).select("id")


@query("i2_corrections", "SELECT id, CASE WHEN id % 3 = 0 THEN v + 1 ELSE v END AS v FROM obs", "v")
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "corrected")
    rows = t.obs.select("id", F.expr("t DIV 604800").alias("week"), "v")
    incremental.upsert(t.spark, rows, path, ["id"], "week")
    incremental.upsert(t.spark, rows.filter("id % 3 = 0").withColumn("v", F.col("v") + 1), path, ["id"], "week")
    return t.spark.read.parquet(path).select("id", "v")


@query("i2_streamed_corrections", "SELECT id, v FROM obs", "v")
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "upserted")
    stream = readings(t).select("id", F.expr("unix_seconds(ts) DIV 604800").alias("week"), "v")
    incremental.corrections(stream, path, ["id"], "week", fresh_path(t.spark, "progress")).awaitTermination()
    return t.spark.read.parquet(path).select("id", "v")


LAST = "(SELECT max(t) FROM obs)"


@query("i3_running_bins", f"p AS (SELECT field, (t - 600) - (t - 600) % 3600 AS b, t, v FROM obs), q AS (SELECT field, b, v, 600 - greatest(0, t - b - 3600) AS w FROM p UNION ALL SELECT field, b + 3600, v, t - b - 3600 FROM p WHERE t > b + 3600) SELECT field, b + 3600 AS bin, sum(w * v) / sum(w) AS ave FROM q GROUP BY field, b HAVING b + 3600 <= (SELECT max(b) FROM q) - 7200", "ave")
def _(t: Tables) -> DataFrame:
    stream = readings(t).withColumn("len", F.lit(600).cast("long"))
    out = drained(t, incremental.running_bins(stream, ["field"], "ts", "len", "v"))
    return out.select("field", F.col("bin").cast("long").alias("bin"), "ave")


@query("i4_sliding_means", f"w AS (SELECT field, unnest(range(t - t % 86400 + 86400, t - t % 86400 + 604800 + 1, 86400)) AS u, v FROM obs) SELECT field, u AS until, avg(v) AS mean, count(v) AS n FROM w GROUP BY field, u HAVING u <= {LAST} - 86400", "mean")
def _(t: Tables) -> DataFrame:
    out = drained(t, incremental.sliding_means(readings(t), ["field"], "ts", "v"))
    return out.select("field", F.col("until").cast("long").alias("until"), "mean", "n")


@query("i5_sessions", f"g AS (SELECT sensor, t, CASE WHEN t - lag(t) OVER (PARTITION BY sensor ORDER BY t) >= 21600 THEN 1 ELSE 0 END AS b FROM obs), s AS (SELECT sensor, t, sum(b) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT sensor, min(t) AS start, max(t) + 21600 AS \"end\", count(*) AS n FROM s GROUP BY sensor, k HAVING max(t) + 21600 <= {LAST} - 86400")
def _(t: Tables) -> DataFrame:
    out = drained(t, incremental.sessions(readings(t), ["sensor"], "ts", "6 hours"))
    return out.select("sensor", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n")


@query("i6_stateful_steps", "SELECT sensor, t, CASE WHEN t - lag(t) OVER w <= 21600 THEN abs(v - lag(v) OVER w) END AS change FROM obs WINDOW w AS (PARTITION BY sensor ORDER BY t, v)", "change")
def _(t: Tables) -> DataFrame:
    out = drained(t, incremental.stateful_steps(readings(t).select("sensor", "ts", "v"), "sensor", "ts", "v", 360))
    return out.select("sensor", F.col("ts").cast("long").alias("t"), "change")


@query("i6_silent_sensors", f"SELECT sensor, t, 'reading' AS event FROM obs UNION ALL SELECT sensor, max(t), 'silent' FROM obs GROUP BY sensor HAVING max(t) + 43200 <= {LAST} - 86400")
def _(t: Tables) -> DataFrame:
    """All readings with their steps, and the sensors that were silent for half a day when the stream ended."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(store, None)
    t.spark.conf.set(store, incremental.ROCKS)
    try:
        out = drained(t, incremental.watched_steps(readings(t), "sensor", "ts", "v", 360, 43200))
    finally:
        t.spark.conf.set(store, before) if before else t.spark.conf.unset(store)
    return out.select("sensor", F.col("ts").cast("long").alias("t"), "event")


@query("i7_streamed_validation", "x AS (SELECT station, field, (t + 1800) - (t + 1800) % 3600 AS h FROM obs), f AS (SELECT DISTINCT station, h FROM x WHERE field = 'click') SELECT station, h, EXISTS (SELECT 1 FROM x WHERE x.station = f.station AND x.h = f.h AND x.field = 'view') AS validated FROM f WHERE validated")
def _(t: Tables) -> DataFrame:
    """Hours of one field's readings that the other's validate, from two streams; the others come out once the watermark has passed them."""
    both = readings(t)
    forecasts = both.filter("field = 'click'").select("station", F.col("ts").alias("valid"), F.col("v").alias("forecast"))
    observed = both.filter("field = 'view'").select("station", "ts", F.col("v").alias("obs"))
    out = drained(t, incremental.validated(forecasts, observed, ["station"], "valid", "ts", "obs"))
    hour = F.expr("unix_seconds(valid) + 1800 - (unix_seconds(valid) + 1800) % 3600").alias("h")
    return out.filter("validated").select("station", hour, "validated").distinct()


@query("i7_not_validated", "e AS (SELECT DISTINCT f.start FROM fcst f JOIN seen s ON s.station = f.station AND s.h = f.valid) SELECT DISTINCT start, min(start) OVER () AS earliest FROM (SELECT DISTINCT start FROM fcst WHERE start NOT IN (SELECT start FROM e WHERE start % 172800 = 0))")
def _(t: Tables) -> DataFrame:
    done = t.fcst.filter("start % 172800 = 0").join(t.seen.select("station", F.col("h").alias("valid")), ["station", "valid"])
    return incremental.not_validated(t.fcst, done)


@query("i8_restarted", "SELECT start, count(*) AS n FROM fcst GROUP BY start")
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "parts")
    count = lambda runs: runs.groupBy("start").agg(F.count("*").alias("n"))
    incremental.restarted(t.spark, t.fcst.filter("start % 172800 = 0"), path, count)
    incremental.restarted(t.spark, t.fcst, path, count)
    return t.spark.read.parquet(path)


@query("qc_flags", """
    r AS (SELECT 'range' AS "check", station, t, v < 0.5 OR v > 120 AS flag FROM obs), s AS (SELECT 'step' AS "check", station, t, CASE WHEN t - lag(t) OVER w <= 1800 THEN abs(v - lag(v) OVER w) END > 80 AS flag FROM obs WINDOW w AS (PARTITION BY station ORDER BY t, id)),
    d AS (SELECT 'persistence' AS "check", station, t - t % 86400 AS t, coalesce((stddev_samp(v) < 30 AND count(v) > 24) OR stddev_samp(v) = 0, FALSE) AS flag FROM obs GROUP BY station, t - t % 86400)
    SELECT "check", station, count(flag) AS n, sum(flag::INT)::BIGINT AS flagged, avg(flag::INT) AS share FROM (SELECT * FROM r UNION ALL SELECT * FROM s UNION ALL SELECT * FROM d) GROUP BY ALL""", "share")
def quality_control(t: Tables) -> DataFrame:
    """Range, step and persistence checks of all readings, as one long table of flags, and their shares by station."""
    from cirrostrat.operators.regress import flag_statistics

    limits = t.obs.select("station").distinct().select("station", F.lit(0.5).alias("range_min"), F.lit(120.0).alias("range_max"))
    span = windows.out_of_range(t.obs, limits, ["station"], "v").select(F.lit("range").alias("check"), "station", "flag")
    step = windows.step_changes(t.obs.select("station", "t", "id", "v"), ["station"], "t", "v", "v", 30, ["id"])
    step = step.select(F.lit("step").alias("check"), "station", (F.col("change") > 80).alias("flag"))
    flat = windows.persistence(t.obs, ["station"], "t", "v", 30.0).select(F.lit("persistence").alias("check"), "station", F.col("flat").alias("flag"))
    return flag_statistics(span.unionByName(step).unionByName(flat), "station")
