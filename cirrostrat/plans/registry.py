"""Registered queries and their DuckDB SQL, and the station tables that both derive from the driver's tables.

obs       readings: station, field, sensor, id, ts, t (seconds), v        from events
hourly    hourly means by station and field: h (seconds), v
series    hourly means by field over all stations: h, v
stations  station, name, elev, lon, lat                                  from supplier
fcst      forecasts: station, start, step, valid, v (three runs a valid hour); the observed field is another one
daily     daily mean price by field (order status): d (days), date, v     from orders
grid      cells (i, j) with lon, lat and a value by day                    from part
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.runtime import table

BASE = {
    "obs": "SELECT user_id % 10 AS station, event_type AS field, user_id AS sensor, event_id AS id, epoch(date_trunc('second', ts))::BIGINT AS t, value AS v FROM events",
    "hourly": "SELECT station, field, t - t % 3600 AS h, avg(v) AS v FROM obs GROUP BY ALL",
    "series": "SELECT field, t - t % 3600 AS h, avg(v) AS v FROM obs GROUP BY ALL",
    "stations": "SELECT s_suppkey AS station, s_name AS name, s_acctbal AS elev, (-71 + (s_suppkey * 7 % 100) * 0.02)::DOUBLE AS lon, (-31 + (s_suppkey * 13 % 97) * 0.02)::DOUBLE AS lat FROM supplier",
    "fcst": "SELECT station, h - h % 86400 - k * 86400 AS start, (h % 86400) // 3600 + 24 * k AS step, h AS valid, v + ((h % 86400) // 3600 + 24 * k) * 0.1 AS v FROM hourly, (VALUES (0), (1), (2)) AS leads(k) WHERE field = 'click'",
    "seen": "SELECT station, h, v FROM hourly WHERE field = 'view'",
    "daily": "SELECT o_orderstatus AS field, (epoch(o_orderdate) // 86400)::BIGINT AS d, o_orderdate::DATE AS date, avg(o_totalprice) AS v FROM orders GROUP BY ALL",
    "grid": "SELECT d, p_partkey // 50 AS i, p_partkey % 50 AS j, -72 + (p_partkey % 50) * 0.05::DOUBLE AS lon, -32 + (p_partkey // 50) * 0.05::DOUBLE AS lat, p_retailprice + 10 * sin(d + p_partkey % 7) AS v FROM part, (SELECT unnest(range(8)) AS d)",
}

#: Added before rounding to six places, so that exact halves of the last place go the same way in both engines.
NUDGE = 3.7e-8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def obs(self) -> DataFrame:
        ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
        return self("events").select((F.col("user_id") % 10).alias("station"), F.col("event_type").alias("field"), F.col("user_id").alias("sensor"), F.col("event_id").alias("id"), ts.alias("ts"), ts.cast("long").alias("t"), F.col("value").alias("v"))

    @cached_property
    def hourly(self) -> DataFrame:
        return self.obs.groupBy("station", "field", (F.col("t") - F.col("t") % 3600).alias("h")).agg(F.avg("v").alias("v"))

    @cached_property
    def series(self) -> DataFrame:
        return self.obs.groupBy("field", (F.col("t") - F.col("t") % 3600).alias("h")).agg(F.avg("v").alias("v"))

    @cached_property
    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self("supplier").select(k.alias("station"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("elev"), (-71 + (k * 7 % 100) * 0.02).alias("lon"), (-31 + (k * 13 % 97) * 0.02).alias("lat"))

    @cached_property
    def fcst(self) -> DataFrame:
        runs = self.hourly.filter("field = 'click'").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
        step = F.expr("(h % 86400) DIV 3600 + 24 * k")
        return runs.select("station", F.expr("h - h % 86400 - k * 86400").alias("start"), step.alias("step"), F.col("h").alias("valid"), (F.col("v") + step * 0.1).alias("v"))

    @cached_property
    def seen(self) -> DataFrame:
        return self.hourly.filter("field = 'view'").select("station", "h", "v")

    @cached_property
    def daily(self) -> DataFrame:
        date = F.to_date("o_orderdate")
        return self("orders").groupBy(F.col("o_orderstatus").alias("field"), F.unix_date(date).cast("long").alias("d"), date.alias("date")).agg(F.avg("o_totalprice").alias("v"))

    @cached_property
    def grid(self) -> DataFrame:
        k = F.col("p_partkey")
        cells = self("part").withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
        return cells.select("d", F.expr("p_partkey DIV 50").alias("i"), (k % 50).alias("j"), (-72 + (k % 50) * 0.05).alias("lon"), (-32 + F.expr("p_partkey DIV 50") * 0.05).alias("lat"), (F.col("p_retailprice") + 10 * F.sin(F.col("d") + k % 7)).alias("v"))


def rounded(c: Column) -> Column:
    """A number to six places, as both sides round it."""
    return F.round(c.cast("double") + NUDGE, 6) + F.lit(0.0)


def query(name: str, sql: str | None = None, rounds: str = "", own: bool = False) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query and its SQL. `rounds` names columns that both sides round to six places; with `own` the query has done so itself."""

    def add(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(Tables(spark, sf_dir))
            return df.withColumns({c: rounded(F.col(c)) for c in rounds.split()}) if rounds and not own else df

        QUERIES[name] = run
        if sql:
            body = f"WITH {', '.join(f'{k} AS ({v})' for k, v in BASE.items())}" + (" " if sql.lstrip().upper().startswith("SELECT") else ", ") + sql
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round("{c}"::DOUBLE + {NUDGE}::DOUBLE, 6) + 0::DOUBLE AS "{c}"' for c in rounds.split())}) FROM ({body})" if rounds else body
        return make

    return add
