"""Choosing rows and columns of long station tables, and turning them wide and long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.functions.times import seconds


def cross_section(df: DataFrame, **levels: object) -> DataFrame:
    """Rows in which each named column has the given value (or one of a list)."""
    for name, value in levels.items():
        df = df.filter(F.col(name).isin(value) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return df


def extract(df: DataFrame, value: str, without_elev: float | None = None, to_kelvin: bool = False) -> DataFrame:
    """station, sensor, ts, value of one aggregate, without the sensors at one height."""
    if without_elev is not None:
        df = df.filter(~F.col("elev").eqNullSafe(F.lit(without_elev)))
    return df.withColumn(value, F.col(value) + 273.15) if to_kelvin else df


def station_labels(df: DataFrame, station: str = "station", sensor: str = "sensor") -> DataFrame:
    """Add `label`: the station, or for all rows the sensor when any station has more than one."""
    several = df.groupBy(station).agg(F.countDistinct(sensor).alias("n")).agg((F.max("n") > 1).alias("several"))
    return df.join(F.broadcast(several), how="cross").withColumn("label", F.when(F.col("several"), F.col(sensor).cast("string")).otherwise(F.col(station).cast("string"))).drop("several")


def nearest_height(sensors: DataFrame, keys: list[str], height: float = 2.0, elev: str = "elev", sensor: str = "sensor") -> DataFrame:
    """Per key, the sensor nearest to a height; the smaller code on a tie."""
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col(elev) - height).asc_nulls_last(), sensor)
    return sensors.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def preferred(df: DataFrame, keys: list[str], column: str, order: list, tie: str) -> DataFrame:
    """Per key, the row whose `column` comes first in a list of preferences; others are no choice."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    w = Window.partitionBy(*keys).orderBy("_p", tie)
    return df.withColumn("_p", rank).filter("_p > 0").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_p", "_r")


def with_values(df: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """Rows of the keys that have at least `least` non-null values."""
    enough = df.groupBy(*keys).agg(F.count(value).alias("_n")).filter(F.col("_n") >= least).select(*keys)
    return df.join(enough, keys, "left_semi")


def well_covered(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Rows of the keys whose values are present in more than a share of the longest key's rows."""
    n = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.count("*").alias("_all"))
    longest = n.agg(F.max("_all").alias("_most"))
    keep = n.join(F.broadcast(longest), how="cross").filter(F.col("_n") > share * F.col("_most")).select(*keys)
    return df.join(keep, keys, "left_semi")


def valid_months(df: DataFrame, key: str, ts: str, value: str, months: int = 12) -> DataFrame:
    """Rows of the keys with at least `months` distinct months that hold a value."""
    month = F.date_trunc("month", F.timestamp_seconds(seconds(ts)))
    keep = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.countDistinct(month).alias("_n")).filter(F.col("_n") >= months).select(key)
    return df.join(keep, key, "left_semi")


def select_runs(runs: DataFrame, done: DataFrame | None = None, pattern: str | None = None, first: object = None, last: object = None, hour: int | None = None, skip: list | None = None) -> DataFrame:
    """Runs (start, dir) of a start hour and period, whose directory matches, that are neither skipped nor done."""
    if pattern:
        runs = runs.filter(F.col("dir").rlike(pattern))
    if first is not None:
        runs = runs.filter(F.col("start") >= F.lit(first))
    if last is not None:
        runs = runs.filter(F.col("start") <= F.lit(last))
    if hour is not None:
        runs = runs.filter(F.hour(F.timestamp_seconds(seconds("start"))) == hour)
    if skip:
        runs = runs.filter(~F.col("dir").isin(skip))
    return runs.join(done.select("start").distinct(), "start", "left_anti") if done is not None else runs


def lead_day(df: DataFrame, day: int, start: str = "start", valid: str = "valid") -> DataFrame:
    return df.filter(F.floor((seconds(valid) - seconds(start)) / 86400) == day)


def lead_steps(df: DataFrame, day: int, step: str = "step") -> DataFrame:
    return df.filter((F.col(step) >= 24 * day) & (F.col(step) < 24 * (day + 1)))


def precise_switches(df: DataFrame, first: str, switch: str, days: int = 5) -> DataFrame:
    """Sensors whose switch comes within some days of their first reading."""
    return df.filter(seconds(switch) - seconds(first) < days * 86400)


def land_only(df: DataFrame, mask: DataFrame, cell: list[str], land: str = "land") -> DataFrame:
    return df.join(mask.filter(F.col(land) == 1).select(*cell), cell, "left_semi")


def never_valid(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Cells that are null at all times."""
    return df.groupBy(*cell).agg(F.count(value).alias("_n")).filter("_n = 0").drop("_n")


def wide(df: DataFrame, keys: list[str], column: str, values: list, agg: Column) -> DataFrame:
    """One column for each of an explicit list of values, so that no pass is spent on finding them."""
    return df.groupBy(*keys).pivot(column, values).agg(agg)


def long(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Columns stacked to rows; missing cells are dropped."""
    return df.unpivot(keys, columns, name, value).filter(F.col(value).isNotNull())


def local_cycle(df: DataFrame, step: str, start_hour: int) -> DataFrame:
    """Hour of the day for hours since a start hour."""
    return df.withColumn("hour", F.pmod(F.col(step) + start_hour, F.lit(24)))


def one_match(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column contains a pattern, case aside. Where several names match, those that equal it count; several of these, or none, leave no row."""
    hits = df.filter(F.col(column).rlike(f"(?i){pattern}"))
    exact = F.lower(F.col(column)) == pattern.lower()
    names = hits.agg(F.countDistinct(column).alias("_names"), F.countDistinct(F.when(exact, F.col(column))).alias("_exact"))
    chosen = hits.join(F.broadcast(names), how="cross").filter((F.col("_names") == 1) | (exact & (F.col("_exact") == 1)))
    return chosen.drop("_names", "_exact")


def without(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(excluded, keys, "left_anti")


def blanked(df: DataFrame, periods: DataFrame, sensor: str, ts: str, value: str) -> DataFrame:
    """`value` null inside the periods (sensor, from_s, to_s) of each sensor. Periods of a sensor are disjoint."""
    spans = periods.select(F.col(sensor).alias("_sensor"), "from_s", "to_s")
    hit = (F.col(sensor) == F.col("_sensor")) & seconds(ts).between(F.col("from_s"), F.col("to_s"))
    return df.join(spans, hit, "left").withColumn(value, F.when(F.col("_sensor").isNull(), F.col(value))).drop("_sensor", "from_s", "to_s")


def without_gaps(df: DataFrame, keys: list[str], ts: str, value: str, n: int) -> DataFrame:
    """Rows of the keys that have no run of `n` or more nulls in a row."""
    from cirrostrat.operators.windows import islands

    gaps = islands(df, keys, ts, F.col(value).isNull()).filter(F.col("length") >= n).select(*keys).distinct()
    return df.join(gaps, keys, "left_anti")
