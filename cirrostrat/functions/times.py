"""Time columns: seconds of any time type, rounding, seasons, water years, run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp column, or of a column that holds them already."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("long")


def floor_to(ts: str | Column, width: int) -> Column:
    s = seconds(ts)
    return s - F.pmod(s, F.lit(width))


def nearest_hour(ts: str | Column) -> Column:
    """The nearest hour; half past goes up."""
    return floor_to(seconds(ts) + 1800, 3600)


def season_start(date: Column) -> Column:
    """The first day of the three-month season, seasons beginning in March."""
    return F.add_months(F.date_trunc("quarter", F.add_months(date, 1)).cast("date"), -1)


def season_class(date: Column) -> Column:
    """0 for December to February, 1 for March to May, and so on."""
    return F.floor(F.month(date) % 12 / 3).cast("int")


def water_year(date: Column, start: int, months: int) -> Column:
    """The year in which a group of `months` months from `start` on begins; null for other months."""
    m = F.month(date)
    return F.when((m - start + 12) % 12 < months, F.year(date) - (m < start).cast("int"))


def from_base(value: Column, unit: str, base: str) -> Column:
    """A time from a number of days, hours, minutes or seconds since `base`."""
    per = {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}[unit]
    return F.timestamp_seconds(F.to_timestamp(F.lit(base)).cast("long") + F.round(value * per).cast("long"))


def run_start(directory: Column) -> Column:
    """The start of a run from the last ten letters of its directory, yyyyMMddHH; null if they are no time."""
    return F.try_to_timestamp(F.right(directory, F.lit(10)), F.lit("yyyyMMddHH"))
