"""Grid rows: geolocation of cells, times in file names, satellite granules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def located(cells: DataFrame, transform: Sequence[float], i: str = "i", j: str = "j") -> DataFrame:
    """lon and lat of cell centres from the six numbers of an affine geotransform: origin, step and shear of x, then of y."""
    x0, dx, rx, y0, ry, dy = transform
    col, row = F.col(j) + 0.5, F.col(i) + 0.5
    return cells.withColumn("lon", x0 + dx * col + rx * row).withColumn("lat", y0 + ry * col + dy * row)


def day_in_name(name: Column) -> Column:
    """The date of a name that holds AYYYYDDD (year and day of year)."""
    digits = lambda k: F.nullif(F.regexp_extract(name, r"A(\d{4})(\d{3})", k), F.lit("")).cast("int")
    return F.make_date(digits(1), F.lit(1), F.lit(1)) + (digits(2) - 1)


def granules(cells: DataFrame, date: str, afternoon: Column, value: str, missing: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Cells in a box (west, south, east, north), at 0 h or 12 h of their date, missing ones null; only times at which some cell has a value."""
    west, south, east, north = box
    at = cells.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north)).withColumn(value, F.nullif(F.col(value), F.lit(missing)))
    at = at.withColumn("s", F.unix_date(date).cast("long") * 86400 + F.when(afternoon, 43200).otherwise(0))
    some = at.groupBy("s").agg(F.count(value).alias("_n")).filter("_n > 0").select("s")
    return at.join(some, "s", "left_semi")
