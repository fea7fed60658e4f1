"""Daily validation of forecasts: interpolate, bin, align, errors, store, report. Which fields are compared, and how, is a table of settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrostrat.operators.aggregate import error_statistics
from cirrostrat.operators.binning import weighted_bins
from cirrostrat.operators.grid import interpolated
from cirrostrat.operators.join import align, errors

#: Variable: the observed field, whether the model accumulates it, and a transform of the observation to the model's unit.
VARIABLES: dict[str, tuple[str, bool, Callable[[Column], Column]]] = {
    "t2": ("view", False, lambda v: v + 273.15),
    "rain": ("error", True, lambda v: v),
}


def binned(readings: DataFrame, field: str, length: Column) -> DataFrame:
    """Hourly observations (station, h, obs) of a field from readings (station, field, t, v)."""
    rows = readings.filter(F.col("field") == field)
    return weighted_bins(rows, ["station"], "t", length, ave="v", low="v", high="v").select("station", F.col("bin").alias("h"), F.col("ave").alias("obs"))


def variable_errors(forecasts: DataFrame, readings: DataFrame, variable: str, length: Column, settings: dict | None = None) -> DataFrame:
    """Errors (station, start, step, valid, variable, error) of one variable, by its settings."""
    field, accumulated, transform = (settings or VARIABLES)[variable]
    seen = binned(readings, field, length).withColumn("obs", transform(F.col("obs")))
    out = errors(align(forecasts, seen, valid="valid", ts="h"), "v", "obs", accumulated=accumulated)
    return out.select("station", "start", "step", "valid", F.lit(variable).alias("variable"), "error")


def validate(grid: DataFrame, stations: DataFrame, readings: DataFrame, variable: str, length: Column, how: str = "bilinear") -> DataFrame:
    """From gridded forecasts (start, step, valid, i, j, lon, lat, v) and raw readings to errors."""
    forecasts = interpolated(grid, stations, ["start", "step", "valid"], how)
    return variable_errors(forecasts, readings, variable, length)


def report(found: DataFrame) -> DataFrame:
    """Statistics by variable, station and lead day."""
    return error_statistics(found.withColumn("lead", F.floor(F.col("step") / 24).cast("int")), ["variable", "station", "lead"])
