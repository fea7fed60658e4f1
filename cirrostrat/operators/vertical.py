"""Vertical profiles: integrals, layers, lapse rates, interpolation to levels, inversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.operators.grid import bracketed


def vertical_integral(levels: DataFrame, keys: Sequence[str], p: str, w: str, layers: int = 5, widest: float = 20000.0) -> DataFrame:
    """Trapezoid integral over pressure between consecutive valid levels; only of profiles with more than `layers` layers whose mean and
    (population) deviation of thickness are under `widest`."""
    order = Window.partitionBy(*keys).orderBy(p)
    valid = levels.filter(F.col(p).isNotNull() & F.col(w).isNotNull())
    dp = valid.withColumn("_dp", F.col(p) - F.lag(p).over(order)).withColumn("_m", (F.col(w) + F.lag(w).over(order)) / 2).filter("_dp IS NOT NULL")
    out = dp.groupBy(*keys).agg(F.sum(F.expr("_dp * _m")).alias("total"), F.count("*").alias("layers"), F.avg("_dp").alias("_a"), F.stddev_pop("_dp").alias("_s"))
    return out.filter((F.col("layers") > layers) & (F.col("_a") < widest) & (F.col("_s") < widest)).select(*keys, "total", "layers")


def layer_means(levels: DataFrame, keys: Sequence[str], k: str, columns: Sequence[str], first: int | None = None) -> DataFrame:
    """Means of adjacent levels (k and k + 1) as the values of layer k; the lowest `first` layers if asked for."""
    w = Window.partitionBy(*keys).orderBy(k)
    out = levels.select(*keys, k, *((F.col(c) + F.lead(c).over(w)).alias(f"_{c}") for c in columns), F.lead(k).over(w).alias("_k"))
    out = out.filter(F.col("_k") == F.col(k) + 1)
    if first is not None:
        out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first)
    return out.select(*keys, k, *((F.col(f"_{c}") / 2).alias(c) for c in columns))


def lapse_rates(levels: DataFrame, keys: Sequence[str], k: str, t: str, z: str) -> DataFrame:
    """Kelvin per kilometre between each level and the one below."""
    w = Window.partitionBy(*keys).orderBy(k)
    rate = F.try_divide(F.col(t) - F.lag(t).over(w), F.col(z) - F.lag(z).over(w)) * 1000
    return levels.withColumn("rate", rate).filter("rate IS NOT NULL")


def rate_variability(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rates.groupBy(*keys).agg(F.stddev_pop("rate").alias("std"), F.count("rate").alias("n"))


def at_pressures(levels: DataFrame, keys: Sequence[str], p: str, value: str, targets: Sequence[float]) -> DataFrame:
    """Values at pressure levels, straight in the logarithm of pressure; nothing outside the profile."""
    import math

    logged = levels.filter(F.col(p) > 0).withColumn("_lp", F.log(F.col(p).cast("double")))
    out = bracketed(logged, keys, "_lp", value, [math.log(t) for t in targets])
    return out.withColumn("level", F.round(F.exp("target")).cast("int")).select(*keys, "level", value)


def at_heights(levels: DataFrame, keys: Sequence[str], z: str, value: str, targets: Sequence[float]) -> DataFrame:
    """Values at heights above ground, straight in height."""
    return bracketed(levels, keys, z, value, targets).withColumnRenamed("target", "height")


def first_warming(levels: DataFrame, keys: Sequence[str], k: str, t: str) -> DataFrame:
    """The first level from below at which temperature rises with height."""
    w = Window.partitionBy(*keys).orderBy(k)
    rise = F.col(t) - F.lag(t).over(w)
    return levels.withColumn("_d", rise).groupBy(*keys).agg(F.min(F.when(F.col("_d") > 0, F.col(k))).alias("top"))


def inversions(levels: DataFrame, keys: Sequence[str], k: str, t: str, z: str, below: float = 3000.0, least: float = 0.5) -> DataFrame:
    """Level and height of the lowest temperature below a height, and the warming above it; only where that reaches `least` kelvin."""
    cold = levels.filter(F.col(z) < below).groupBy(*keys).agg(F.min_by(F.struct(F.col(k).alias("k"), F.col(z).alias("z"), F.col(t).alias("t")), F.struct(t, k)).alias("c"))
    above = levels.filter(F.col(z) < below).join(cold, list(keys)).filter(F.col(k) > F.col("c.k")).groupBy(*keys).agg(F.max(t).alias("_w"))
    return cold.join(above, list(keys)).withColumn("strength", F.col("_w") - F.col("c.t")).filter(F.col("strength") >= least).select(*keys, F.col("c.k").alias("base"), F.col("c.z").alias("height"), "strength")
