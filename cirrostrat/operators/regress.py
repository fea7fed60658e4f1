"""Spatial regression and quality of station networks."""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrostrat.operators import network
from cirrostrat.operators.aggregate import line_fit
from cirrostrat.runtime import drop_stash, stash

log = logging.getLogger(__name__)


def standardised(df: DataFrame, place: str, value: str) -> DataFrame:
    """`std` and `z` by place. Sums are combined before the shuffle and joined back."""
    sums = df.groupBy(F.col(place).alias("_k")).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("std"))
    met = df.join(sums, F.col(place).eqNullSafe(F.col("_k")))
    return met.withColumn("z", F.try_divide(F.col(value) - F.col("_m"), F.col("std"))).drop("_k", "_m")


def neighbour_average(df: DataFrame, dist: DataFrame, place: str, time: str, value: str) -> DataFrame:
    """(place, time, estimate): neighbours' standardised values weighed by exp(-(d / mean d)^2), in the place's own units of deviation."""
    z = standardised(df, place, value).filter("z IS NOT NULL")
    mean = dist.agg(F.avg("metres").alias("_m"))
    w = dist.filter("a <> b").join(F.broadcast(mean), how="cross").select("a", "b", F.exp(-F.pow(F.col("metres") / F.col("_m"), F.lit(2))).alias("w"))
    met = z.select(F.col(place).alias("b"), time, "z").join(w, "b")
    out = met.groupBy(F.col("a").alias(place), time).agg((F.sum(F.expr("w * z")) / F.sum("w")).alias("_e"))
    scale = z.groupBy(place).agg(F.first("std").alias("std"))
    return out.join(scale, place).select(place, time, (F.col("_e") * F.col("std")).alias("estimate"))


def availability(df: DataFrame, place: str, time: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(time, pattern): the set of places with a value, a bit each; and (place, number), which bit is whose."""
    there = df.filter(F.col(value).isNotNull() & F.col(place).isNotNull())
    numbers = network.numbered_places(there, place)
    return network.present(there, numbers, place, time), numbers


def pattern_blocks(df: DataFrame, place: str, time: str, value: str) -> DataFrame:
    """(pattern, times, first, last): rows by the set of places present. Sets are grouped as bits; their names are written once for each set."""
    patterns, numbers = availability(df, place, time, value)
    blocks = stash(patterns.groupBy("pattern").agg(F.count("*").alias("times"), F.min(time).alias("first"), F.max(time).alias("last")), "blocks")
    names = network.pattern_places(blocks, numbers, place).groupBy("pattern").agg(F.array_join(F.sort_array(F.collect_list(place)), ",").alias("names"))
    return blocks.join(names, "pattern").select(F.col("names").alias("pattern"), "times", "first", "last")


def predicted_from_others(df: DataFrame, target: object, place: str, time: str, value: str, least: int = 10) -> DataFrame:
    """(time, value, predicted, flag) of one place from the others, by one regression for each set of others present. Spark sums the normal
    equations, one small row of sums per pattern and pair of predictors; each pattern is solved in a helper.
    A flag is a residual over twice the deviation of all."""
    others = df.filter((F.col(place) != F.lit(target)) & F.col(value).isNotNull()).select(time, F.col(place).alias("p"), F.col(value).alias("x"))
    y = df.filter((F.col(place) == F.lit(target)) & F.col(value).isNotNull()).select(time, F.col(value).alias("y"))
    one = y.select(time, F.lit(None).cast(dict(df.dtypes)[place]).alias("p"), F.lit(1.0).alias("x"))
    x = others.join(y.select(time), time, "left_semi").unionByName(one)
    x = x.withColumn("p", F.coalesce(F.col("p").cast("string"), F.lit("")))
    pattern = network.present(x, network.numbered_places(x, "p"), "p", time)
    rows = stash(x.join(pattern, time), "rows")
    pairs = rows.join(rows.select(time, F.col("p").alias("q"), F.col("x").alias("w")), time).groupBy("pattern", "p", "q").agg(F.sum(F.expr("x * w")).alias("s"), F.count("*").alias("n"))
    right = rows.join(y, time).groupBy("pattern", "p").agg(F.sum(F.expr("x * y")).alias("r"))
    schema = "pattern binary, p string, b double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["p"].unique())
        if pdf["n"].max() < max(least, len(names) + 1):
            return pd.DataFrame({"pattern": [], "p": [], "b": []}).astype({"pattern": object, "p": str, "b": float})
        m = pdf.pivot(index="p", columns="q", values="s").loc[names, names].to_numpy(float)
        b = np.linalg.lstsq(m, pdf.drop_duplicates("p").set_index("p").loc[names, "r"].to_numpy(float), rcond=None)[0]
        return pd.DataFrame({"pattern": [pdf["pattern"].iloc[0]] * len(names), "p": names, "b": b})

    fit = pairs.join(right, ["pattern", "p"]).groupBy("pattern").applyInPandas(solve, schema)
    estimate = rows.join(fit, ["pattern", "p"]).groupBy(time).agg(F.sum(F.expr("x * b")).alias("predicted"))
    out = y.join(estimate, time, "left").withColumn("_d", F.col("y") - F.col("predicted"))
    out = stash(out, "predicted")
    limit = out.agg((2 * F.stddev_samp("_d")).alias("_limit"))  # one row
    return out.join(F.broadcast(limit)).select(time, F.col("y").alias("value"), "predicted", F.coalesce(F.abs("_d") > F.col("_limit"), F.lit(False)).alias("flag"))


def neighbour_differences(df: DataFrame, nearest: DataFrame, place: str, time: str, value: str) -> DataFrame:
    """(place, time, score): summed absolute differences from the neighbours (a, b) over the deviation of these sums."""
    x = df.filter(F.col(value).isNotNull())
    mine = x.select(F.col(place).alias("a"), time, F.col(value).alias("_x"))
    theirs = x.select(F.col(place).alias("b"), time, F.col(value).alias("_y"))
    d = mine.join(nearest.filter("a <> b").select("a", "b"), "a").join(theirs, ["b", time]).groupBy("a", time).agg(F.sum(F.abs(F.col("_x") - F.col("_y"))).alias("_d"))
    std = d.groupBy("a").agg(F.stddev_samp("_d").alias("_s"))
    return d.join(std, "a").select(F.col("a").alias(place), time, F.try_divide(F.col("_d"), F.col("_s")).alias("score"))


def gaussian(half: float) -> object:
    """A weight of distance: from a column to a column."""
    return lambda d: F.exp(-F.pow(d / half, F.lit(2)))


def local_regression(df: DataFrame, dist: DataFrame, place: str, chunk: Sequence[str], x: str, y: str, cut: float, weight: object, least: int = 5) -> DataFrame:
    """(place, chunk, n, slope, icpt): weighted line of y on x over the places within `cut` metres, for each chunk of time."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(place).alias("b"), *chunk, F.col(x).alias("_x"), F.col(y).alias("_y"))
    near = dist.filter(F.col("metres") < cut).select(F.col("a").alias(place), "b", weight(F.col("metres")).alias("_w"))
    s = rows.join(near, "b").groupBy(place, *chunk).agg(F.count("*").alias("n"), *(F.sum(F.expr(e)).alias(n) for n, e in (("w", "_w"), ("sx", "_w * _x"), ("sy", "_w * _y"), ("sxx", "_w * _x * _x"), ("sxy", "_w * _x * _y"))))
    s = s.filter(F.col("n") >= least).withColumn("slope", F.expr("try_divide(w * sxy - sx * sy, w * sxx - sx * sx)"))
    return s.select(place, *chunk, "n", "slope", F.expr("(sy - slope * sx) / w").alias("icpt"))


def laplacian_regression(df: DataFrame, dist: DataFrame, place: str, chunk: str, x: str, y: str, smooth: float, weight: object, max_unknowns: int = 2000) -> DataFrame:
    """(place, chunk, slope, icpt): one line per place and chunk, with slopes pulled together along a graph: places by `weight` of distance,
    chunks with the next one. Spark sums centred squares per (place, chunk). The joint system of one unknown each is solved on the driver for up
    to `max_unknowns` (and so at most half their square in links of places), and by conjugate gradients in Spark for more.
    Rows that lack a place, chunk, x or y don't count."""
    sums = df.filter(F.col(place).isNotNull() & F.col(chunk).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(place).alias("_p"), F.col(chunk).alias("_c")).agg(F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    sums = stash(sums, "sums")
    n, scale = sums.agg(F.count("*"), F.avg("sxx")).first()
    scale = scale or 0.0
    there = sums.select("_p").distinct()
    pairs = dist.filter("a < b").select("a", "b", (weight(F.col("metres")) * smooth * scale).alias("w"))
    pairs = pairs.join(there.withColumnRenamed("_p", "a"), "a").join(there.withColumnRenamed("_p", "b"), "b")
    slopes = _slopes_on_driver(sums, pairs, smooth * scale, scale) if n <= max_unknowns else _slopes_by_gradients(sums, pairs, smooth * scale, scale)
    return slopes.select(F.col("_p").alias(place), F.col("_c").alias(chunk), "slope", F.expr("my - slope * mx").alias("icpt"))


def _slopes_on_driver(sums: DataFrame, pairs: DataFrame, along: float, scale: float) -> DataFrame:
    rows, links = sums.orderBy("_p", "_c").collect(), pairs.collect()
    at = {(r._p, r._c): i for i, r in enumerate(rows)}
    system, right = np.diag([r.sxx for r in rows] or [0.0]).astype(float), np.array([r.sxy for r in rows], float)

    def link(i: int, j: int, w: float) -> None:
        system[[i, j], [i, j]] += w
        system[[i, j], [j, i]] -= w

    for c in {r._c for r in rows}:
        for r in links:
            if (r.a, c) in at and (r.b, c) in at:
                link(at[r.a, c], at[r.b, c], r.w)
    for i, (r, later) in enumerate(zip(rows, rows[1:])):
        if r._p == later._p:
            link(i, i + 1, along)
    b = np.linalg.solve(system + (1e-12 * scale or 1.0) * np.eye(len(system)), right) if rows else []
    schema = T.StructType([*sums.schema.fields, T.StructField("slope", T.DoubleType())])
    return sums.sparkSession.createDataFrame([(*r, float(s)) for r, s in zip(rows, b)], schema)


def _slopes_by_gradients(sums: DataFrame, pairs: DataFrame, along: float, scale: float, settled: float = 1e-10, rounds: int = 1000) -> DataFrame:
    """The same system by conjugate gradients, scaled by the diagonal: a round joins the written links with the direction, and writes one
    row for each unknown. It ends once the scaled residual has fallen by `settled`; if it has not after `rounds`, this raises."""
    both = pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    nodes = sums.select("_p", "_c")
    near = nodes.join(both, nodes["_p"] == both["a"]).select("_p", "_c", F.col("b").alias("_q"), F.col("_c").alias("_d"), "w")
    near = near.join(nodes.select(F.col("_p").alias("_q"), F.col("_c").alias("_d")), ["_q", "_d"], "left_semi")
    later = nodes.withColumn("_d", F.lead("_c").over(Window.partitionBy("_p").orderBy("_c"))).filter("_d IS NOT NULL")
    ends = [later.select("_p", F.col(i).alias("_c"), F.col("_p").alias("_q"), F.col(j).alias("_d"), F.lit(along).alias("w")) for i, j in (("_c", "_d"), ("_d", "_c"))]
    links = stash(near.select("_p", "_c", "_q", "_d", "w").unionByName(ends[0]).unionByName(ends[1]), "links")
    degree = links.groupBy("_p", "_c").agg(F.sum("w").alias("_g"))
    diagonal = F.col("sxx") + F.coalesce("_g", F.lit(0.0)) + (1e-12 * scale or 1.0)
    start = sums.join(degree, ["_p", "_c"], "left").withColumn("d", diagonal).drop("_g")
    now = stash(start.withColumns({"slope": F.lit(0.0), "r": F.col("sxy"), "p": F.expr("sxy / d")}), "gradient")
    first = size = now.agg(F.sum(F.expr("r * r / d"))).first()[0] or 0.0
    for n in range(rounds):
        if size <= settled * settled * first:
            log.info("slopes settled after %d rounds", n)
            break
        pulled = links.join(now.select(F.col("_p").alias("_q"), F.col("_c").alias("_d"), F.col("p").alias("_v")), ["_q", "_d"]).groupBy("_p", "_c").agg(F.sum(F.expr("w * _v")).alias("_s"))
        met = stash(now.join(pulled, ["_p", "_c"], "left").withColumn("q", F.expr("d * p - coalesce(_s, 0D)")).drop("_s"), "gradient")
        step = size / met.agg(F.sum(F.expr("p * q"))).first()[0]
        moved = met.withColumns({"slope": F.col("slope") + step * F.col("p"), "r": F.col("r") - step * F.col("q")}).drop("q")
        last, size = size, moved.agg(F.sum(F.expr("r * r / d"))).first()[0]
        drop_stash(now)
        now = moved.withColumn("p", F.expr("r / d") + size / last * F.col("p"))
        now.stash_path = met.stash_path
    else:
        raise ArithmeticError(f"slopes not settled after {rounds} rounds")
    return now


def flag_statistics(flags: DataFrame, place: str) -> DataFrame:
    """Flags (check, place, flag) by check and place: number, flagged, least, largest and mean share."""
    per = flags.groupBy("check", place).agg(F.count("flag").alias("n"), F.sum(F.col("flag").cast("long")).alias("flagged"))
    return per.withColumn("share", F.col("flagged") / F.col("n"))


def merged_flags(data: DataFrame, flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Data with the sorted names of the checks that flagged each row."""
    names = flags.filter("flag").groupBy(*keys).agg(F.sort_array(F.collect_set("check")).alias("checks"))
    return data.join(names, list(keys), "left").withColumn("checks", F.coalesce("checks", F.array().cast("array<string>")))


def clustered_curves(curves: DataFrame, key: str, position: str, value: str, positions: Sequence, k: int, seed: int = 7) -> DataFrame:
    """(key, cluster): k-means of curves less their own mean; curves lack no position."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    w = Window.partitionBy(key)
    flat = curves.filter(F.col(position).isin(list(positions))).withColumn("_v", F.col(value) - F.avg(value).over(w))
    rows = flat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(position, "_v"))).alias("_c")).filter(F.size("_c") == len(positions))
    rows = stash(rows.select(key, F.transform("_c", lambda c: c["_v"]).alias("features")), "curves")
    vectors = rows.select(key, array_to_vector("features").alias("features"))
    return KMeans(k=k, seed=seed).fit(vectors).transform(vectors).select(key, F.col("prediction").alias("cluster"))


def clear_sky_slope(df: DataFrame, place: str, day: str, measured: str, top: str, sunshine: float = 0.9) -> DataFrame:
    """(place, slope, n): measured radiation on that at the top of the atmosphere, through the origin, in two rounds: days whose mean is over a
    share of the brightest day's ratio, then hours above the first line."""
    ok = df.filter((F.col(top) > 0) & (F.col(measured) <= F.col(top)))
    days = ok.groupBy(place, day).agg((F.avg(measured) / F.avg(top)).alias("_r"))
    bright = days.withColumn("_m", F.max("_r").over(Window.partitionBy(place))).filter(F.col("_r") > sunshine * F.col("_m")).select(place, day)
    first = line_fit(ok.join(bright, [place, day], "left_semi"), [place], top, measured, intercept=False).select(place, F.col("slope").alias("_b"))
    upper = ok.join(bright, [place, day], "left_semi").join(first, place).filter(F.col(measured) > F.col("_b") * F.col(top))
    return line_fit(upper, [place], top, measured, intercept=False).select(place, "slope", "n")


def orthogonal_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Total least squares line in closed form."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    s = s.withColumn("slope", F.expr("try_divide(yy - xx + sqrt((yy - xx) * (yy - xx) + 4 * xy * xy), 2 * xy)"))
    return s.select(*keys, "n", "slope", F.expr("my - slope * mx").alias("icpt"))


def ransac_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, rounds: int = 100, seed: int = 1) -> DataFrame:
    """Robust lines: seeded pairs of points propose, the median absolute deviation of y is the tolerance, the best proposal's inliers are fitted. Each key
    is a handful of points, such as yearly means."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y])
        px, py = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        rng, best = np.random.default_rng(seed), np.ones(len(px), bool)
        tolerance = np.median(np.abs(py - np.median(py)))
        most = -1
        for _ in range(rounds if len(px) > 2 else 0):
            i, j = rng.choice(len(px), 2, replace=False)
            if px[i] == px[j]:
                continue
            b = (py[j] - py[i]) / (px[j] - px[i])
            inside = np.abs(py - py[i] - b * (px - px[i])) <= tolerance
            if inside.sum() > most:
                most, best = inside.sum(), inside
        slope, icpt = np.polyfit(px[best], py[best], 1) if np.ptp(px[best]) > 0 else (np.nan, np.nan)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "slope": [slope], "icpt": [icpt], "inliers": [int(best.sum())]})

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("slope", T.DoubleType()), T.StructField("icpt", T.DoubleType()), T.StructField("inliers", T.LongType())])
    return df.select(*keys, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna().groupBy(*keys).applyInPandas(fit, schema)


def per_series(df: DataFrame, keys: Sequence[str], columns: Sequence[str], reduce: object, names: Sequence[str]) -> DataFrame:
    """A caller's reduction of each series, given its columns as arrays and returning a tuple of numbers. A built-in
    aggregate is better where there is one; series must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = reduce(*(pdf[c].to_numpy() for c in columns))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{n: [float(v)] for n, v in zip(names, out)}})

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in names])
    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(run, schema)


def each_run(runs: DataFrame, start: str, function: object, schema: str) -> DataFrame:
    """A caller's function of the rows of each run (pandas), given by the name `package.module.function` or itself."""
    if isinstance(function, str):
        from importlib import import_module

        module, _, name = function.rpartition(".")
        function = getattr(import_module(module), name)
    return runs.groupBy(start).applyInPandas(function, schema)


def weighted(df: DataFrame, distance: Column, weight: object) -> DataFrame:
    return df.withColumn("weight", weight(distance))
