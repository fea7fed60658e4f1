"""Principal components of many series, and filling of gaps with them. Spark makes the covariance matrix (D x D, D the number of
series); up to `max_series` it is solved on the driver, and beyond by Spark jobs that multiply it by a few vectors."""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.operators.aggregate import covariance, cross_sums
from cirrostrat.operators.grid import distance_weights
from cirrostrat.runtime import drop_stash, stash

log = logging.getLogger(__name__)


def eigenvectors(cov: DataFrame, k: int, max_series: int = 3000) -> tuple[list, np.ndarray, np.ndarray]:
    """Places in order, the k largest eigenvalues, and their vectors as columns, each with its largest entry positive; from written pairs
    (a, b, cov). Beyond `max_series` places the pairs stay in Spark, and the driver holds some 3 (k + 4) numbers for each place."""
    places = sorted(r.a for r in cov.select("a").union(cov.select("b")).distinct().collect())
    at = {p: i for i, p in enumerate(places)}
    if len(places) > max_series:
        values, vectors = _leading(cov, at, k)
    else:
        m = np.zeros((len(places), len(places)))
        rows = cov.select("a", "b", "cov").toArrow()
        i, j = (np.array([at[p] for p in rows.column(c).to_pylist()], int) for c in ("a", "b"))
        m[i, j] = m[j, i] = rows.column("cov").fill_null(0.0).to_numpy()
        values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)[:k]
    vectors = vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return places, values[order], vectors


def _leading(cov: DataFrame, at: dict, k: int, settled: float = 1e-9, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their vectors by locally optimal block gradients: each round multiplies the pairs by a basis of the
    vectors, their residuals and their last step, in one Spark job, and takes the best combination of the basis."""
    spark, kind, d = cov.sparkSession, cov.schema["a"].dataType.simpleString(), len(at)

    def product(basis: np.ndarray) -> np.ndarray:
        v = spark.createDataFrame(pa.table({"b": list(at), "_v": basis.tolist()})).select(F.col("b").cast(kind), "_v")
        both = cov.select("a", "b", "cov").unionByName(cov.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
        sums = both.join(v, "b").groupBy("a").agg(*(F.sum(F.col("cov") * F.col("_v")[c]).alias(f"_{c}") for c in range(basis.shape[1]))).toArrow()
        out = np.zeros(basis.shape)
        out[[at[p] for p in sums.column("a").to_pylist()]] = np.column_stack([sums.column(c + 1).fill_null(0.0).to_numpy() for c in range(basis.shape[1])])
        return out

    width = min(d, k + 4)
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(d, width)))[0]
    cx, step = product(x), np.zeros((d, 0))
    values = (x * cx).sum(0)
    for n in range(rounds):
        basis = np.linalg.qr(np.column_stack([x, cx - x * values, step]))[0]
        times = product(basis)
        best, mix = np.linalg.eigh(basis.T @ times)
        mix, values = mix[:, ::-1][:, :width], best[::-1][:width]
        new, cx = basis @ mix, times @ mix
        x, step = new, new - x @ (x.T @ new)
        miss = np.linalg.norm(cx - x * values, axis=0)[:k].max()
        if miss <= settled * max(abs(values[0]), 1e-300):
            log.info("components settled in round %d", n + 1)
            break
    else:
        raise ArithmeticError(f"components not settled after {rounds} rounds, residual {miss:g}")
    return values, x


def loadings(df: DataFrame, place: str, time: str, value: str, k: int, scale: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(place, component, weight) and (component, eigenvalue, explained): EOFs of the covariance over common times. `scale` (place, s) multiplies each series first."""
    if scale is not None:
        df = df.join(scale, place).withColumn(value, F.col(value) * F.col("s")).drop("s")
    cov = stash(covariance(df, place, time, value), "cov")
    total = cov.filter("a = b").agg(F.sum("cov")).first()[0]
    places, values, vectors = eigenvectors(cov, k)
    spark = df.sparkSession
    kind = dict(df.dtypes)[place]
    weights = spark.createDataFrame([(p, c, float(vectors[i, c])) for i, p in enumerate(places) for c in range(len(values))], f"{place} {kind}, component int, weight double")
    shares = spark.createDataFrame([(c, float(v), float(v / total)) for c, v in enumerate(values)], "component int, eigenvalue double, explained double")
    return weights, shares


def _score_rows(df: DataFrame, weights: DataFrame, place: str, time: str, value: str) -> tuple[DataFrame, DataFrame, list]:
    """(time, _s) with an array of scores, one row for each time; (place, _m, _v) with the mean and an array of weights; and the components in order. The
    weights, which the driver made, are sent to all tasks, so that no task gets all times of a place."""
    order = sorted(r.component for r in weights.select("component").distinct().collect())
    by_place = weights.groupBy(place).agg(*(F.sum(F.when(F.col("component") == c, F.col("weight"))).alias(f"_{n}") for n, c in enumerate(order)))
    by_place = by_place.select(place, F.array(*(f"_{n}" for n in range(len(order)))).alias("_v"))
    by_place = F.broadcast(df.groupBy(place).agg(F.avg(value).alias("_m")).join(F.broadcast(by_place), place))
    x = F.col(value) - F.col("_m")
    sums = df.join(by_place, place).groupBy(time).agg(*(F.sum(F.col("_v")[n] * x).alias(f"_{n}") for n in range(len(order))))
    return sums.select(time, F.array(*(f"_{n}" for n in range(len(order)))).alias("_s")), by_place, order


def scores(df: DataFrame, weights: DataFrame, place: str, time: str, value: str) -> DataFrame:
    """(time, component, score) of the anomalies; weights are D x k rows."""
    rows, _, order = _score_rows(df, weights, place, time, value)
    kind = dict(weights.dtypes)["component"]
    each = F.explode(F.array(*(F.struct(F.lit(c).cast(kind).alias("component"), F.col("_s")[n].alias("score")) for n, c in enumerate(order))))
    return rows.select(time, each.alias("_e")).select(time, "_e.component", "_e.score")


def with_reconstruction(df: DataFrame, weights: DataFrame, place: str, time: str, value: str, out: str = "rebuilt") -> DataFrame:
    """Each row with what the components give for its place and time. A row for each place, time and component is never made, and no row
    is sorted: the scores of a time are one row, and a task holds those of its times."""
    rows, by_place, order = _score_rows(df, weights, place, time, value)
    rebuilt = sum((F.col("_s")[n] * F.col("_v")[n] for n in range(len(order))), F.lit(0.0)) + F.col("_m")
    return df.join(rows.hint("shuffle_hash"), time).join(by_place, place).withColumn(out, rebuilt).select(*df.columns, out)


def reconstruction(score: DataFrame, weights: DataFrame, means: DataFrame, place: str, time: str) -> DataFrame:
    """(place, time, rebuilt) from scores, weights and the means (place, mean)."""
    parts = score.join(weights, "component").groupBy(place, time).agg(F.sum(F.col("score") * F.col("weight")).alias("_s"))
    return parts.join(means, place).select(place, time, (F.col("_s") + F.col("mean")).alias("rebuilt"))


def rms_difference(a: DataFrame, b: DataFrame | None, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(rms, n) of the difference of two columns at common keys, and the missing share of the first. Without `b`, `a` has both columns."""
    d = F.col(x) - F.col(y)
    both = a if b is None else a.join(b, list(keys))
    return both.agg(F.sqrt(F.avg(d * d)).alias("rms"), F.count(d).alias("n"), F.avg(F.col(x).isNull().cast("double")).alias("missing"))


def fill_gaps(df: DataFrame, place: str, time: str, value: str, k: int, rounds: int = 100, settled: float = 1e-6, max_series: int = 3000) -> DataFrame:
    """(place, time, value, filled, settled): gaps from k components, refilled until the fit to what was observed stops changing. Each round is two
    passes over a written table, and `eigenvectors` of the D x D sums. Every (place, time) of `df` has a row, null where missing.
    `settled` is false in all rows, and a warning is logged, if `rounds` ended before the fit had settled."""
    done = True
    means = df.groupBy(place).agg(F.avg(value).alias("_mean"))
    base = stash(df.join(means, place).select(place, time, value, "_mean", (F.col(value) - F.col("_mean")).alias("_x")), "gaps")
    current, last = base.withColumn("_y", F.coalesce("_x", F.lit(0.0))), None
    kind = dict(df.dtypes)[place]
    for n in range(rounds):
        cov = stash(cross_sums(current, place, time, "_y").select("a", "b", F.col("sxy").alias("cov")), "cov")
        places, _, vectors = eigenvectors(cov, k, max_series)
        drop_stash(cov)
        weights = df.sparkSession.createDataFrame([(p, v) for p, v in zip(places, vectors.tolist())], f"{place} {kind}, _v array<double>")
        met = current.join(weights, place)
        score = met.groupBy(time).agg(*(F.sum(F.col("_y") * F.col("_v")[c]).alias(f"_s{c}") for c in range(vectors.shape[1])))
        rebuilt = sum((F.col(f"_s{c}") * F.col("_v")[c] for c in range(vectors.shape[1])), F.lit(0.0))
        made = stash(met.join(score, time).select(place, time, value, "_mean", "_x", F.coalesce("_x", rebuilt).alias("_y"), rebuilt.alias("_r")), "filled")
        drop_stash(base)
        loss = made.agg(F.avg(F.pow(F.col("_x") - F.col("_r"), F.lit(2)))).first()[0] or 0.0
        base, current = made, made.drop("_r")
        if n > 1 and last is not None and abs(last - loss) < settled:
            log.info("gaps settled in round %d, loss %g", n + 1, loss)
            break
        last = loss
    else:
        log.warning("gaps not settled after %d rounds, loss %s", rounds, last)
        done = False
    return current.select(place, time, value, (F.col("_y") + F.col("_mean")).alias("filled"), F.lit(done).alias("settled"))


def random_mask(df: DataFrame, keys: Sequence[str], share: float, seed: int = 1) -> DataFrame:
    """`masked` for a share of cells, by a hash of their keys, so that it is the same at every run and partitioning."""
    return df.withColumn("masked", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(share * 1_000_000))


def block_mask(df: DataFrame, place: str, time: str, share: float, mean_length: int, seed: int = 1) -> DataFrame:
    """`masked` for blocks of numbered times: starts are drawn by hash, lengths are geometric about a mean."""
    u = F.pmod(F.xxhash64(F.lit(seed), place, time), F.lit(1_000_003)) / 1_000_003
    length = F.greatest(F.lit(1), F.ceil(F.log(F.greatest(F.pmod(F.xxhash64(F.lit(seed + 1), place, time), F.lit(1_000_003)) / 1_000_003, F.lit(1e-9))) * -mean_length)).cast("long")
    starts = df.withColumn("_end", F.when(u < share / mean_length, F.col(time) + length - 1))
    w = Window.partitionBy(place).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return starts.withColumn("masked", F.coalesce(F.max("_end").over(w) >= F.col(time), F.lit(False))).drop("_end")


def distant_dropped(stations: DataFrame) -> DataFrame:
    """(station, weight): summed squared distances to all, without stations whose sum is over the mean plus one deviation."""
    total = stash(distance_weights(stations), "weights")
    limit = total.agg((F.avg("weight") + F.stddev_samp("weight")).alias("_limit"))  # one row
    return total.join(F.broadcast(limit)).filter("weight <= _limit").drop("_limit")


def aligned(weights: DataFrame, reference: DataFrame, place: str) -> DataFrame:
    """Weights (place, component, weight) with the signs that agree with a reference's components."""
    dot = weights.join(reference.select(place, "component", F.col("weight").alias("_r")), [place, "component"]).groupBy("component").agg(F.sum(F.expr("weight * _r")).alias("_d"))
    return weights.join(dot, "component").withColumn("weight", F.when(F.col("_d") < 0, -F.col("weight")).otherwise(F.col("weight"))).drop("_d")


def scaled(weights: DataFrame, score: DataFrame, time: str) -> tuple[DataFrame, DataFrame]:
    """Weights and scores such that each component's scores have a mean square of one."""
    size = score.groupBy("component").agg(F.sqrt(F.avg(F.pow("score", F.lit(2)))).alias("_s"))
    return weights.join(size, "component").withColumn("weight", F.col("weight") * F.col("_s")).drop("_s"), score.join(size, "component").withColumn("score", F.try_divide("score", "_s")).select(time, "component", "score")


def rotated(rows: DataFrame, matrix: np.ndarray, keys: Sequence[str], value: str) -> DataFrame:
    """Components mixed by a K x K matrix: new component c is the sum over k of matrix[k, c] times component k."""
    mix = rows.sparkSession.createDataFrame([(k, c, float(matrix[k, c])) for k in range(matrix.shape[0]) for c in range(matrix.shape[1])], "component int, _c int, _m double")
    out = rows.join(F.broadcast(mix), "component").groupBy(*keys, "_c").agg(F.sum(F.col(value) * F.col("_m")).alias(value))  # K x K rows
    return out.withColumnRenamed("_c", "component")
