"""Spectra of unevenly spaced series: least-squares periodograms, overlapping segments, cross spectra, single cycles."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrostrat.functions.stats import chi2_quantile


def _with_frequencies(df: DataFrame, freqs: Sequence[float]) -> DataFrame:
    """One row for each frequency; the list is short and comes from the caller."""
    each = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(float(f)).alias("f")) for i, f in enumerate(freqs) if f))
    return df.withColumn("_f", F.explode(each)).select("*", F.col("_f.k").alias("k"), F.col("_f.f").alias("f")).drop("_f")


def periodogram(df: DataFrame, keys: Sequence[str], t: str, value: str, freqs: Sequence[float], norm: str = "psd", weight: Column | None = None) -> DataFrame:
    """(keys, k, f, re, im, power): the normalised least-squares transform at each frequency (cycles per unit of `t`). Nulls are left out.
    Pass one sums sin 2wt and cos 2wt to the shift tau, pass two has five sums; both combine before the shuffle. The work is rows times frequencies: for
    many evenly spaced ones there is `full_periodogram`. norm: `psd` for density, `pow` for the power spectrum, `raw` for neither."""
    rows = df.filter(F.col(value).isNotNull())
    y = F.col(value) if weight is None else F.col(value) * weight
    rows = _with_frequencies(rows.select(*keys, F.col(t).cast("double").alias("_t"), y.alias("_y")), freqs)
    w = 2 * pi * F.col("f")
    tau = rows.groupBy(*keys, "k", "f").agg((F.atan2(F.sum(F.sin(2 * w * F.col("_t"))), F.sum(F.cos(2 * w * F.col("_t")))) / (2 * w)).alias("_tau"))
    met = rows.join(tau, [*keys, "k", "f"])
    a = w * (F.col("_t") - F.col("_tau"))
    s = met.groupBy(*keys, "k", "f", "_tau").agg(
        F.sum(F.col("_y") * F.cos(a)).alias("_yc"), F.sum(F.col("_y") * F.sin(a)).alias("_ys"), F.sum(F.cos(a) * F.cos(a)).alias("_cc"), F.sum(F.sin(a) * F.sin(a)).alias("_ss"), F.sum(F.col("_t") * F.sin(a) * F.cos(a)).alias("_cross"),
        F.sum("_y").alias("_sy"), F.count("*").alias("n"), (F.max("_t") - F.min("_t")).alias("_span"),
    )
    return _normalised(s, keys, norm)


#: Under the first bound the sine term has no norm (at the Nyquist frequency of even steps): the mean takes its place, or nothing where the cross term is over the second.
NO_SINE, NO_CROSS = 1e-4, 1e-8


def _normalised(s: DataFrame, keys: Sequence[str], norm: str) -> DataFrame:
    """(keys, k, f, re, im, power, n) from the sums of a frequency."""
    c = F.col("_yc") / F.sqrt("_cc")
    none = F.when(F.col("_cross") > NO_CROSS, 0.0).otherwise(F.col("_sy") / F.sqrt("n"))
    sn = F.when(F.col("_ss") < NO_SINE, none).otherwise(F.col("_ys") / F.sqrt("_ss"))
    scale = {"psd": F.sqrt(F.col("_span") / F.col("n")), "pow": 1 / F.sqrt("n"), "raw": F.lit(1.0)}[norm] / F.sqrt(F.lit(2.0))
    # The shift tau turns the transform by -w * tau.
    turn = 2 * pi * F.col("f") * F.col("_tau")
    out = s.withColumn("re", scale * (c * F.cos(turn) - sn * F.sin(turn))).withColumn("im", scale * (c * F.sin(turn) + sn * F.cos(turn)))
    return out.select(*keys, "k", "f", "re", "im", (2 * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("power"), "n")


def grid_transform(t: np.ndarray, values: np.ndarray, first: float, step: float, count: int, width: int = 14) -> np.ndarray:
    """Sums of values * exp(-2 pi i f t) at f = first + step * k for k under `count`: each value is spread over `width` cells of a regular grid with
    twice as many cells as frequencies, which a fast transform turns into all sums; they are divided by the transform of what was spread.
    The work is rows + count * log(count), the error about 1e-12 of the sum of all sizes."""
    middle, cells = count // 2, 1 << max(6, (2 * count - 1).bit_length())
    beta = 2.3 * width
    turned = values * np.exp(-2j * pi * (((first + middle * step) * t) % 1.0))
    place = ((step * t) % 1.0) * cells
    low = np.ceil(place - width / 2)
    grid = np.zeros(cells, complex)
    for k in range(width):
        u = low + k - place
        share = turned * np.exp(beta * (np.sqrt(np.maximum(0.0, 1 - (2 * u / width) ** 2)) - 1))
        at = (low + k).astype(np.int64) % cells
        grid += np.bincount(at, share.real, cells) + 1j * np.bincount(at, share.imag, cells)
    k = np.arange(count) - middle
    nodes, weights = np.polynomial.legendre.leggauss(40)
    bell = weights * np.exp(beta * (np.sqrt(1 - nodes**2) - 1))
    spread = width / 2 * np.sum(bell[:, None] * np.cos(2 * pi / cells * width / 2 * nodes[:, None] * k), axis=0)
    return np.fft.fft(grid)[k % cells] / spread


def _transforms(rows: DataFrame, keys: Sequence[str], first: float, step: float, count: int, double: bool, rows_per_task: int) -> DataFrame:
    """(keys, k, yr, yi, n, _sy, t0, t1), and with `double` the transforms of 1 and of t at twice the frequencies, from rows (keys, _t, _y). A series is
    dealt into parts of so many rows; parts are transformed as wholes, and their sums at a frequency are added up."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("_parts"))
    dealt = rows.join(counts, list(keys)).withColumn("_part", F.pmod(F.xxhash64("_t", "_y"), F.col("_parts")))
    names = ["yr", "yi", *(["wr", "wi", "tr", "ti"] if double else [])]
    fields = [T.StructField(c, T.DoubleType()) for c in (*names, "n", "_sy", "t0", "t1")]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("k", T.IntegerType()), *fields])

    def run(key: tuple, part: pa.Table) -> pa.Table:
        t, y = (part.column(c).to_numpy().astype(float) for c in ("_t", "_y"))
        sums = [grid_transform(t, y, first, step, count)]
        if double:
            sums += [grid_transform(t, v, 2 * first, 2 * step, count) for v in (np.ones(len(t)), t)]
        columns = [x for z in sums for x in (z.real, z.imag)]
        ends = [np.full(count, x) for x in (float(len(t)), y.sum(), t.min(), t.max())]
        return pa.Table.from_arrays([*(pa.repeat(g, count) for g in key[:-1]), pa.array(np.arange(count, dtype=np.int32)), *map(pa.array, (*columns, *ends))], names=schema.names)

    made = dealt.groupBy(*keys, "_part").applyInArrow(run, schema)
    return made.groupBy(*keys, "k").agg(*(F.sum(c).alias(c) for c in (*names, "n", "_sy")), F.min("t0").alias("t0"), F.max("t1").alias("t1"))


def full_periodogram(df: DataFrame, keys: Sequence[str], t: str, value: str, step: float, count: int, first: float | None = None, norm: str = "psd", rows_per_task: int = 1 << 19) -> DataFrame:
    """As `periodogram`, at `count` frequencies from `first` (else `step`) on, `step` apart: the sums come from fast transforms on a regular grid, so that
    rows are not multiplied by frequencies. sin^2 and cos^2 sums follow from the transform of 1 at twice the frequency, turned by the shift."""
    first = step if first is None else first
    rows = df.filter(F.col(value).isNotNull() & F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_y"))
    s = _transforms(rows, keys, first, step, count, True, rows_per_task).withColumn("f", first + step * F.col("k")).filter("f <> 0")
    w = 2 * pi * F.col("f")
    s = s.withColumn("_tau", F.atan2(-F.col("wi"), F.col("wr")) / (2 * w))
    cos, sin, size = F.cos(w * F.col("_tau")), F.sin(w * F.col("_tau")), F.sqrt(F.expr("wr * wr + wi * wi"))
    both = F.cos(2 * w * F.col("_tau")), F.sin(2 * w * F.col("_tau"))
    s = s.withColumns({
        "_yc": F.col("yr") * cos - F.col("yi") * sin, "_ys": -F.col("yi") * cos - F.col("yr") * sin, "_cc": (F.col("n") + size) / 2, "_ss": (F.col("n") - size) / 2,
        "_cross": (-F.col("ti") * both[0] - F.col("tr") * both[1]) / 2, "_span": F.col("t1") - F.col("t0"), "n": F.col("n").cast("long"),
    })
    return _normalised(s, keys, norm)


def full_fourier_sums(df: DataFrame, keys: Sequence[str], t: str, value: str, step: float, count: int, first: float | None = None, left_out: Column | None = None, rows_per_task: int = 1 << 19) -> DataFrame:
    """As `fourier_sums`, at evenly spaced frequencies, by fast transforms."""
    first = step if first is None else first
    rows = df.filter(F.col(value).isNotNull() & F.col(t).isNotNull())
    rows = rows.filter(~left_out) if left_out is not None else rows
    s = _transforms(rows.select(*keys, F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_y")), keys, first, step, count, False, rows_per_task)
    return s.select(*keys, "k", (first + step * F.col("k")).alias("f"), (F.col("yr") / F.col("n")).alias("re"), (F.col("yi") / F.col("n")).alias("im"))


def segments(df: DataFrame, keys: Sequence[str], t: str, value: str, n: int) -> DataFrame:
    """Rows dealt into 2n - 1 half-overlapping segments, `_w` being the Hann weight; a row is in two at most."""
    x = F.col(t).cast("double")
    ends = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(x).alias("_t0"), F.max(x).alias("_t1"))
    met = df.filter(F.col(value).isNotNull()).join(ends, list(keys)).filter("_t1 > _t0").withColumn("_half", (F.col("_t1") - F.col("_t0")) / n / 2)
    place = (x - F.col("_t0")) / F.col("_half")
    first = F.floor(place).cast("int")
    met = met.withColumn("segment", F.explode(F.array_distinct(F.array(*(F.greatest(F.lit(0), F.least(c, F.lit(2 * n - 2))) for c in (first - 1, first))))))
    met = met.withColumn("_u", (place - F.col("segment")) / 2).filter("_u BETWEEN 0 AND 1")
    return met.withColumn("_w", 0.5 - 0.5 * F.cos(2 * pi * F.col("_u"))).withColumn("_width", 2 * F.col("_half")).drop("_t0", "_t1", "_half", "_u")


def segment_transforms(df: DataFrame, keys: Sequence[str], t: str, value: str, freqs: Sequence[float], n: int) -> DataFrame:
    cut = segments(df, keys, t, value, n)
    raw = periodogram(cut, [*keys, "segment"], t, value, freqs, "raw", F.col("_w"))
    norms = cut.groupBy(*keys, "segment").agg(F.sqrt(F.first("_width") / F.sum(F.col("_w") * F.col("_w"))).alias("_s"))
    met = raw.join(norms, [*keys, "segment"])
    return met.select(*keys, "segment", "k", "f", (F.col("re") * F.col("_s")).alias("re"), (F.col("im") * F.col("_s")).alias("im"))


def effective_segments(n: int, overlap: float = 0.167) -> float:
    return (2 * n - 1) / (1 + overlap**2 * (2 - 2 / n))


def welch(df: DataFrame, keys: Sequence[str], t: str, value: str, freqs: Sequence[float], n: int, alpha: float | None = None) -> DataFrame:
    """(keys, k, f, power): the mean over segments, and factors `low` and `high` of its confidence interval."""
    out = segment_transforms(df, keys, t, value, freqs, n).groupBy(*keys, "k", "f").agg((2 * F.avg(F.expr("re * re + im * im"))).alias("power"))
    if alpha is None:
        return out
    dof = 2 * effective_segments(n)
    return out.withColumn("low", F.lit(dof / chi2_quantile(1 - alpha / 2, dof))).withColumn("high", F.lit(dof / chi2_quantile(alpha / 2, dof)))


def coherence(df: DataFrame, key: str, a: object, b: object, t: str, value: str, freqs: Sequence[float], n: int) -> DataFrame:
    """(k, f, re, im, coherence) of two series of `key`: mean cross spectrum over segments and squared coherence."""
    g = segment_transforms(df, [key], t, value, freqs, n)
    x = g.filter(F.col(key) == a).select("segment", "k", "f", F.col("re").alias("xr"), F.col("im").alias("xi"))
    y = g.filter(F.col(key) == b).select("segment", "k", F.col("re").alias("yr"), F.col("im").alias("yi"))
    s = x.join(y, ["segment", "k"]).groupBy("k", "f").agg(F.avg(F.expr("xr * yr + xi * yi")).alias("re"), F.avg(F.expr("xi * yr - xr * yi")).alias("im"), F.avg(F.expr("xr * xr + xi * xi")).alias("_x"), F.avg(F.expr("yr * yr + yi * yi")).alias("_y"))
    return s.withColumn("coherence", F.expr("(re * re + im * im) / (_x * _y)")).drop("_x", "_y")


def one_cycle(df: DataFrame, keys: Sequence[str], t: str, value: str, period: float) -> DataFrame:
    """Amplitude and the phase of the maximum (in units of t, 0 to period) of the least-squares cycle of one period about the mean; null where
    the series spans less than a quarter of it."""
    x = F.col(t).cast("double")
    there = df.filter(F.col(value).isNotNull())
    rows = there.join(there.groupBy(*keys).agg(F.avg(value).alias("_m")), list(keys)).select(*keys, x.alias("_t"), (F.col(value) - F.col("_m")).alias("_y"))
    c, s = F.cos(2 * pi / period * F.col("_t")), F.sin(2 * pi / period * F.col("_t"))
    m = rows.groupBy(*keys).agg(F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(F.col("_y") * c).alias("yc"), F.sum(F.col("_y") * s).alias("ys"), (F.max("_t") - F.min("_t")).alias("_span"))
    det = F.expr("cc * ss - cs * cs")
    a, b = F.try_divide(F.expr("yc * ss - ys * cs"), det), F.try_divide(F.expr("ys * cc - yc * cs"), det)
    long = F.col("_span") >= period / 4
    return m.select(*keys, F.when(long, F.sqrt(a * a + b * b)).alias("amplitude"), F.when(long, F.pmod(F.atan2(b, a) / (2 * pi) * period, F.lit(float(period)))).alias("phase"))


def fourier_sums(df: DataFrame, keys: Sequence[str], t: str, value: str, freqs: Sequence[float], left_out: Column | None = None) -> DataFrame:
    """(keys, k, f, re, im): plain Fourier means at a few frequencies, without a missing block."""
    rows = df.filter(F.col(value).isNotNull())
    rows = rows.filter(~left_out) if left_out is not None else rows
    rows = _with_frequencies(rows.select(*keys, F.col(t).cast("double").alias("_t"), F.col(value).alias("_y")), freqs)
    a = 2 * pi * F.col("f") * F.col("_t")
    return rows.groupBy(*keys, "k", "f").agg(F.avg(F.col("_y") * F.cos(a)).alias("re"), F.avg(-F.col("_y") * F.sin(a)).alias("im"))
