"""Fast transforms at all frequencies against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.operators import spectral


@pytest.mark.parametrize(("n", "first", "step", "count"), [(1, 0.0, 0.1, 5), (700, 0.3, 0.001, 4000), (5000, 0.0007, 0.0007, 1000)])
def test_grid_transform(n, first, step, count):
    draw = np.random.default_rng(n)
    t, y = np.sort(draw.uniform(-3000, 9000, n)), draw.normal(size=n)
    got = spectral.grid_transform(t, y, first, step, count)
    for k in {0, 1, count // 2, count - 1, *draw.integers(0, count, 30).tolist()}:
        assert abs(got[k] - np.sum(y * np.exp(-2j * np.pi * (first + step * k) * t))) < 1e-9 * np.abs(y).sum()


def test_full_periodogram_equals_direct_sums(spark):
    draw = np.random.default_rng(4)
    rows = [(k, float(t), float(np.sin(t / 7) + draw.normal())) for k, n in (("a", 3000), ("b", 40)) for t in np.sort(draw.uniform(0, 2000, n))] + [("a", 5.0, None)]
    rows += [("even", float(t), float(draw.normal())) for t in range(64)]
    df = spark.createDataFrame(rows, "s string, t double, y double").repartition(5)
    some = sorted(draw.choice(np.arange(1, 10_000), 50, replace=False).tolist())
    for norm in ("psd", "pow", "raw"):
        full = spectral.full_periodogram(df, ["s"], "t", "y", 1e-4, 10_000, norm=norm, rows_per_task=400)
        got = {(r.s, round(r.f, 8)): r for r in full.filter((F.col("k") + 1).isin(some)).collect()}
        want = {(r.s, round(r.f, 8)): r for r in spectral.periodogram(df, ["s"], "t", "y", [k * 1e-4 for k in some], norm).collect()}
        assert got.keys() == want.keys() and len(got) == 150
        for key, w in want.items():
            assert np.allclose([got[key].re, got[key].im, got[key].power], [w.re, w.im, w.power], rtol=1e-6, atol=1e-6), key
            assert got[key].n == w.n
    assert full.count() == 30_000


def test_nyquist_of_even_steps(spark):
    """Where the sine term has no norm, both ways take the same stand-in."""
    df = spark.createDataFrame([("e", float(t), float(t % 3) - 1.0) for t in range(64)], "s string, t double, y double")
    direct = spectral.periodogram(df, ["s"], "t", "y", [0.25, 0.5]).orderBy("f").collect()
    full = spectral.full_periodogram(df, ["s"], "t", "y", 0.25, 2).orderBy("f").collect()
    assert np.allclose([[r.re, r.im, r.power] for r in direct], [[r.re, r.im, r.power] for r in full], atol=1e-7)


def test_full_fourier_sums(spark):
    draw = np.random.default_rng(5)
    df = spark.createDataFrame([("a", float(t), float(draw.normal())) for t in range(500)], "s string, t double, y double")
    out = F.col("t").between(100, 200)
    want = {r.k: (r.re, r.im) for r in spectral.fourier_sums(df, ["s"], "t", "y", [0.01 * (i + 1) for i in range(9)], out).collect()}
    got = {r.k: (r.re, r.im) for r in spectral.full_fourier_sums(df, ["s"], "t", "y", 0.01, 9, left_out=out, rows_per_task=100).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    assert spectral.full_fourier_sums(df.limit(0), ["s"], "t", "y", 0.01, 9).count() == 0
