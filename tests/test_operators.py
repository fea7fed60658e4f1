"""Small fixtures whose results were worked out by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat import plans
from cirrostrat.functions import geo, physics, stats, times
from cirrostrat.operators import aggregate, binning, compare, eof, grid, join, regress, select, spectral, terrain, vertical, windows


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def records(spark):
    data = [("a", 900, 10.0), ("a", 2700, 20.0), ("a", 4500, 40.0)]
    return spark.createDataFrame([(s, t, v, v - 1, v + 1) for s, t, v in data], "sensor string, t long, ave double, min double, max double")


def test_bins_share_a_record_by_time(records):
    # Half an hour each: (-900, 900], (900, 2700], (2700, 4500]; the last is half in either hour, the first half in the hour before.
    out = binning.weighted_bins(records, ["sensor"], "t", F.lit(1800), label="start")
    got = {r.bin: r for r in out.collect()}
    assert got[-3600].ave == 10.0
    assert got[0].ave == pytest.approx((10 * 900 + 20 * 1800 + 40 * 900) / 3600)
    assert got[3600].ave == 40.0
    assert (got[-3600]["min"], got[0]["min"], got[3600]["max"]) == (9.0, 19.0, None)  # equal parts count in the earlier bin


def test_null_records_weigh_nothing(spark):
    df = spark.createDataFrame([("a", 1800, 10.0), ("a", 3600, None)], "sensor string, t long, v double")
    out = binning.weighted_bins(df, ["sensor"], "t", F.lit(1800), ave="v", low="v", high="v")
    assert rows(out, "bin", "ave") == [(3600, 10.0)]


def test_trapezoid_needs_two_points(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1200, 6.0), ("a", 2400, 6.0), ("a", 9000, 1.0)], "k string, t long, v double")
    got = {r.bin: r.ave for r in binning.trapezoid_hours(df, ["k"], "t", "v").collect()}
    # Stamps move back by ten minutes: the first falls into the hour before.
    assert got == {0: None, 3600: 6.0, 10800: None}


def test_alignment_serves_many_runs_and_keeps_gaps(spark):
    f = spark.createDataFrame([("s", 0, 1, 3580, 5.0), ("s", 3600, 0, 3620, 6.0), ("s", 0, 2, 7200, 7.0)], "station string, start long, step int, valid long, v double")
    o = spark.createDataFrame([("s", 3600, 4.0)], "station string, ts long, obs double")
    out = join.errors(join.align(f, o), "v", "obs")
    assert sorted((r.start, r.step, r.error) for r in out.collect() if r.error is not None) == [(0, 1, 1.0), (3600, 0, 2.0)]
    assert out.filter("error IS NULL").count() == 1
    assert join.errors(join.align(f, o), "v", "obs", accumulated=True).filter("error IS NULL").count() == 2


def test_fill_over_and_history(spark):
    new = spark.createDataFrame([(1, None, 5), (3, 1.0, 1)], "k int, v double, n int")
    old = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    assert rows(join.fill_over(new, old, ["k"]).fillna(-1), "k", "v", "n") == [(1, 2.0, 5), (2, 3.0, -1), (3, 1.0, 1)]
    shots = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None)], "s string, version int, elev double")
    assert rows(join.station_history(shots, "s", "version", ["elev"]), "s", "elev") == [("a", 10.0)]


@pytest.mark.parametrize(("closed", "want"), [("right", [2.0, 0.0]), ("both", [3.0, 2.0])])
def test_interval_sums_at_the_bounds(spark, closed, want):
    passes = spark.createDataFrame([("c", 0), ("c", 100), ("c", 200)], "c string, t long")
    rain = spark.createDataFrame([("c", 0, 1.0), ("c", 100, 2.0)], "c string, t long, v double")
    out = join.interval_sums(rain, passes, ["c"], "t", "v", "t", closed)
    assert [r.total for r in out.orderBy("start").collect()] == want


def test_as_of_takes_the_value_of_the_same_time(spark):
    a = spark.createDataFrame([("k", 5), ("k", 10), ("k", 1)], "k string, t long")
    b = spark.createDataFrame([("k", 5, 1.0), ("k", 8, None)], "k string, t long, x double")
    assert rows(join.as_of(a, b, ["k"], "t", "x").fillna(-1.0), "t", "x") == [(1, -1.0), (5, 1.0), (10, 1.0)]


def test_nearest_in_time_prefers_the_earlier_on_a_tie(spark):
    a, b = spark.createDataFrame([(50,), (500,)], "t long"), spark.createDataFrame([(40,), (60,)], "s long")
    assert rows(join.nearest_in_time(a, b, "t", "s", 100).fillna(-1), "t", "nearest") == [(50, 40), (500, -1)]
    assert rows(join.nearest_before(a, b, "t", "s", 100).fillna(-1), "t", "run") == [(50, 40), (500, -1)]


def test_contingency_leaves_nulls_out(spark):
    df = spark.createDataFrame([("s", -1.0, -1.0), ("s", 1.0, -1.0), ("s", -1.0, 1.0), ("s", 1.0, 1.0), ("s", None, -1.0)], "s string, o double, f double")
    r = aggregate.contingency(df, ["s"], F.col("o") < 0, F.col("f") < 0).first()
    assert (r.a, r.b, r.c, r.d, r.n, r.threat) == (1, 1, 1, 1, 4, pytest.approx(1 / 3))


def test_shape_statistics_match_pandas(spark):
    import pandas as pd

    v = [1.0, 2.0, 4.0, 8.0, 9.5, 3.0]
    r = aggregate.shape_statistics(spark.createDataFrame([("k", x) for x in v], "k string, v double"), ["k"], "v").first()
    assert (r.skew, r.kurt) == (pytest.approx(pd.Series(v).skew()), pytest.approx(pd.Series(v).kurt()))


def test_season_and_water_year(spark):
    d = spark.createDataFrame([(dt.date(2020, 12, 5),), (dt.date(2021, 2, 28),), (dt.date(2021, 3, 1),)], "d date")
    assert rows(d.select("d", times.season_start(F.col("d")).alias("s"), times.season_class(F.col("d")).alias("c")), "d", "s", "c") == [(dt.date(2020, 12, 5), dt.date(2020, 12, 1), 0), (dt.date(2021, 2, 28), dt.date(2020, 12, 1), 0), (dt.date(2021, 3, 1), dt.date(2021, 3, 1), 1)]
    assert [r[0] for r in d.orderBy("d").select(times.water_year(F.col("d"), 4, 12)).collect()] == [2020, 2020, 2020]


def test_binned_statistic_holds_the_largest_value(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(11)], "x double, y double")
    out = {r.bin: (r.n, r["mean"]) for r in aggregate.binned_statistic(df, "x", "y", 5).collect()}
    assert out[5] == (3, 9.0) and sum(n for n, _ in out.values()) == 11


def test_islands_segments_and_breaks(spark):
    df = spark.createDataFrame([("k", t, v) for t, v in zip([0, 300, 600, 900, 4500, 8100, 11700, 12000], [1, None, None, 1, None, 1, 1, 1])], "k string, t long, v int")
    assert rows(windows.islands(df, ["k"], "t", F.col("v").isNull()), "start", "end", "length") == [(300, 600, 2), (4500, 4500, 1)]
    seg = windows.interval_segments(df, ["k"], "t", least=2)
    assert [r.segment for r in seg.orderBy("t").collect()] == [0, 0, 0, 0, 1, 1, 2, 2]
    assert windows.breaks(df, ["k"], "t", 3000).first()["gaps"] == 3


def test_gauge_amounts_and_spikes(spark):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate([1.0, 3.0, 2.0, 2.0, 9.0, 2.0])], "k string, t long, total double")
    assert [r.amount for r in windows.amounts(df, ["k"], "t", "total").orderBy("t").collect()] == [1.0, 2.0, None, 0.0, 7.0, None]
    assert rows(windows.without_spikes(df, ["k"], "t", "total"), "t") == [(0,), (1,), (2,), (3,), (5,)]


def test_filters_keep_a_constant_and_pass_gaps(spark):
    df = spark.createDataFrame([("k", i, 5.0 if i != 7 else None) for i in range(20)], "k string, i long, v double")
    out = windows.fir(df, ["k"], "i", "v", {"l": windows.lanczos_weights(4)})
    assert out.count() == 20 and all(abs(r.filtered - 5) < 1e-9 for r in out.collect())


@pytest.mark.parametrize("renormalise", [True, False])
def test_filters_of_chunks_agree_with_brute_force(spark, renormalise):
    rng = np.random.default_rng(1)
    data = [(k, int(i), None if i % 11 == 0 else float(x)) for k in ("a", None) for i, x in zip(range(-40, 90), rng.normal(size=130)) if i % 13 and not 30 < i < 52]
    data.append(("a", 5, 2.0))  # a second sample at one index
    df = spark.createDataFrame(data, "k string, i int, v double")
    kernels = {"odd": [0.5, 1.0, -0.25], "even": [1.0, 2.0, 3.0, -4.0]}
    want = {}
    for k in ("a", None):
        for name, w in kernels.items():
            for at in {i for q, i, _ in data if q == k}:
                hits = [(w[i - at + len(w) // 2], v) for q, i, v in data if q == k and v is not None and 0 <= i - at + len(w) // 2 < len(w)]
                total = sum(x for x, _ in hits) if renormalise else 1.0
                if hits:
                    want[k, at, name] = sum(x * v for x, v in hits) / total if total else None
    out = windows.fir(df, ["k"], "i", "v", kernels, renormalise, chunk=17)
    got = {(r.k, r.i, r.kernel): r.filtered for r in out.collect()}
    assert out.columns == ["k", "i", "kernel", "filtered"] and got.keys() == want.keys() and len(got) == out.count()
    assert all(got[x] is None if want[x] is None else got[x] == pytest.approx(want[x]) for x in want)
    assert windows.fir(df.limit(0), ["k"], "i", "v", kernels).count() == 0


def test_windows_over_spans_of_time_agree_with_brute_force(spark):
    rng = np.random.default_rng(8)
    edge = 30 * 86400
    at = sorted({int(t) for t in [*rng.integers(-2 * edge, 3 * edge, 150), *(k * edge + d for k in (-1, 0, 1, 2) for d in (-600, -599, -1, 0, 1, 600)), *range(edge - 5000, edge + 5000, 400)]})
    data = [("s", t, float(rng.normal())) for t in at]
    df = spark.createDataFrame([*data, ("s", None, 3.0)], "k string, t long, v double")
    steps = windows.step_changes(df, ["k"], "t", "v", "v", 10)
    want = {t: abs(v - data[i - 1][2]) if i and t - data[i - 1][1] <= 600 else None for i, (_, t, v) in enumerate(data)} | {None: None}
    got = steps.collect()
    assert steps.columns == ["k", "t", "v", "change"] and len(got) == len(data) + 1
    assert {r.t: r.change for r in got} == want
    for width in (601, 20 * 86400):
        means = {r.t: r.m for r in windows.rolling_mean(df, ["k"], "t", "v", width, "m").collect()}
        assert len(means) == len(data) + 1 and means[None] == 3.0
        assert all(means[t] == pytest.approx(np.mean([v for _, u, v in data if t - width < u <= t])) for t in at)


def test_covariance_of_blocks_agrees_with_the_self_join(spark):
    rng = np.random.default_rng(2)
    data = [(f"p{p}", t, float(x)) for t in range(40) for p, x in enumerate(rng.normal(size=9) + 1e6) if (t * 7 + p) % 5]
    data += [("p1", 3, 7.0), ("p1", 3, 8.0), ("p2", 4, float("nan")), ("p3", 5, None), ("once", 1, 2.0), ("alone", 99, 1.0)]
    df = spark.createDataFrame(data, "s string, t long, v double")
    x = df.filter("v IS NOT NULL")
    want = x.alias("x").join(x.alias("y"), "t").filter("x.s <= y.s").groupBy(F.col("x.s").alias("a"), F.col("y.s").alias("b"))
    want = {(r.a, r.b): r for r in want.agg(F.count("*").alias("n"), F.covar_samp("x.v", "y.v").alias("cov")).collect()}
    sums = {(r.a, r.b): r for r in aggregate.cross_sums(df, "s", "t", "v", places=3, times=8).collect()}
    assert {k: r.n for k, r in sums.items()} == {k: r.n for k, r in want.items()}
    assert sums["p0", "p5"].sx == pytest.approx(sum(a for s, t, a in data if s == "p0" and any(q == "p5" and u == t for q, u, _ in data)))
    got = {(r.a, r.b): r for r in aggregate.covariance(df, "s", "t", "v").collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].n == r.n and (got[k]["cov"] == pytest.approx(r["cov"], rel=1e-6, abs=1e-6, nan_ok=True) if r["cov"] is not None else got[k]["cov"] is None)
    assert aggregate.covariance(df.limit(0), "s", "t", "v").count() == 0


def test_interpolated_spine_and_merged_intervals(spark):
    df = spark.createDataFrame([("k", 0, 0.0), ("k", 30, 3.0)], "k string, t long, v double")
    assert rows(windows.regular(df, ["k"], "t", 10, "v", interpolate=True), "s", "v") == [(0, 0.0), (10, 1.0), (20, 2.0), (30, 3.0)]
    iv = spark.createDataFrame([("k", 0, 5), ("k", 1, 2), ("k", 5, 8), ("k", 9, 10)], "k string, a long, b long")
    assert rows(windows.merged_intervals(iv, ["k"], "a", "b"), "start", "end") == [(0, 8), (9, 10)]


def test_spline_goes_through_its_knots():
    x, y = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 3.0, 2.0, 2.0])
    assert np.allclose(windows.natural_spline(x, y, x), y)
    assert np.allclose(windows.natural_spline(x, 2 * x + 1, np.array([-1.0, 0.3, 5.0])), [-1.0, 1.6, 11.0])


@pytest.fixture(scope="module")
def plane(spark):
    return spark.createDataFrame([(i, j, -70 + 0.1 * j, -30 + 0.1 * i, 2.0 + 3 * j + 5 * i) for i in range(4) for j in range(4)], "i long, j long, lon double, lat double, v double")


def test_bilinear_is_exact_on_a_plane_and_null_outside(spark, plane):
    st = spark.createDataFrame([("in", -69.85, -29.87), ("out", -69.5, -29.0), ("edge", -70.0, -30.0)], "station string, lon double, lat double")
    want = {"in": 2 + 3 * 1.5 + 5 * 1.3, "edge": 2.0}
    for weights in (grid.bilinear_weights(grid.surrounding_square(st, plane)), grid.affine_weights(st, plane)):
        got = {r.station: r.v for r in grid.interpolate(plane, weights, []).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    gap = plane.withColumn("v", F.when(~((F.col("i") == 1) & (F.col("j") == 1)), F.col("v")))
    assert {r.station: r.v for r in grid.interpolate(gap, grid.affine_weights(st, plane), []).collect()}["in"] is None


def test_nearest_cell_and_quadrilateral(spark, plane):
    st = spark.createDataFrame([("a", -69.96, -29.97)], "station string, lon double, lat double")
    assert rows(grid.nearest_cell(st, plane), "i", "j") == [(0, 0)]
    inside = geo.in_quadrilateral(F.lit(0.5), F.lit(0.5), [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
    assert spark.range(1).select(inside).first()[0] is True


def test_a_point_on_an_edge_is_on_one_side_in_decimals(spark):
    from cirrostrat.plans.select_queries import CORNERS, QUAD_SQL

    st = spark.range(20_000).select("id", (-71 + (F.col("id") * 7 % 100) * 0.02).alias("lon"), (-31 + (F.col("id") * 13 % 97) * 0.02).alias("lat"))
    got = [r.id for r in st.filter(geo.in_quadrilateral(F.col("lon"), F.col("lat"), CORNERS)).orderBy("id").collect()]
    import duckdb

    sql = f"SELECT id FROM (SELECT id, (-71 + (id * 7 % 100) * 0.02)::DOUBLE AS lon, (-31 + (id * 13 % 97) * 0.02)::DOUBLE AS lat FROM (SELECT unnest(range(20000)) AS id)) WHERE {QUAD_SQL} ORDER BY id"
    assert got == [r[0] for r in duckdb.sql(sql).fetchall()]


def test_missing_days_make_no_row_a_day(spark):
    from cirrostrat.operators import aggregate

    day = 86400
    df = spark.createDataFrame([(1, 20 * day + 5), (1, 20 * day + 9), (1, 70 * day), (2, 31 * day), (3, 365 * day), (3, -day)], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts"), F.lit(1.0).alias("v"))
    out = aggregate.missing_days(df, "k", "ts", "v")
    active = aggregate.active_days(df, "k", "ts", "v").groupBy("k", F.date_trunc("month", F.timestamp_seconds("day")).cast("long").alias("month")).agg(F.sum((F.col("n") == 0).cast("long")).alias("missing"))
    assert rows(out, "k", "month", "missing") == rows(active, "k", "month", "missing")
    assert "1 MONTH" in out._jdf.queryExecution().toString() or "INTERVAL '1'" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["u2_interpolators", "j20_interpolate", "j21_affine_interpolate", "j22_nearest_interpolation", "j29_monthly_totals", "j17_cell_of_station", "j25_sea_classes"])
def test_grids_are_not_broadcast(spark, sf, name):
    """Their files are small beside their rows: at 60 times sf0.1, 9.6 million cells went to the driver and to all executors."""
    from cirrostrat import plans

    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin" in line and ("[i#" in line or "_bx#" in line)]
    assert not joins and "SortMergeJoin" in plan


def test_products_of_stations_go_by_places_and_many_tasks(spark):
    """A table of one file and its product were one task, and each pair of stations had a distance of its own."""
    from cirrostrat.operators import eof

    st = spark.createDataFrame([(k, float(k % 3), float(k % 2)) for k in range(40)] + [(40, 2.0, 9.0)], "station long, lon double, lat double").coalesce(1)
    d = grid.distances(st)
    assert d.count() == 41 * 41 and d.rdd.getNumPartitions() > 1
    calls = []
    assert grid.distances(st, measure=lambda m: calls.append(1) or F.round(m, 3)).agg(F.countDistinct("a", "b")).first()[0] == 41 * 41 and calls
    sums = d.groupBy("a").agg(F.sum(F.col("metres") * F.col("metres")).alias("w")).collect()
    mean = sum(r.w for r in sums) / 41
    limit = mean + (sum((r.w - mean) ** 2 for r in sums) / 40) ** 0.5
    want = {r.a: r.w for r in sums if r.w <= limit}
    got = {r.station: r.weight for r in eof.distant_dropped(st).collect()}
    assert got.keys() == want.keys() and 40 not in got and all(abs(got[k] - want[k]) <= 1e-9 * want[k] for k in want)


def test_pairs_of_stations_leave_block_by_block(spark):
    """A broadcast product held all rows of a place until the last was made (over 8 GB at 60 copies of sf0.1), and a station without a number was lost."""
    st = spark.createDataFrame([(k if k else None, 1.0, 2.0) for k in range(150)] + [(k, 3.0, 2.0) for k in range(150, 160)], "station long, lon double, lat double")
    blocks = [sorted(r._k, key=lambda k: k or 0) for r in grid._blocks(st, "station").collect()]
    assert sorted(len(b) for b in blocks) == [10, 50, 50, 50] and sorted(k or 0 for b in blocks for k in b) == list(range(160))
    d = grid.distances(st)
    plan = d._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan
    got = d.selectExpr("coalesce(a, 0) AS a", "coalesce(b, 0) AS b", "metres > 0 AS far").collect()
    assert sorted((r.a, r.b, r.far) for r in got) == [(a, b, (a < 150) != (b < 150)) for a in range(160) for b in range(160)]
    assert grid.distances(st.limit(0)).count() == 0


def test_distances_agree_between_sphere_and_ellipsoid(spark):
    st = spark.createDataFrame([("a", -70.0, -30.0), ("b", -71.0, -31.0)], "station string, lon double, lat double")
    d = {(r.a, r.b): r.metres for r in grid.distances(st).collect()}
    near = {(r.a, r.b) for r in grid.distances(st, within=50_000.0).collect()}
    assert near == {("a", "a"), ("b", "b")} and abs(d["a", "b"] - 146_400) < 500
    e = spark.range(1).select(geo.ellipsoidal_distance(F.lit(-70.0), F.lit(-30.0), F.lit(-71.0), F.lit(-31.0)).alias("m")).first().m
    assert abs(e - d["a", "b"]) < 500


def test_vertical_integral_needs_six_layers(spark):
    up = [(k, i * 1000.0, 0.01) for k, n in (("many", 8), ("few", 5)) for i in range(n)]
    out = vertical.vertical_integral(spark.createDataFrame(up, "k string, p double, w double"), ["k"], "p", "w")
    assert rows(out, "k", "layers") == [("many", 7)] and out.first().total == pytest.approx(70.0)


def test_levels_between_pressures(spark):
    df = spark.createDataFrame([("k", 1000.0, 0.0), ("k", 500.0, 10.0), ("k", 250.0, 20.0)], "k string, p double, t double")
    got = dict(rows(vertical.at_pressures(df, ["k"], "p", "t", (1000, 500, 200)), "level", "t"))
    assert got.keys() == {1000, 500} and got[500] == pytest.approx(10.0)


def test_spectrum_finds_the_sine(spark):
    t = np.arange(256) / 16
    y = np.sin(2 * np.pi * t)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(t, y)], "name string, t double, y double")
    p = {round(r.f, 3): r.power for r in spectral.periodogram(df, ["name"], "t", "y", [0.5, 1.0, 2.0], "pow").collect()}
    assert p[1.0] == pytest.approx(0.5, rel=0.02) and p[0.5] < 0.01 > p[2.0]
    one = spectral.one_cycle(df, ["name"], "t", "y", 1.0).first()
    assert one.amplitude == pytest.approx(1.0, rel=0.01) and one.phase == pytest.approx(0.25, abs=0.01)
    w = {round(r.f, 3): r.power for r in spectral.welch(df, ["name"], "t", "y", [0.5, 1.0, 3.0], 4).collect()}
    assert w[1.0] > 50 * w[3.0]
    both = df.unionByName(df.withColumn("name", F.lit("l")).withColumn("y", F.col("y") * 3))
    assert all(r.coherence == pytest.approx(1.0) for r in spectral.coherence(both, "name", "k", "l", "t", "y", [1.0], 4).collect())


def test_tails_and_quantiles():
    assert stats.incomplete_beta(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248)
    assert stats.chi2_quantile(0.95, 3) == pytest.approx(7.8147, abs=1e-3)


def test_components_and_gap_filling_recover_low_rank(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6)) + 3
    df = spark.createDataFrame([(d, n, float(x[n, d])) for n in range(60) for d in range(6)], "place int, time int, v double")
    weights, shares = eof.loadings(df, "place", "time", "v", 2)
    assert sum(r.explained for r in shares.collect()) == pytest.approx(1.0)
    means = df.groupBy("place").agg(F.avg("v").alias("mean"))
    rebuilt = eof.reconstruction(eof.scores(df, weights, "place", "time", "v"), weights, means, "place", "time")
    assert eof.rms_difference(df, rebuilt, ["place", "time"], "v", "rebuilt").first().rms < 1e-9
    gap = df.withColumn("v", F.when((F.col("time") * 7 + F.col("place")) % 19 != 0, F.col("v")))
    out = eof.fill_gaps(gap, "place", "time", "v", 2, rounds=25).filter("v IS NULL").join(df.withColumnRenamed("v", "true"), ["place", "time"])
    rms = out.agg(F.sqrt(F.avg(F.pow(F.col("filled") - F.col("true"), F.lit(2))))).first()[0]
    assert rms < 0.3 * x.std()


def test_scores_are_sums_by_time_and_no_row_is_sorted(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(d, n, None if (d + n) % 11 == 0 else float(rng.normal() + d)) for n in range(50) for d in range(6)], "place int, time int, v double")
    weights, _ = eof.loadings(df, "place", "time", "v", 3)
    score = eof.scores(df, weights, "place", "time", "v")
    plan = score._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan  # all times of a place met in one task before
    means = df.groupBy("place").agg(F.avg("v").alias("mean"))
    want = {(r.place, r.time): r.rebuilt for r in eof.reconstruction(score, weights, means, "place", "time").collect()}
    got = {(r.place, r.time): r.rebuilt for r in eof.with_reconstruction(df, weights, "place", "time", "v").collect()}
    assert got.keys() == want.keys() and len(got) == 300 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_filled_gaps_of_the_query_settle(spark, sf, caplog):
    caplog.set_level("INFO", "cirrostrat.operators.eof")
    assert plans.queries()["e2_filled_gaps"](spark, sf).count() > 0
    assert [r.message[:12] for r in caplog.records] == ["gaps settled"]


def test_local_and_laplacian_slopes(spark):
    rng = np.random.default_rng(1)
    data = [(p, c, float(x), (3.0 if p == "a" else -5.0) * float(x) + 1 + rng.normal() / 50) for p in "ab" for c in (0, 1) for x in rng.normal(size=20)]
    df = spark.createDataFrame(data, "station string, chunk int, x double, y double")
    dist = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 1e6), ("b", "a", 1e6), ("b", "b", 0.0)], "a string, b string, metres double")
    got = {(r.station, r.chunk): r.slope for r in regress.local_regression(df, dist, "station", ["chunk"], "x", "y", 1e5, regress.gaussian(1e5)).collect()}
    smooth = {(r.station, r.chunk): r.slope for r in regress.laplacian_regression(df, dist, "station", "chunk", "x", "y", 0.1, regress.gaussian(1e5)).collect()}
    for g in (got, smooth):
        assert g["a", 0] == pytest.approx(3, abs=0.1) and g["b", 1] == pytest.approx(-5, abs=0.1)


def test_slopes_by_gradients_equal_those_of_the_driver(spark, caplog):
    caplog.set_level("INFO", "cirrostrat.operators.regress")
    rng = np.random.default_rng(5)
    data = [(p, c, float(v), p * float(v) + c + float(rng.normal())) for p in range(5) for c in range(4) if (p, c) != (2, 1) for v in rng.normal(size=6)]
    df = spark.createDataFrame([*data, (7, 0, 1.0, 2.0), (None, 0, 1.0, 2.0)], "station int, chunk int, x double, y double")  # one place has a single row
    dist = spark.createDataFrame([(a, b, 40_000.0 * abs(a - b)) for a in range(9) for b in range(9)], "a int, b int, metres double")
    there, here = (
        {(r.station, r.chunk): (r.slope, r.icpt) for r in regress.laplacian_regression(df, dist, "station", "chunk", "x", "y", 0.1, regress.gaussian(60_000.0), n).collect()} for n in (2000, 0)
    )
    assert there.keys() == here.keys() == {(p, c) for p, c, *_ in data} | {(7, 0)}
    assert all(here[k] == pytest.approx(there[k], rel=1e-6, abs=1e-8) for k in there)
    assert [r.message[:14] for r in caplog.records] == ["slopes settled"]
    assert regress.laplacian_regression(df.limit(0), dist, "station", "chunk", "x", "y", 0.1, regress.gaussian(60_000.0), -1).count() == 0


@pytest.mark.parametrize("named", [True, False])
def test_components_by_products_equal_those_of_the_driver(spark, named):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 30)) * np.linspace(1, 4, 30)
    m = np.cov(x.T)
    name = lambda i: f"p{i}" if named else i
    cov = spark.createDataFrame([(name(i), name(j), None if (i, j) == (3, 9) else float(m[i, j])) for i in range(30) for j in range(i, 30)], f"a {'string' if named else 'int'}, b {'string' if named else 'int'}, cov double")
    there, here = (eof.eigenvectors(cov, 3, n) for n in (3000, 0))
    assert there[0] == here[0] and there[1] == pytest.approx(here[1], rel=1e-8)
    assert np.abs(there[2] - here[2]).max() < 1e-6


def test_prediction_by_pattern_flags_the_outlier(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=80)
    data = [(p, n, float(base[n] * k + rng.normal() / 100 + (5 if p == "t" and n == 40 else 0))) for n in range(80) for p, k in (("t", 1.0), ("u", 2.0), ("v", -1.0)) if not (p == "v" and n % 2)]
    out = regress.predicted_from_others(spark.createDataFrame(data, "place string, time int, v double"), "t", "place", "time", "v")
    assert [r.time for r in out.filter("flag").collect()] == [40]


def test_version_differences(spark):
    a = spark.createDataFrame([("s", 1, 1.0), ("s", 2, None), ("s", 3, 3.0)], "s string, t int, v double")
    b = spark.createDataFrame([("s", 1, 1.0), ("s", 2, None), ("s", 3, 4.0), ("s", 4, 1.0)], "s string, t int, v double")
    r = compare.table_diff(a, b, "s", ["t"], "t", "v").first()
    assert (r.only_a, r.only_b, r.unequal, r.start, r.end) == (0, 1, 1, 1, 3)
    assert rows(compare.differing_cells(a, b, ["s", "t"], "v"), "t", "a", "b") == [(3, 3.0, 4.0)]


def test_sensor_choice_breaks_ties_by_code(spark):
    df = spark.createDataFrame([("x", "b", 1.0), ("x", "a", 3.0), ("x", "c", 10.0)], "station string, sensor string, elev double")
    assert rows(select.nearest_height(df, ["station"]), "sensor") == [("a",)]
    assert rows(select.preferred(df, ["station"], "elev", [2.0, 10.0, 3.0], "sensor"), "sensor") == [("c",)]


def test_humidity_round_trip(spark):
    t, p = F.lit(290.0), F.lit(95000.0)
    back = physics.relative_humidity(physics.mixing_ratio(F.lit(55.0), t, p), t, p)
    assert spark.range(1).select(back).first()[0] == pytest.approx(55.0)


def test_a_long_record_is_shared_by_all_its_bins(spark):
    # Three hours up to 04:00 and 90 minutes up to 06:15: every bin touched has its seconds.
    df = spark.createDataFrame([("a", 14400, 6.0), ("a", 22500, 3.0)], "s string, t long, v double").withColumn("len", F.when(F.col("t") == 14400, 10800).otherwise(5400))
    got = rows(binning.pieces(df, "t", F.col("len"), 3600), "t", "bin", "weight", "most")
    assert got == [(14400, 3600, 3600, True), (14400, 7200, 3600, True), (14400, 10800, 3600, True), (22500, 14400, 900, False), (22500, 18000, 3600, True), (22500, 21600, 900, False)]
    out = {r.bin: (r.ave, r["min"]) for r in binning.weighted_bins(df, ["s"], "t", F.col("len"), ave="v", low="v", high="v", label="start").collect()}
    assert out == {3600: (6.0, 6.0), 7200: (6.0, 6.0), 10800: (6.0, 6.0), 14400: (3.0, None), 18000: (3.0, 3.0), 21600: (3.0, None)}


def test_distances_across_the_date_line_and_near_poles(spark):
    spots = [(1, 179.99, -20.0), (2, -179.99, -20.0), (3, 0.0, 89.9), (4, 180.0, 89.9), (5, 10.0, -79.0), (6, 12.0, -79.0), (7, 15.0, 0.0)]
    df = spark.createDataFrame(spots, "station long, lon double, lat double")
    near = rows(grid.distances(df, within=50_000).filter("a < b"), "a", "b")
    full = rows(grid.distances(df).filter("a < b AND metres <= 50000"), "a", "b")
    assert near == full == [(1, 2), (3, 4), (5, 6)]
    rng = np.random.default_rng(3)
    many = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))))], "station long, lon double, lat double")
    for within in (200_000, 1_500_000):
        assert rows(grid.distances(many, within=within), "a", "b") == rows(grid.distances(many).filter(f"metres <= {within}"), "a", "b")


def test_nearest_cell_is_found_however_far(spark):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(i, j, -179.0 + 2.5 * j, -60 + 2.5 * i) for i in range(12) for j in range(12)], "i long, j long, lon double, lat double")
    st = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 40), rng.uniform(-89, 89, 40)))], "station long, lon double, lat double")
    far = geo.haversine(F.col("s.lon"), F.col("s.lat"), F.col("c.lon"), F.col("c.lat"))
    want = st.alias("s").join(cells.alias("c"), how="cross").groupBy("s.station").agg(F.min(F.round(far, 3)).alias("metres"))
    assert rows(grid.nearest_cell(st, cells).withColumn("metres", F.round("metres", 3)), "station", "metres") == rows(want, "station", "metres")
    assert grid.nearest_cell(st, cells.filter("false")).count() == 0


def test_horizon_finds_far_terrain_at_any_latitude(spark):
    st = spark.createDataFrame([(1, 10.0, 60.0, 100.0), (2, 179.9, -70.0, 0.0)], "station long, lon double, lat double, elev double")
    land = spark.createDataFrame([(10.0, 60.54, 1000.0), (11.53, 60.0, 1000.0), (-178.0, -70.0, 500.0), (10.0, 62.0, 9000.0)], "lon double, lat double, elev double")
    got = {(r.station, r.sector): (r.angle, r.metres) for r in terrain.horizon(st, land, 100_000, 4).collect()}
    assert {station for station, _ in got} == {1, 2} and all(metres < 100_000 for _, metres in got.values())
    assert max(a for (s, _), (a, _) in got.items() if s == 1) == pytest.approx(np.degrees(np.arctan(900 / 60045)), abs=2e-3)
    sun = spark.createDataFrame([(1, 0.0, 0.001), (1, 0.0, 0.5), (1, 200.0, 0.001)], "station long, azimuth double, mu double")
    assert rows(terrain.blocked(sun, terrain.horizon(st, land, 100_000, 4), 4), "azimuth", "mu", "blocked") == [(0.0, 0.001, True), (0.0, 0.5, False), (200.0, 0.001, False)]


def test_robust_line_and_clusters(spark):
    pts = [("a", float(x), 2.0 * x + 1) for x in range(20)] + [("a", 5.5, 400.0), ("a", 7.5, -300.0)]
    fit = regress.ransac_fit(spark.createDataFrame(pts, "k string, x double, y double"), ["k"], "x", "y").first()
    assert (fit.slope, fit.icpt) == (pytest.approx(2.0), pytest.approx(1.0))
    curves = [(k, h, (np.sin(h) if k < 5 else np.cos(h)) + k) for k in range(10) for h in range(8)]
    got = dict(rows(regress.clustered_curves(spark.createDataFrame([(k, h, float(v)) for k, h, v in curves], "k long, h long, v double"), "k", "h", "v", list(range(8)), 2), "k", "cluster"))
    assert len({got[k] for k in range(5)}) == len({got[k] for k in range(5, 10)}) == 1 and got[0] != got[5]


def test_masks_hold_their_share_and_lengths(spark):
    df = spark.range(40_000).select((F.col("id") % 20).alias("p"), F.expr("id DIV 20").alias("t"))
    one = eof.random_mask(df, ["p", "t"], 0.2)
    assert one.filter("masked").count() == pytest.approx(8000, rel=0.06)
    assert rows(one, "p", "t", "masked") == rows(eof.random_mask(df.repartition(7), ["p", "t"], 0.2), "p", "t", "masked")
    blocks = eof.block_mask(df, "p", "t", 0.1, 30)
    masked = blocks.filter("masked").count()
    assert masked == pytest.approx(4000, rel=0.4)
    runs = {}
    for p, t in rows(blocks.filter("masked"), "p", "t"):
        runs.setdefault(p, []).append(t)
    lengths = [len(x) for ts in runs.values() for x in np.split(np.array(ts), np.flatnonzero(np.diff(ts) > 1) + 1)]
    assert 15 < np.mean(lengths) < 60


def test_turned_components(spark):
    df = spark.createDataFrame([(t, c, float(t * 3 + c)) for t in range(4) for c in range(2)], "t long, component int, score double")
    turn = np.array([[0.0, 1.0], [-1.0, 0.0]])
    assert rows(eof.rotated(df, turn, ["t"], "score"), "t", "component", "score") == [(t, c, float(-(t * 3 + 1) if c == 0 else t * 3)) for t in range(4) for c in range(2)]


def test_season_and_local_parabola_are_taken_out(spark):
    hour = 3600
    line = [("a", h * hour, 5.0) for h in range(0, 24 * 120, 6)]
    flat = windows.deseasonalised(spark.createDataFrame(line, "k string, t long, v double"), ["k"], "t", "v")
    assert max(abs(r.v) for r in flat.collect()) < 1e-9
    curve = spark.createDataFrame([("a", s, (s / 1e4) ** 2 - s / 1e4 + 3) for s in range(0, 100_000, 500)], "k string, t long, v double")
    at = spark.createDataFrame([("a", s) for s in (30_000, 52_000, 71_000)], "k string, s long")
    for _, s, got in rows(windows.local_polynomial(curve, ["k"], "t", "v", at, 3000), "k", "s", "smooth"):
        assert got == pytest.approx((s / 1e4) ** 2 - s / 1e4 + 3, abs=1e-6)


def test_soundings_of_any_length_are_read_whole(spark, tmp_path):
    from cirrostrat.sources import text

    level = "20 -9999  50000   100    50  -9999   -50   180    20"
    head = "#SND00000001 2020 01 02 00 2300 9999"
    (tmp_path / "s.txt").write_text("\n".join([head, *[level] * 100_500, head, level]) + "\n")
    assert text.soundings(spark, str(tmp_path)).count() == 100_501
