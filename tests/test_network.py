"""Neighbour graphs and bitmaps against brute force: clusters, poles, the date line, shared locations, many places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.functions.geo import EARTH_RADIUS
from cirrostrat.operators import network, regress


def brute(rows, k):
    lon, lat = np.radians([[r[1], r[2]] for r in rows]).T
    ids = np.array([r[0] for r in rows])
    out = {}
    for i in range(len(rows)):
        a = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat) * np.cos(lat[i]) * np.sin((lon - lon[i]) / 2) ** 2
        metres = 2 * EARTH_RADIUS * np.arcsin(np.minimum(1, np.sqrt(a)))
        order = [j for j in np.lexsort((ids, np.round(metres, 6))) if j != i][:k]
        out[ids[i]] = [round(float(metres[j]), 3) for j in order]
    return out


def graph(df, k, **more):
    got = {}
    for r in network.nearest_graph(df, k, **more).collect():
        got.setdefault(r.a, []).append((round(r.metres, 3), r.b))
    for a, x in got.items():
        assert (0.0, a) in x and len({b for _, b in x}) == len(x)
    return {a: sorted(m for m, b in x if b != a) for a, x in got.items()}


@pytest.fixture(scope="module")
def places():
    draw = np.random.default_rng(6)
    spread = np.column_stack((draw.uniform(-180, 180, 900), np.degrees(np.arcsin(draw.uniform(-1, 1, 900)))))
    city = np.column_stack((-70.6 + draw.normal(0, 0.01, 700), -33.4 + draw.normal(0, 0.01, 700)))
    poles = np.column_stack((draw.uniform(-180, 180, 150), np.where(np.arange(150) % 2, 1, -1) * draw.uniform(89.9, 90, 150)))
    line = np.column_stack((np.where(np.arange(150) % 2, 1, -1) * draw.uniform(179.99, 180, 150), draw.uniform(-0.01, 0.01, 150)))
    near_city = np.array([[-70.6 + 0.2 * i, -33.0] for i in range(20)])
    same = np.repeat([[10.0, 10.0]], 80, axis=0)
    points = np.concatenate((spread, city, poles, line, near_city, same))
    return [(int(i), float(x), float(y)) for i, (x, y) in zip(draw.permutation(len(points)), points)]


@pytest.mark.parametrize(("k", "leaf"), [(5, 64), (12, 16)])
def test_nearest_graph_by_brute_force(spark, places, k, leaf):
    df = spark.createDataFrame(places, "station long, lon double, lat double")
    want, got = brute(places, k), graph(df, k, leaf=leaf)
    assert len(places) == 2000 and got.keys() == want.keys()
    for a, metres in want.items():
        assert np.allclose(got[a], metres, atol=0.02, rtol=1e-6), a


def test_small_networks(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 180.0, 0.0), (4, None, 0.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "station long, lon double, lat double")
    assert {a: len(x) for a, x in graph(df, 5).items()} == {1: 2, 2: 2, 3: 2}
    assert network.nearest_graph(df.filter("false"), 3).count() == 0
    assert {a: len(x) for a, x in graph(df.filter("station = 1"), 3).items()} == {1: 0}


def test_no_cross_join_of_stations(spark, places):
    df = spark.createDataFrame(places, "station long, lon double, lat double")
    plan = network.nearest_graph(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_overlaps_and_growing_search(spark):
    """The nearest places share no times, so that the search grows; counts equal those of a self-join."""
    draw = np.random.default_rng(2)
    east = [0.01 * i + 1e-5 * i * i for i in range(40)]  # no two distances are equal
    stations = [(i, x, 0.0) for i, x in enumerate(east)]
    obs = [(i, 3600 * int(h)) for i in range(40) for h in draw.choice(90_000, 60, replace=False) * 2 + i % 5 % 2] + [(i, 3600 * h) for i in range(0, 40, 9) for h in range(400_000, 400_050)]
    df, where = spark.createDataFrame(obs, "station long, h long").repartition(6), spark.createDataFrame(stations, "station long, lon double, lat double")
    sets = network.bitmaps(df, ["station"], F.col("h") / 3600)
    pairs = spark.range(40).select(F.col("id").alias("a")).join(spark.range(40).select(F.col("id").alias("b")))
    times = {}
    for s, h in obs:
        times.setdefault(s, set()).add(h)
    assert {(r.a, r.b): r.n for r in network.overlaps(pairs, sets, "station").collect()} == {(a, b): len(times[a] & times[b]) for a in range(40) for b in range(40)}
    got = {}
    for r in network.nearest_overlapping(df, where, 3, 50).collect():
        got.setdefault(r.a, []).append((r.place, r.b))
    for a in range(40):
        near = sorted((abs(east[a] - east[b]), b) for b in range(40) if len(times[a] & times[b]) >= 50)
        assert [b for _, b in sorted(got[a])] == [b for _, b in near[:3]]


def test_patterns_of_many_places(spark):
    """More places than one bitmap holds; sets come back as names."""
    n = 40_000
    rows = spark.range(n).select(F.format_string("s%06d", "id").alias("p"), F.explode(F.array(*map(F.lit, range(4)))).alias("t")).filter("t = 0 OR t IN (1, 2) AND substr(p, 7, 1) IN ('3', '7') OR t = 3 AND p = 's039999'")
    rows = rows.withColumn("v", F.lit(1.0))
    patterns, numbers = regress.availability(rows, "p", "t", "v")
    found = {r.t: bytes(r.pattern) for r in patterns.collect()}
    assert {len(x) for x in found.values()} == {n // 8} and found[1] == found[2] and len(set(found.values())) == 3
    back = network.pattern_places(patterns.filter("t = 1"), numbers, "p")
    assert back.count() == n // 5 and back.filter("substr(p, 7, 1) NOT IN ('3', '7')").isEmpty()
    assert regress.pattern_blocks(rows.limit(0), "p", "t", "v").count() == 0
