"""Horizons by a pyramid of tiles against all cells, and how few of them are opened."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.functions.geo import EARTH_RADIUS
from cirrostrat.operators import terrain


def brute(stations, cells, within, sectors):
    lon, lat, elev = (np.array(c, float) for c in zip(*cells))
    out = {}
    for s, x, y, z in stations:
        a = np.sin(np.radians(lat - y) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(y)) * np.sin(np.radians(lon - x) / 2) ** 2
        metres = 2 * EARTH_RADIUS * np.arcsin(np.minimum(1, np.sqrt(a)))
        d = np.radians(lon - x)
        way = np.degrees(np.arctan2(np.sin(d) * np.cos(np.radians(lat)), np.cos(np.radians(y)) * np.sin(np.radians(lat)) - np.sin(np.radians(y)) * np.cos(np.radians(lat)) * np.cos(d))) % 360
        sector = np.minimum(sectors - 1, way // (360 / sectors)).astype(int)
        angle = np.degrees(np.arctan((elev - z) / np.maximum(metres, 1e-9)))
        for k in range(sectors):
            some = (sector == k) & (metres >= 1) & (metres <= within)
            if some.any():
                out[s, k] = angle[some].max()
    return out


@pytest.mark.parametrize(("tile", "where"), [(None, (-70.0, -30.0)), (3000.0, (179.9, 65.0)), (20_000.0, (10.0, 89.7))])
def test_horizon_by_brute_force(spark, tile, where):
    draw = np.random.default_rng(12)
    x0, y0 = where
    wide = 0.5 / max(0.05, np.cos(np.radians(y0)))
    cells = [((x0 + draw.uniform(-wide, wide) + 180) % 360 - 180, min(89.99, y0 + draw.uniform(-0.5, 0.5)), float(draw.gamma(2, 400))) for _ in range(4000)]
    stations = [(i, (x0 + draw.uniform(-wide / 2, wide / 2) + 180) % 360 - 180, min(89.99, y0 + draw.uniform(-0.25, 0.25)), float(z)) for i, z in enumerate((0, 500, 1500, 6000, 100))]
    st = spark.createDataFrame([*stations, (9, None, 1.0, 1.0)], "station long, lon double, lat double, elev double")
    df = spark.createDataFrame([*cells, (x0, y0, None)], "lon double, lat double, elev double")
    got = {(r.station, r.sector): r.angle for r in terrain.horizon(st, df, 40_000.0, 24, tile=tile).collect()}
    want = brute(stations, cells, 40_000.0, 24)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_stations_at_one_place_open_tiles_once(spark, monkeypatch):
    """Many heights over one place, some cells of which lie on each other: every horizon is right, and the place is looked up once."""
    draw = np.random.default_rng(4)
    cells = [(-70 + draw.uniform(-0.4, 0.4), -30 + draw.uniform(-0.4, 0.4), float(draw.gamma(2, 400))) for _ in range(1500)]
    cells += [(x, y, z - 50) for x, y, z in cells[:300]] + [(x, y + 360, z + 50) for x, y, z in cells[300:600]]
    stations = [(i, -70.0, -30.0, float(z)) for i, z in enumerate((-500, 0, 300, 700, 1100, 1500, 2500, 9000))]
    asked, opened = [], terrain.opened_tiles
    monkeypatch.setattr(terrain, "opened_tiles", lambda st, *rest: asked.append(st.count()) or opened(st, *rest))
    st = spark.createDataFrame(stations, "station long, lon double, lat double, elev double")
    df = spark.createDataFrame(cells, "lon double, lat double, elev double")
    got = {(r.station, r.sector): r.angle for r in terrain.horizon(st, df, 40_000.0, 24).collect()}
    want = brute(stations, cells, 40_000.0, 24)
    assert asked == [1]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_few_tiles_of_large_terrain_are_opened(spark):
    """A million cells of hills and ridges: under one in twenty pairs of a station and a cell in its reach are looked at."""
    i, j = F.expr("id DIV 1000"), F.expr("id % 1000")
    lon, lat = -71 + j * 0.002, -31 + i * 0.002
    hills = 800 + 700 * F.sin(i / 90.0) * F.cos(j / 70.0) + 60 * F.sin(i / 5.0 + j / 7.0) + (F.xxhash64("id") % 1000) / 100.0
    cells = spark.range(1_000_000).select(lon.alias("lon"), lat.alias("lat"), hills.alias("elev"))
    st = spark.createDataFrame([(k, -70.5 + 0.13 * k, -30.4 + 0.11 * k, 700.0 + 250 * k) for k in range(6)], "station long, lon double, lat double, elev double")
    top, deep = terrain.levels_for(cells, 100_000.0)
    tiles, placed = terrain.pyramid(cells, top, deep)
    opened = terrain.opened_tiles(st, tiles, 100_000.0, 36, top, deep, "station", 1.0).agg(F.sum("n")).first()[0]
    a = F.pow(F.sin(F.radians(F.col("lat") - F.col("y")) / 2), F.lit(2)) + F.cos(F.radians("lat")) * F.cos(F.radians("y")) * F.pow(F.sin(F.radians(F.col("lon") - F.col("x")) / 2), F.lit(2))
    near = cells.join(F.broadcast(st.select(F.col("lon").alias("x"), F.col("lat").alias("y")))).filter(2 * EARTH_RADIUS * F.asin(F.sqrt(a)) <= 100_000).count()
    assert 0 < opened < 0.05 * near
