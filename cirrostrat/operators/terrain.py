"""Horizons of stations over large terrain: a pyramid of tiles with their highest cells, opened only where they can matter."""

from __future__ import annotations

from math import floor, log2, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions.geo import EARTH_RADIUS, bearing, haversine
from cirrostrat.operators.network import AXES, CELL, cell_reach, unit_point
from cirrostrat.runtime import stash


def _metres(chord: Column) -> Column:
    """Along the sphere, from a distance through it."""
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), chord / 2))


def _sector(degrees: Column, sectors: int) -> Column:
    return F.least(F.lit(sectors - 1), F.floor(degrees / (360 / sectors))).cast("int")


def _shifted(offsets: tuple[int, ...]) -> Column:
    """Each of the steps from a tile to those beside it, or to its children."""
    return F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for a, d in zip(AXES, (i, j, m)))) for i in offsets for j in offsets for m in offsets))).alias("d")


def _placed(cells: DataFrame, level: int) -> DataFrame:
    """Cells with their tile of a level."""
    point = unit_point(F.col("lon"), F.col("lat"))
    tile = {f"c{a}": F.least(F.lit((1 << level) - 1), F.floor((point[a] + 1) / 2 * (1 << level))).cast("long") for a in AXES}
    known = cells.select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("elev").cast("double").alias("elev")).dropna()
    return known.withColumns(tile)


def pyramid(cells: DataFrame, top: int, deep: int) -> tuple[DataFrame, DataFrame]:
    """Tiles (level, cx, cy, cz, n, best) of levels `deep` up to `top`, each from those below it: how many cells, and the highest one (elev, lon, lat); and
    the cells with their deepest tile. Tiles halve from level to level."""
    placed = _placed(cells, deep)
    level = placed.groupBy(*CELL[1:]).agg(F.count("*").alias("n"), F.max(F.struct("elev", "lon", "lat")).alias("best")).withColumn("level", F.lit(deep))
    level = stash(level.select(*CELL, "n", "best"), "tiles")
    tiles = level
    for k in range(deep - 1, top - 1, -1):
        level = level.groupBy(*(F.shiftright(c, 1).alias(c) for c in CELL[1:])).agg(F.sum("n").alias("n"), F.max("best").alias("best")).select(F.lit(k).alias("level"), *CELL[1:], "n", "best")
        tiles = tiles.unionByName(level)
    return stash(tiles, "pyramid"), placed


def _lines_kept(rows: DataFrame, keys: list[str], height: str, metres: str, lines: int = 4) -> DataFrame:
    """(keys, lines): for some heights of an eye from _z to _top, the cell that rises highest before it, as (height, metres)."""
    eyes = [F.col("_z") + (F.col("_top") - F.col("_z")) * (i / (lines - 1)) for i in range(lines)]
    best = [F.max(F.struct(((F.col(height) - eye) / F.col(metres)).alias("slope"), F.col(height).alias("h"), F.col(metres).alias("m"))).alias(f"_{i}") for i, eye in enumerate(eyes)]
    return rows.groupBy(*keys).agg(*best).select(*keys, F.array_distinct(F.array(*(F.struct(f"_{i}.h", f"_{i}.m") for i in range(lines)))).alias("lines"))


def _can_win(height: Column, near: Column, far: Column) -> Column:
    """Whether terrain up to `height`, from `near` to `far` metres away, can rise as high as `lines` for some eye between _z and _top. Slopes of lines are linear in
    the eye's height and that of the terrain is convex, so it is enough to look at both ends and where two lines cross."""
    ends = F.array("_z", "_top")
    cross = F.flatten(F.transform("lines", lambda a: F.transform("lines", lambda b: F.try_divide(a["h"] * b["m"] - b["h"] * a["m"], b["m"] - a["m"]))))
    eyes = F.when(F.col("_z") < F.col("_top"), F.concat(ends, F.filter(cross, lambda e: e.between(F.col("_z"), F.col("_top"))))).otherwise(ends)
    over = lambda e: F.array_max(F.transform("lines", lambda a: (a["h"] - e) / a["m"]))
    steep = F.greatest(F.abs(over(F.col("_z"))), F.abs(over(F.col("_top"))))
    margin = 2e-8 * (1 + steep * steep)  # over 1e-6 degrees
    return F.col("lines").isNull() | F.exists(eyes, lambda e: (height - e) / F.when(height > e, near).otherwise(far) >= over(e) - margin)


def opened_tiles(stations: DataFrame, tiles: DataFrame, within: float, sectors: int, top: int, deep: int, key: str, nearest: float) -> DataFrame:
    """The deepest tiles that each station has to look into: (key, place, cx, cy, cz, n). Level by level, the highest cells of the tiles in question tell how
    high the horizon is at least in their sectors; a tile stays where its top, at its nearest edge, would not be below that. A station may stand for
    several heights, from `elev` to `highest`."""
    place = ["_x", "_y", "_z", "_top", *(f"p{a}" for a in AXES)]
    highest = F.col("highest" if "highest" in stations.columns else "elev")
    spots = stations.select(key, F.col("lon").cast("double").alias("_x"), F.col("lat").cast("double").alias("_y"), F.col("elev").cast("double").alias("_z"), highest.cast("double").alias("_top")).dropna().distinct()
    spots = spots.withColumns({f"p{a}": c for a, c in unit_point(F.col("_x"), F.col("_y")).items()})
    own = {f"c{a}": F.floor((F.col(f"p{a}") + 1) / 2 * (1 << top)).cast("long") for a in AXES}
    frontier = spots.withColumns(own).select("*", _shifted((-1, 0, 1))).select(key, *place, F.lit(top).alias("level"), *(F.expr(f"c{a} + d.d{a}").alias(f"c{a}") for a in AXES))
    frontier, found = frontier.join(tiles, CELL), None
    for level in range(top, deep + 1):
        seen = frontier.withColumns({"near": _metres(cell_reach(False)), "far": _metres(cell_reach(True))}).filter(F.col("near") <= within)
        to = (F.col("_x"), F.col("_y"), F.col("best.lon"), F.col("best.lat"))
        seen = stash(seen.withColumns({"metres": haversine(*to), "towards": bearing(*to)}), "seen")
        here = seen.filter(F.col("metres").between(nearest, within)).select(key, _sector(F.col("towards"), sectors).alias("sector"), "_z", "_top", F.col("best.elev").alias("h"), F.col("metres").alias("m"))
        here = here if found is None else here.unionByName(found.select(key, "sector", "_z", "_top", F.inline("lines")))
        found = stash(_lines_kept(here, [key, "sector", "_z", "_top"], "h", "m"), "found")
        # All cells of a tile are within its diagonal of the highest one; from outside of it, that is so wide an angle.
        reach = 2 * F.asin(F.least(F.lit(1.0), F.lit(3**0.5 / (1 << level))))
        away = F.col("metres") / EARTH_RADIUS
        wide = F.when((away > reach) & (away < pi / 2), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(reach) / F.sin(away))))).otherwise(180.0)
        first, last = (F.floor((F.col("towards") + s * wide) / (360 / sectors)) for s in (-1, 1))
        over = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + sectors)), lambda k: F.pmod(k, F.lit(sectors)).cast("int")))
        asked = seen.select(key, *place, *CELL, "n", F.col("best.elev").alias("h"), F.greatest("near", F.lit(nearest)).alias("near"), F.greatest(F.least("far", F.lit(within)), F.lit(nearest)).alias("far"), F.explode(over).alias("sector"))
        asked = asked.join(found.drop("_z", "_top"), [key, "sector"], "left")
        kept = asked.filter(_can_win(F.col("h"), F.col("near"), F.col("far"))).select(key, *place, *CELL, "n").distinct()
        if level == deep:
            return stash(kept, "opened")
        children = kept.drop("n").select("*", _shifted((0, 1))).select(key, *place, F.lit(level + 1).alias("level"), *(F.expr(f"c{a} * 2 + d.d{a}").alias(f"c{a}") for a in AXES))
        frontier = children.join(tiles, CELL)
    return frontier


def levels_for(cells: DataFrame, within: float, tile: float | None = None) -> tuple[int, int]:
    """The level whose tiles are as wide as a station sees, and the one whose tiles are opened: `tile` metres wide, or wide enough for some four by four cells,
    as they lie on average."""
    top = max(0, floor(log2(2 * EARTH_RADIUS / within)))
    if tile:
        return top, min(20, max(top, floor(log2(2 * EARTH_RADIUS / tile))))
    mean = _placed(cells, top).groupBy(*CELL[1:]).agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0] or 1.0
    return top, min(20, top + floor(log2(mean) / 2))


def horizon(stations: DataFrame, cells: DataFrame, within: float, sectors: int, key: str = "station", nearest: float = 1.0, tile: float | None = None) -> DataFrame:
    """(station, sector, angle, metres): the largest elevation angle of terrain in each azimuth sector, and how far it is. Stations and cells
    without a place or a height don't count."""
    # Of cells at one place (to some micrometres, on any turn of the sphere) only the highest counts, and stations at one place look over the same cells.
    point = unit_point(F.col("lon").cast("double"), F.col("lat").cast("double"))
    spot = [F.round(c * 1e12).alias(f"_{a}") for a, c in point.items()]
    cells = cells.select("lon", "lat", "elev").dropna().groupBy(*spot).agg(F.max(F.struct("elev", "lon", "lat")).alias("c"))
    cells = stash(cells.select("c.lon", "c.lat", "c.elev"), "cells")
    eyes = stations.select(F.col(key), *(F.col(c).cast("double").alias(c) for c in ("lon", "lat", "elev"))).dropna(subset=["lon", "lat", "elev"]).distinct()
    eyes = stash(eyes.withColumn("_spot", F.xxhash64("lon", "lat")), "eyes")
    spots = eyes.groupBy("_spot", "lon", "lat").agg(F.min("elev").alias("elev"), F.max("elev").alias("highest"))
    top, deep = levels_for(cells, within, tile)
    tiles, placed = pyramid(cells, top, deep)
    opened = opened_tiles(spots, tiles, within, sectors, top, deep, "_spot", nearest)
    met = opened.drop("n", "level").join(placed, CELL[1:])
    at = (F.col("_x"), F.col("_y"), F.col("lon"), F.col("lat"))
    met = met.withColumn("metres", haversine(*at)).filter(F.col("metres").between(nearest, within))
    met = stash(met.select("_spot", "_x", "_y", "_z", "_top", _sector(bearing(*at), sectors).alias("sector"), "elev", "metres"), "met")
    # Cells that no station of the place can have as its horizon go, before the others meet all of its stations.
    where = ["_spot", "_x", "_y", "sector"]
    lines = _lines_kept(met, [*where, "_z", "_top"], "elev", "metres").drop("_z", "_top")
    met = met.join(lines, where).filter(_can_win(F.col("elev"), F.col("metres"), F.col("metres"))).select(*where, F.col("elev").alias("h"), "metres")
    met = eyes.select(key, "_spot", F.col("lon").alias("_x"), F.col("lat").alias("_y"), "elev").join(met, ["_spot", "_x", "_y"])
    met = met.withColumn("angle", F.degrees(F.atan((F.col("h") - F.col("elev")) / F.col("metres"))))
    return met.groupBy(key, "sector").agg(F.max("angle").alias("angle"), F.min_by("metres", F.struct(-F.round("angle", 6), F.round("metres", 3))).alias("metres"))


def blocked(sun: DataFrame, horizons: DataFrame, sectors: int, key: str = "station") -> DataFrame:
    """`blocked` where the horizon at the sun's azimuth is above it; `mu` is the sine of the sun's height, `azimuth` in degrees."""
    at = sun.withColumn("sector", _sector(F.pmod(F.col("azimuth"), F.lit(360.0)), sectors))
    return at.join(horizons.select(key, "sector", "angle"), [key, "sector"], "left").withColumn("blocked", F.coalesce(F.sin(F.radians("angle")) > F.col("mu"), F.lit(False))).drop("angle")
