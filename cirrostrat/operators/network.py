"""Station networks as sparse graphs: nearest neighbours by a quadtree of the sphere, and bitmaps of what was read when.

Places are points of the unit sphere. Halving the cube around it level by level gives cells of which each one on the sphere has about four children there:
a quadtree that knows no poles and no date line. Cells are named by level and whole numbers, so cells and places meet by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.functions.geo import haversine
from cirrostrat.functions.times import seconds
from cirrostrat.operators import scan
from cirrostrat.runtime import stash

#: Cells of the deepest level are 12 m wide.
DEEPEST = 20
AXES = ("x", "y", "z")
CELL = ["level", "cx", "cy", "cz"]


def unit_point(lon: Column, lat: Column) -> dict[str, Column]:
    """The point of the unit sphere at a longitude and a latitude."""
    x, y = F.radians(lon), F.radians(lat)
    return {"x": F.cos(y) * F.cos(x), "y": F.cos(y) * F.sin(x), "z": F.sin(y)}


def _sites(places: DataFrame, most: int, key: str) -> DataFrame:
    """Each distinct location with its smallest keys, as many as a result can hold, its point on the sphere and its deepest cell."""
    known = places.filter(F.col(key).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(F.col(key).alias("key"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    first = known.distinct().withColumn("n", F.row_number().over(Window.partitionBy("lon", "lat").orderBy("key"))).filter(F.col("n") <= most)
    sites = first.groupBy("lon", "lat").agg(F.sort_array(F.collect_list("key")).alias("keys")).withColumn("site", F.col("keys")[0])
    point = unit_point(F.col("lon"), F.col("lat"))
    cell = {f"c{a}": F.least(F.lit((1 << DEEPEST) - 1), F.floor((F.col(a) + 1) / 2 * (1 << DEEPEST))).cast("long") for a in AXES}
    return stash(sites.withColumns(point).withColumns(cell), "sites")


def _at_levels(sites: DataFrame, *columns: str) -> DataFrame:
    """Sites in their cells of all levels."""
    levels = sites.select(*columns, *CELL[1:], F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("level"))
    return levels.withColumns({c: F.expr(f"shiftright({c}, {DEEPEST} - level)") for c in CELL[1:]})


def cell_reach(far: bool) -> Column:
    """The distance through the sphere from a place (px, py, pz) to the nearest or the farthest point of a cell."""
    total = F.lit(0.0)
    for a in AXES:
        low, high, p = F.expr(f"c{a} * pow(2.0D, 1 - level) - 1"), F.expr(f"(c{a} + 1) * pow(2.0D, 1 - level) - 1"), F.col(f"p{a}")
        gap = F.greatest(F.abs(p - low), F.abs(p - high)) if far else F.greatest(low - p, p - high, F.lit(0.0))
        total = total + gap * gap
    return F.sqrt(total)


def _pruned(frontier: DataFrame, wanted: int) -> DataFrame:
    """Cells that can hold one of the `wanted` nearest: those that begin before the cells that surely hold so many end."""
    w = Window.partitionBy("site").orderBy("far", *CELL).rowsBetween(Window.unboundedPreceding, 0)
    held = frontier.withColumns({"near": cell_reach(False), "far": cell_reach(True)}).withColumn("held", F.sum("n").over(w))
    bound = F.min(F.when(F.col("held") >= wanted, F.col("far"))).over(Window.partitionBy("site"))
    return held.withColumn("bound", F.least("bound", bound)).filter(F.col("near") <= F.col("bound") + 1e-12).drop("near", "far", "held")


def nearest_graph(places: DataFrame, k: int, key: str = "station", leaf: int = 64) -> DataFrame:
    """(a, b, metres): each place with itself and its k nearest others, the smaller key first on a tie; with all, if there are fewer.
    Places without key or location have no row.

    A place begins with the smallest of its cells that holds k + 1 sites, and looks into the cells of twice that size around it. Cells of more than `leaf`
    sites are cut into their children, of which only those stay that are near enough; then places meet the sites of the cells left."""
    wanted = k + 1
    sites = _sites(places, wanted, key)
    nodes = stash(_at_levels(sites).groupBy(*CELL).agg(F.count("*").alias("n")), "cells")
    own = _at_levels(sites, "site").join(nodes.filter(F.col("n") >= wanted), CELL).groupBy("site").agg(F.max("level").alias("own"))
    start = F.greatest(F.coalesce("own", F.lit(0)) - 1, F.lit(0))
    around = sites.join(own, "site", "left").select("site", *(F.col(a).alias(f"p{a}") for a in AXES), *CELL[1:], start.alias("level"), F.when(F.col("own").isNull(), 4.0).otherwise(F.sqrt(F.lit(3.0)) * F.expr("pow(2.0D, 1 - own)")).alias("bound"))
    shifts = F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for a, d in zip(AXES, (i, j, m)))) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)))).alias("d")
    around = around.select("*", shifts).select("site", "px", "py", "pz", "level", "bound", *(F.expr(f"shiftright(c{a}, {DEEPEST} - level) + d.d{a}").alias(f"c{a}") for a in AXES))
    frontier = stash(_pruned(around.join(nodes, CELL), wanted), "frontier")
    while True:
        large = (F.col("n") > leaf) & (F.col("level") < DEEPEST)
        if frontier.filter(large).isEmpty():
            break
        halves = F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for a, d in zip(AXES, (i, j, m)))) for i in (0, 1) for j in (0, 1) for m in (0, 1)))).alias("d")
        children = frontier.filter(large).drop("n").select("*", halves).select("site", "px", "py", "pz", "bound", (F.col("level") + 1).alias("level"), *(F.expr(f"c{a} * 2 + d.d{a}").alias(f"c{a}") for a in AXES))
        frontier = stash(_pruned(children.join(nodes, CELL).unionByName(frontier.filter(~large)), wanted), "frontier")
    leaves = _at_levels(sites, "site", "lon", "lat", "keys").join(frontier.select(*CELL).distinct(), CELL, "left_semi")
    met = frontier.select("site", *CELL).join(leaves.withColumnRenamed("site", "other"), CELL)
    met = met.join(sites.select("site", F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.col("keys").alias("own")), "site")
    met = met.withColumn("metres", haversine(F.col("x0"), F.col("y0"), F.col("lon"), F.col("lat")))
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("metres", "other"))).filter(F.col("place") <= wanted)
    # All keys of one location have the same neighbours; the table holds them once more.
    named = places.select(F.col(key).alias("a"), F.col("lon").cast("double").alias("x0"), F.col("lat").cast("double").alias("y0")).dropna().distinct()
    pairs = named.join(best.select("x0", "y0", "metres", F.explode("keys").alias("b")), ["x0", "y0"])
    order = Window.partitionBy("a").orderBy((F.col("a") != F.col("b")).cast("int"), "metres", "b")
    pairs = pairs.select("a", "b", "metres").unionByName(named.select("a", F.col("a").alias("b"), F.lit(0.0).alias("metres"))).groupBy("a", "b").agg(F.min("metres").alias("metres"))
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= wanted).drop("place")


def bitmaps(df: DataFrame, keys: Sequence[str], number: Column) -> DataFrame:
    """(keys, bucket, bits): the set of numbers that each key has, 32,768 to a bucket of 4 KB. Sets are made before the shuffle, task by task."""
    rows = df.select(*keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_p")).filter("_p IS NOT NULL")
    return rows.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_p").alias("bits"))


def overlaps(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """The pairs (a, b) with `n`, how many numbers both have: their bitmaps of a bucket are joined and counted, not their rows."""
    mine, theirs = (sets.select(F.col(key).alias(side), "bucket", F.col("bits").alias(f"_{side}")) for side in "ab")
    met = pairs.select("a", "b").join(mine, "a").join(theirs, ["b", "bucket"]).select("a", "b", "bucket", F.explode(F.array("_a", "_b")).alias("_x"))
    both = met.groupBy("a", "b", "bucket").agg(F.bitmap_and_agg("_x").alias("_x")).groupBy("a", "b").agg(F.sum(F.bitmap_count("_x")).alias("n"))
    return pairs.join(both, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def nearest_overlapping(obs: DataFrame, places: DataFrame, k: int, overlap: int, key: str = "station", ts: str = "h", step: int = 3600) -> DataFrame:
    """(a, b, metres, place): per place the k nearest, itself included, that have `overlap` times in common with it. Times are whole numbers of `step` seconds.
    Places that don't find k among their nearest look among twice as many, until they do or have met all."""
    sets = stash(bitmaps(obs, [key], seconds(ts) / step), "bitmaps")
    read = stash(places.join(sets.select(key).distinct(), key, "left_semi"), "read")
    total, near, done = read.count(), 2 * k, None
    left = read
    while True:
        graph = nearest_graph(read, min(near, total), key).join(left.select(F.col(key).alias("a")).distinct(), "a", "left_semi")
        enough = overlaps(graph, sets, key).filter(F.col("n") >= overlap).drop("n")
        ranked = enough.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("metres", "b"))).filter(F.col("place") <= k)
        found = stash(ranked, "nearest")
        if near >= total:
            return found if done is None else done.unionByName(found)
        full = found.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("a")
        done = found.join(full, "a", "left_semi") if done is None else done.unionByName(found.join(full, "a", "left_semi"))
        left = stash(left.join(full, left[key] == F.col("a"), "left_anti"), "left")
        if left.isEmpty():
            return done
        near *= 2


def numbered_places(df: DataFrame, place: str) -> DataFrame:
    """(place, number): the distinct places from 0 on, in order."""
    few = scan.ranges(df.select(place).filter(F.col(place).isNotNull()).distinct(), F.col(place))
    return stash(scan.running(few, [], [place], "number", F.lit(1).cast("long")).select(place, (F.col("number") - 1).alias("number")), "places")


def present(df: DataFrame, numbers: DataFrame, place: str, time: str) -> DataFrame:
    """(time, pattern): the set of places with a row, one bit each by their number, as bytes. Equal sets are equal values."""
    top = numbers.agg(F.max("number")).first()[0]
    buckets, size = (top or 0) // 32768 + 1, ((top or 0) % 32768) // 8 + 1
    sets = bitmaps(df.join(numbers, place), [time], F.col("number") + 1).withColumn("bits", F.when(F.col("bucket") == buckets, F.substring("bits", 1, size)).otherwise(F.col("bits")))
    if buckets == 1:
        return sets.select(time, F.col("bits").alias("pattern"))
    none = F.lit(bytearray(4096))
    held = sets.groupBy(time).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("_m"))
    parts = [F.coalesce(F.col("_m")[F.lit(i + 1).cast("long")], none if i + 1 < buckets else F.substring(none, 1, size)) for i in range(buckets)]
    return held.select(time, F.concat(*parts).alias("pattern"))


def pattern_places(patterns: DataFrame, numbers: DataFrame, place: str) -> DataFrame:
    """(pattern, place) for each bit that is set, of the distinct patterns."""
    byte = lambda c, i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("int")
    each = patterns.select("pattern").distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.octet_length("pattern") - 1)))
    each = each.withColumn("_v", byte("pattern", F.col("_i") + 1)).filter("_v > 0").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(7))))
    each = each.filter(F.expr("(shiftright(_v, _b) & 1) = 1")).select("pattern", (F.col("_i") * 8 + F.col("_b")).cast("long").alias("number"))
    return each.join(numbers, "number").select("pattern", place)
