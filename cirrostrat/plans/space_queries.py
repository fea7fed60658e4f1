"""Queries over grids, profiles, spectra, components and spatial regression."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions import geo
from cirrostrat.operators import eof, grid, network, regress, spectral, terrain, vertical
from cirrostrat.operators.join import complete_pairs
from cirrostrat.plans.registry import Tables, query, rounded
from cirrostrat.plans.select_queries import HAVERSINE_SQL

FAR = HAVERSINE_SQL.replace("{a}", "s.").replace("{b}", "c.")
CELLS = "cells AS (SELECT DISTINCT i, j, lon, lat FROM grid), near AS (SELECT station, elev, s.lon, s.lat FROM stations s)"
DIST = f"dist AS (SELECT s.station AS a, c.station AS b, {FAR} AS metres FROM stations s, stations c)"
SMALL_DIST = f"few AS (SELECT * FROM stations WHERE station < 10), dist AS (SELECT s.station AS a, c.station AS b, {FAR} AS metres FROM few s, few c)"


def cells(t: Tables) -> DataFrame:
    return t.grid.select("i", "j", "lon", "lat").distinct()


def few(t: Tables) -> DataFrame:
    """The stations of the readings, which are numbered 0 to 9."""
    return t.stations.join(t.obs.select("station").distinct(), "station", "left_semi")


@query("j15_nearest_cell", f"{CELLS}, d AS (SELECT station, i, j, {FAR} AS metres FROM near s, cells c WHERE abs(s.lon - c.lon) < 1 AND abs(s.lat - c.lat) < 1) SELECT station, i, j, metres FROM d WHERE metres < 30000 QUALIFY row_number() OVER (PARTITION BY station ORDER BY round(metres, 6), i, j) = 1", "metres")
def _(t: Tables) -> DataFrame:
    return grid.nearest_cell(t.stations, cells(t), 30000)


@query("j16_nearest_axes", "SELECT station, floor((lat + 32) / 0.05::DOUBLE + 0.5)::BIGINT AS i, floor((lon + 72) / 0.05::DOUBLE + 0.5)::BIGINT AS j FROM stations")
def _(t: Tables) -> DataFrame:
    return grid.nearest_axes(t.stations, -72.0, -32.0, 0.05, 0.05)


INSIDE = "x.lon BETWEEN -72 + x.j * 0.05 - 1e-9 AND 0"
SQUARE = "sq AS (SELECT a.i, a.j, a.lon AS x00, a.lat AS y00 FROM cells a JOIN cells b ON b.i = a.i + 1 AND b.j = a.j JOIN cells c ON c.i = a.i AND c.j = a.j + 1 JOIN cells d ON d.i = a.i + 1 AND d.j = a.j + 1)"
#: Stations a little off the grid lines, so that none lies on an edge.
OFF = "off AS (SELECT station, lon + 0.0131 AS lon, lat + 0.0177 AS lat FROM near)"


def off(t: Tables) -> DataFrame:
    return t.stations.select("station", (F.col("lon") + 0.0131).alias("lon"), (F.col("lat") + 0.0177).alias("lat"))


@query("j17_cell_of_station", f"{CELLS}, {SQUARE}, {OFF} SELECT station, i, j FROM off JOIN sq ON lon BETWEEN x00 AND x00 + 0.05 AND lat BETWEEN y00 AND y00 + 0.05")
def _(t: Tables) -> DataFrame:
    return grid.cell_of_station(off(t), cells(t))


WEIGHTS = f"{CELLS}, {SQUARE}, {OFF}, uv AS (SELECT station, i, j, (lon - x00) / 0.05 AS u, (lat - y00) / 0.05 AS v FROM off JOIN sq ON lon BETWEEN x00 AND x00 + 0.05 AND lat BETWEEN y00 AND y00 + 0.05), wt AS (SELECT station, i, j, (1 - u) * (1 - v) AS w FROM uv UNION ALL SELECT station, i, j + 1, u * (1 - v) FROM uv UNION ALL SELECT station, i + 1, j, (1 - u) * v FROM uv UNION ALL SELECT station, i + 1, j + 1, u * v FROM uv)"


@query("j18_j19_bilinear_weights", f"{WEIGHTS} SELECT * FROM wt", "w")
def _(t: Tables) -> DataFrame:
    return grid.bilinear_weights(grid.surrounding_square(off(t), cells(t)))


@query("j20_interpolate", f"{WEIGHTS} SELECT station, d, sum(w * v) AS v FROM grid JOIN wt USING (i, j) GROUP BY station, d", "v")
def _(t: Tables) -> DataFrame:
    return grid.interpolate(t.grid, grid.bilinear_weights(grid.surrounding_square(off(t), cells(t))), ["d"])


@query("j21_affine_interpolate", f"{WEIGHTS} SELECT station, d, sum(w * v) AS v FROM grid JOIN wt USING (i, j) GROUP BY station, d", "v")
def _(t: Tables) -> DataFrame:
    return grid.interpolate(t.grid, grid.affine_weights(off(t), cells(t)), ["d"])


@query("j22_nearest_interpolation", f"{CELLS}, d AS (SELECT station, i, j, {FAR} AS metres FROM near s, cells c WHERE abs(s.lon - c.lon) < 1 AND abs(s.lat - c.lat) < 1), n AS (SELECT station, i, j FROM d WHERE metres < 30000 QUALIFY row_number() OVER (PARTITION BY station ORDER BY round(metres, 6), i, j) = 1) SELECT station, d, v FROM grid JOIN n USING (i, j)", "v")
def _(t: Tables) -> DataFrame:
    return grid.unsent(t.grid).join(grid.nearest_cell(t.stations, cells(t), 30000), ["i", "j"]).select("station", "d", "v")


@query("j29_monthly_totals", f"{CELLS}, d AS (SELECT station, i, j, {FAR} AS metres FROM near s, cells c WHERE abs(s.lon - c.lon) < 1 AND abs(s.lat - c.lat) < 1), n AS (SELECT station, i, j FROM d WHERE metres < 30000 QUALIFY row_number() OVER (PARTITION BY station ORDER BY round(metres, 6), i, j) = 1), a AS (SELECT station, h // 86400 - 19723 AS d, sum(v) / 10 AS x FROM seen GROUP BY ALL), m AS (SELECT station, DATE '2024-01-01' + d::INT AS day, x, v * 1000 AS y FROM a JOIN n USING (station) JOIN grid USING (i, j, d)) SELECT station, (year(day) * 12 + month(day))::BIGINT AS month, sum(x) AS x, sum(y) AS y FROM m GROUP BY ALL", "x y")
def _(t: Tables) -> DataFrame:
    """Monthly station totals beside those of the nearest cell, on the days that both have."""
    at = grid.nearest_cell(t.stations, cells(t), 30000).select("station", "i", "j")
    stations = t.seen.groupBy("station", F.expr("h DIV 86400 - 19723").alias("d")).agg((F.sum("v") / 10).alias("x"))
    model = grid.unsent(t.grid).join(at, ["i", "j"]).select("station", "d", (F.col("v") * 1000).alias("y"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int"))
    month = (F.year(day) * 12 + F.month(day)).cast("long").alias("month")
    return complete_pairs(stations, model, ["station", "d"]).groupBy("station", month).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


@query("j23_distances", f"{DIST} SELECT a, b, metres FROM dist", "metres", own=True)
def _(t: Tables) -> DataFrame:
    return grid.distances(t.stations, measure=rounded)


@query("j23_ellipsoidal", rounds="metres")
def _(t: Tables) -> DataFrame:
    return t.stations.select("station", geo.ellipsoidal_distance(F.col("lon"), F.col("lat"), F.lit(-70.0), F.lit(-30.0)).alias("metres"))


@query("j24_nearest_stations", f"{SMALL_DIST}, o AS (SELECT a.station AS a, b.station AS b, count(*) AS n FROM seen a JOIN seen b USING (h) GROUP BY ALL HAVING count(*) >= 40) SELECT o.a, o.b, metres, (row_number() OVER (PARTITION BY o.a ORDER BY metres, o.b))::INT AS place FROM o JOIN dist d ON d.a = o.a AND d.b = o.b QUALIFY place <= 4", "metres")
def _(t: Tables) -> DataFrame:
    return network.nearest_overlapping(t.seen, few(t), 4, 40)


@query("j25_sea_classes", f"{CELLS}, w AS (SELECT * FROM cells WHERE (i * 3 + j) % 5 = 0) SELECT station, coalesce(bool_or({FAR} <= 5000), FALSE) AS coast FROM near s LEFT JOIN w c ON abs(s.lon - c.lon) < 0.2 AND abs(s.lat - c.lat) < 0.2 GROUP BY station")
def _(t: Tables) -> DataFrame:
    return grid.sea_classes(t.stations, cells(t), sea=(F.col("i") * 3 + F.col("j")) % 5 == 0)


#: Profiles: one a station and field, levels being the ranks of its hours in the first days.
LEVELS = "lev AS (SELECT station, field, k, p, z, v FROM (SELECT station, field, v, (row_number() OVER (PARTITION BY station, field ORDER BY h))::INT AS k, 20000 + 800.0::DOUBLE * row_number() OVER (PARTITION BY station, field ORDER BY h) AS p, 150.0::DOUBLE * row_number() OVER (PARTITION BY station, field ORDER BY h) AS z FROM hourly))"


def levels(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("station", "field").orderBy("h"))
    return t.hourly.withColumn("k", k).select("station", "field", "k", (20000 + 800.0 * F.col("k")).alias("p"), (150.0 * F.col("k")).alias("z"), "v")


@query("j26_v5_at_heights", f"{LEVELS}, s AS (SELECT station, field, z AS z0, v AS v0, lead(z) OVER w AS z1, lead(v) OVER w AS v1 FROM lev WINDOW w AS (PARTITION BY station, field ORDER BY z)) SELECT station, field, x.h::DOUBLE AS height, v0 + (v1 - v0) * (x.h - z0) / (z1 - z0) AS v FROM s, (VALUES (200), (1000), (2350)) AS x(h) WHERE x.h >= z0 AND x.h < z1", "height v")
def _(t: Tables) -> DataFrame:
    return vertical.at_heights(levels(t), ["station", "field"], "z", "v", [200, 1000, 2350])


@query("v1_vertical_integral", f"{LEVELS}, s AS (SELECT station, field, p - lag(p) OVER w AS dp, (v + lag(v) OVER w) / 2 AS m FROM lev WINDOW w AS (PARTITION BY station, field ORDER BY p)) SELECT station, field, sum(dp * m) AS total, count(dp) AS layers FROM s WHERE dp IS NOT NULL GROUP BY ALL HAVING count(dp) > 5 AND avg(dp) < 20000 AND stddev_pop(dp) < 20000", "total")
def _(t: Tables) -> DataFrame:
    return vertical.vertical_integral(levels(t), ["station", "field"], "p", "v")


@query("v2_layer_means", f"{LEVELS}, s AS (SELECT station, field, k, (v + lead(v) OVER w) / 2 AS v, (z + lead(z) OVER w) / 2 AS z FROM lev WINDOW w AS (PARTITION BY station, field ORDER BY k)) SELECT station, field, k, v, z FROM s WHERE v IS NOT NULL AND k <= 4", "v z")
def _(t: Tables) -> DataFrame:
    return vertical.layer_means(levels(t), ["station", "field"], "k", ["v", "z"], first=4)


@query("v3_rate_variability", f"{LEVELS}, s AS (SELECT k, (v - lag(v) OVER w) / (z - lag(z) OVER w) * 1000 AS r FROM lev WINDOW w AS (PARTITION BY station, field ORDER BY k)) SELECT k, stddev_pop(r) AS std, count(r) AS n FROM s WHERE r IS NOT NULL GROUP BY k", "std")
def _(t: Tables) -> DataFrame:
    return vertical.rate_variability(vertical.lapse_rates(levels(t), ["station", "field"], "k", "v", "z"), ["k"])


@query("v4_at_pressures", f"{LEVELS}, s AS (SELECT station, field, ln(p / 100) AS x0, v AS v0, lead(ln(p / 100)) OVER w AS x1, lead(v) OVER w AS v1 FROM lev WINDOW w AS (PARTITION BY station, field ORDER BY p)) SELECT station, field, l::INT AS level, v0 + (v1 - v0) * (ln(l) - x0) / (x1 - x0) AS v FROM s, (VALUES (850), (700), (500), (401), (300), (250)) AS x(l) WHERE ln(l) >= x0 AND ln(l) < x1", "v")
def _(t: Tables) -> DataFrame:
    return vertical.at_pressures(levels(t).withColumn("p", F.col("p") / 100), ["station", "field"], "p", "v", (850, 700, 500, 401, 300, 250))


@query("v6_boundary_layer", f"{LEVELS}, s AS (SELECT station, field, k, v - lag(v) OVER (PARTITION BY station, field ORDER BY k) AS d FROM lev), top AS (SELECT station, field, min(k) FILTER (d > 0) AS top FROM s GROUP BY ALL), c AS (SELECT station, field, arg_min(k, v) AS base, min(v) AS t FROM lev WHERE z < 3000 GROUP BY ALL), u AS (SELECT l.station, l.field, max(v) AS w FROM lev l JOIN c ON c.station = l.station AND c.field = l.field WHERE z < 3000 AND k > base GROUP BY ALL) SELECT station, field, top, base, CASE WHEN base IS NOT NULL THEN w - t END AS strength FROM top LEFT JOIN (SELECT * FROM c JOIN u USING (station, field) WHERE w - t >= 0.5) USING (station, field)", "strength")
def _(t: Tables) -> DataFrame:
    keys = ["station", "field"]
    tops = vertical.first_warming(levels(t), keys, "k", "v")
    return tops.join(vertical.inversions(levels(t), keys, "k", "v", "z"), keys, "left").select(*keys, "top", "base", "strength")


@query("v7_lapse_density", "x AS (SELECT station % 2 AS class, -(v - 40) / (station + 1) AS rate FROM seen), s AS (SELECT class, count(*) AS n, stddev_samp(rate) * pow(count(*), -0.2) AS h, min(rate) AS low, max(rate) AS high FROM x GROUP BY class), c AS (SELECT class, n, h, low, high, (floor((rate - low) / h * 10) + 0.5) * h / 10 + low AS y, count(*) AS k FROM x JOIN s USING (class) GROUP BY ALL), g AS (SELECT *, low + (high - low) * point / 99 AS pos FROM c, (SELECT unnest(range(100)) AS point)), d AS (SELECT class, pos, sum(exp(-0.5 * pow((pos - y) / h, 2)) * k) AS dens FROM g GROUP BY class, pos) SELECT class, arg_max(pos, dens) AS mode FROM d GROUP BY class", "mode")
def _(t: Tables) -> DataFrame:
    from cirrostrat.operators.aggregate import density_mode, kernel_density

    rates = t.seen.select((F.col("station") % 2).alias("class"), (-(F.col("v") - 40) / (F.col("station") + 1)).alias("rate"))
    return density_mode(kernel_density(rates, ["class"], "rate"), ["class"])


FREQS = (1 / 24, 1 / 12, 1 / 100, 0.2)
FREQ_SQL = ", ".join(f"({k}, {f!r}::DOUBLE)" for k, f in enumerate(FREQS))
SPECTRUM = f"""fr(k, f) AS (VALUES {FREQ_SQL}), y AS (SELECT field, (h // 3600 - 473352)::DOUBLE AS t, v - avg(v) OVER (PARTITION BY field) AS y FROM series),
    tau AS (SELECT field, k, f, atan2(sum(sin(4 * pi() * f * t)), sum(cos(4 * pi() * f * t))) / (4 * pi() * f) AS tau FROM y, fr GROUP BY field, k, f),
    s AS (SELECT y.field, k, f, tau, sum(y * cos(2 * pi() * f * (t - tau))) AS yc, sum(y * sin(2 * pi() * f * (t - tau))) AS ys, sum(pow(cos(2 * pi() * f * (t - tau)), 2)) AS cc, sum(pow(sin(2 * pi() * f * (t - tau)), 2)) AS ss, count(*) AS n, max(t) - min(t) AS span FROM y JOIN tau ON tau.field = y.field GROUP BY y.field, k, f, tau)"""


def hours(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.series.select("field", (F.expr("h DIV 3600") - 473352).cast("double").alias("t"), (F.col("v") - F.avg("v").over(Window.partitionBy("field"))).alias("y"))


@query("x1_periodogram", f"{SPECTRUM} SELECT field, k, sqrt(span / n / 2) * (yc / sqrt(cc) * cos(2 * pi() * f * tau) - ys / sqrt(ss) * sin(2 * pi() * f * tau)) AS re, sqrt(span / n / 2) * (yc / sqrt(cc) * sin(2 * pi() * f * tau) + ys / sqrt(ss) * cos(2 * pi() * f * tau)) AS im, span / n * (yc * yc / cc + ys * ys / ss) AS power, n FROM s", "re im power")
def _(t: Tables) -> DataFrame:
    return spectral.periodogram(hours(t), ["field"], "t", "y", FREQS).drop("f")


ALL_FREQS = SPECTRUM.replace(f"(VALUES {FREQ_SQL})", "(SELECT k::INT, (k + 1) / 4000.0::DOUBLE FROM range(2000) AS r(k))")
WHOLE = ", ".join(f'round({e} + 3.7e-8::DOUBLE, 2) + 0 AS {n}' for n, e in (("re", "sqrt(span / n / 2) * (yc / sqrt(cc) * cos(2 * pi() * f * tau) - sn * sin(2 * pi() * f * tau))"), ("im", "sqrt(span / n / 2) * (yc / sqrt(cc) * sin(2 * pi() * f * tau) + sn * cos(2 * pi() * f * tau))"), ("power", "span / n * (yc * yc / cc + sn * sn)")))


@query("x1_full_periodogram", f"{ALL_FREQS}, x AS (SELECT *, CASE WHEN ss >= 1e-4 THEN ys / sqrt(ss) END AS sn FROM s) SELECT field, k, {WHOLE}, n FROM x WHERE k < 1990")
def _(t: Tables) -> DataFrame:
    """All frequencies up to one in two hours, but the last ones, where the sine term of whole hours has no norm."""
    got = spectral.full_periodogram(hours(t), ["field"], "t", "y", 1 / 4000, 2000).filter("k < 1990")
    return got.select("field", "k", *((F.round(F.col(c) + 3.7e-8, 2) + F.lit(0.0)).alias(c) for c in ("re", "im", "power")), "n")


@query("x2_one_cycle", "y AS (SELECT field, h // 3600 - 473352 AS t, v - avg(v) OVER (PARTITION BY field) AS y FROM series), m AS (SELECT field, sum(cos(2 * pi() / 24 * t) * cos(2 * pi() / 24 * t)) AS cc, sum(sin(2 * pi() / 24 * t) * sin(2 * pi() / 24 * t)) AS ss, sum(cos(2 * pi() / 24 * t) * sin(2 * pi() / 24 * t)) AS cs, sum(y * cos(2 * pi() / 24 * t)) AS yc, sum(y * sin(2 * pi() / 24 * t)) AS ys FROM y GROUP BY field), b AS (SELECT field, (yc * ss - ys * cs) / (cc * ss - cs * cs) AS a, (ys * cc - yc * cs) / (cc * ss - cs * cs) AS b FROM m) SELECT field, sqrt(a * a + b * b) AS amplitude, ((atan2(b, a) / (2 * pi()) * 24) % 24 + 24) % 24 AS phase FROM b", "amplitude phase")
def _(t: Tables) -> DataFrame:
    return spectral.one_cycle(hours(t), ["field"], "t", "y", 24.0)


@query("x3_welch", rounds="power low high")
def _(t: Tables) -> DataFrame:
    return spectral.welch(hours(t), ["field"], "t", "y", FREQS, 4, alpha=0.05).drop("f")


@query("x3_coherence", rounds="re im coherence")
def _(t: Tables) -> DataFrame:
    return spectral.coherence(hours(t), "field", "click", "view", "t", "y", FREQS, 4).drop("f")


@query("x4_fourier_sums", f"fr(k, f) AS (VALUES {FREQ_SQL}), y AS (SELECT field, (h // 3600 - 473352)::DOUBLE AS t, v - avg(v) OVER (PARTITION BY field) AS y FROM series) SELECT field, k, avg(y * cos(2 * pi() * f * t)) AS re, avg(-y * sin(2 * pi() * f * t)) AS im FROM y, fr WHERE NOT (t BETWEEN 200 AND 260) GROUP BY field, k", "re im")
def _(t: Tables) -> DataFrame:
    return spectral.fourier_sums(hours(t), ["field"], "t", "y", FREQS, F.col("t").between(200, 260)).drop("f")


def matrix(t: Tables) -> DataFrame:
    """Vectors as times and components as places."""
    return t("embeddings").select(F.col("vec_id").alias("time"), F.posexplode("embedding").alias("place", "v")).withColumn("v", F.col("v").cast("double"))


@query("e1_eof_shares", rounds="eigenvalue explained")
def _(t: Tables) -> DataFrame:
    return eof.loadings(matrix(t), "place", "time", "v", 5)[1]


@query("e1_eof_scores", rounds="score")
def _(t: Tables) -> DataFrame:
    weights, _ = eof.loadings(matrix(t), "place", "time", "v", 3)
    return eof.scores(matrix(t), weights, "place", "time", "v")


@query("e2_filled_gaps", rounds="v filled")
def _(t: Tables) -> DataFrame:
    gappy = eof.random_mask(matrix(t), ["place", "time"], 0.1).withColumn("v", F.when(~F.col("masked"), F.col("v"))).drop("masked")
    return eof.fill_gaps(gappy, "place", "time", "v", 3).filter("v IS NULL")


@query("e3_reconstruction_error", rounds="rms missing")
def _(t: Tables) -> DataFrame:
    weights, _ = eof.loadings(matrix(t), "place", "time", "v", 8)
    return eof.rms_difference(eof.with_reconstruction(matrix(t), weights, "place", "time", "v"), None, [], "v", "rebuilt")


@query("e4_masks")
def _(t: Tables) -> DataFrame:
    both = eof.random_mask(matrix(t), ["place", "time"], 0.2).withColumnRenamed("masked", "alone")
    return eof.block_mask(both, "place", "time", 0.2, 5).groupBy("place").agg(F.avg(F.col("alone").cast("double")).alias("alone"), F.avg(F.col("masked").cast("double")).alias("blocks"))


@query("e5_distant_dropped", f"{DIST}, w AS (SELECT a AS station, sum(metres * metres) AS weight FROM dist GROUP BY a) SELECT station, weight / 1e12 AS weight FROM w WHERE weight <= (SELECT avg(weight) + stddev_samp(weight) FROM w)", "weight")
def _(t: Tables) -> DataFrame:
    return eof.distant_dropped(t.stations).withColumn("weight", F.col("weight") / 1e12)


ZED = "z AS (SELECT station, h, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z, stddev_samp(v) OVER w AS std FROM seen WINDOW w AS (PARTITION BY station))"


@query("r1_neighbour_average", f"{SMALL_DIST}, {ZED}, w AS (SELECT a, b, exp(-pow(metres / (SELECT avg(metres) FROM dist), 2)) AS w FROM dist WHERE a <> b), e AS (SELECT a AS station, h, sum(w * z) / sum(w) AS e FROM z JOIN w ON w.b = z.station GROUP BY ALL) SELECT e.station, e.h, e.e * s.std AS estimate FROM e JOIN (SELECT DISTINCT station, std FROM z) s ON s.station = e.station", "estimate")
def _(t: Tables) -> DataFrame:
    return regress.neighbour_average(t.seen, network.nearest_graph(few(t), 16), "station", "h", "v")


@query("r2_availability", "p AS (SELECT h, array_to_string(list_sort(list(DISTINCT station)), ',') AS pattern FROM seen GROUP BY h) SELECT pattern, count(*) AS times, min(h) AS first, max(h) AS last FROM p GROUP BY pattern")
def _(t: Tables) -> DataFrame:
    return regress.pattern_blocks(t.seen, "station", "h", "v")


@query("r3_predicted", rounds="value predicted")
def _(t: Tables) -> DataFrame:
    return regress.predicted_from_others(t.series, "view", "field", "h", "v")


@query("r4_neighbour_differences", f"{SMALL_DIST}, o AS (SELECT a.station AS a, b.station AS b, count(*) AS n FROM seen a JOIN seen b USING (h) GROUP BY ALL HAVING count(*) >= 40), nn AS (SELECT o.a, o.b FROM o JOIN dist d ON d.a = o.a AND d.b = o.b QUALIFY row_number() OVER (PARTITION BY o.a ORDER BY metres, o.b) <= 5), d AS (SELECT nn.a AS station, x.h, sum(abs(x.v - y.v)) AS d FROM nn JOIN seen x ON x.station = nn.a JOIN seen y ON y.station = nn.b AND y.h = x.h WHERE nn.a <> nn.b GROUP BY ALL) SELECT station, h, d / nullif(stddev_samp(d) OVER (PARTITION BY station), 0) AS score FROM d", "score")
def _(t: Tables) -> DataFrame:
    near5 = network.nearest_overlapping(t.seen, few(t), 5, 40)
    return regress.neighbour_differences(t.seen, near5, "station", "h", "v")


def local_rows(t: Tables) -> DataFrame:
    return t.obs.select("station", F.expr("t DIV 604800").alias("chunk"), ((F.col("sensor") % 17).cast("double")).alias("x"), F.col("v").alias("y"))


@query("r5_local_regression", f"{SMALL_DIST}, r AS (SELECT station AS b, t // 604800 AS chunk, (sensor % 17)::DOUBLE AS x, v AS y FROM obs), s AS (SELECT a AS station, chunk, count(*) AS n, sum(w) AS w, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM r JOIN (SELECT a, b, exp(-pow(metres / 60000, 2)) AS w FROM dist WHERE metres < 120000) d ON d.b = r.b GROUP BY ALL HAVING count(*) >= 5), f AS (SELECT *, (w * sxy - sx * sy) / (w * sxx - sx * sx) AS slope FROM s) SELECT station, chunk, n, slope, (sy - slope * sx) / w AS icpt FROM f", "slope icpt")
def _(t: Tables) -> DataFrame:
    return regress.local_regression(local_rows(t), grid.distances(few(t), within=120_000), "station", ["chunk"], "x", "y", 120000.0, regress.gaussian(60000.0))


@query("r6_laplacian", rounds="slope icpt")
def _(t: Tables) -> DataFrame:
    return regress.laplacian_regression(local_rows(t), network.nearest_graph(few(t), 16), "station", "chunk", "x", "y", 0.1, regress.gaussian(60000.0))


@query("r7_flag_statistics", "f AS (SELECT 'high' AS \"check\", station, v > 100 AS flag FROM obs UNION ALL SELECT 'low', station, v < 1 FROM obs) SELECT \"check\", station, count(flag) AS n, sum(flag::INT)::BIGINT AS flagged, avg(flag::INT) AS share FROM f GROUP BY ALL", "share")
def _(t: Tables) -> DataFrame:
    part = lambda name, flag: t.obs.select(F.lit(name).alias("check"), "station", flag.alias("flag"))
    return regress.flag_statistics(part("high", F.col("v") > 100).unionByName(part("low", F.col("v") < 1)), "station")


@query("r7_merged_flags", "SELECT id, CASE WHEN v > 100 AND v > 150 THEN 'high,top' WHEN v > 100 THEN 'high' ELSE '' END AS checks FROM obs")
def _(t: Tables) -> DataFrame:
    part = lambda name, flag: t.obs.select(F.lit(name).alias("check"), "id", flag.alias("flag"))
    flags = part("high", F.col("v") > 100).unionByName(part("top", F.col("v") > 150))
    return regress.merged_flags(t.obs.select("id"), flags, ["id"]).withColumn("checks", F.array_join("checks", ","))


@query("r8_clusters")
def _(t: Tables) -> DataFrame:
    curve = t.hourly.groupBy("station", F.expr("h % 86400 DIV 21600").alias("q")).agg(F.avg("v").alias("v"))
    return regress.clustered_curves(curve, "station", "q", "v", [0, 1, 2, 3], 2)


CLEAR = "x AS (SELECT station, h // 86400 AS day, v AS m, 60 + h % 86400 / 3600.0::DOUBLE * 5 AS t FROM seen), ok AS (SELECT * FROM x WHERE m <= t), dd AS (SELECT station, day, avg(m) / avg(t) AS r FROM ok GROUP BY ALL), br AS (SELECT station, day FROM dd QUALIFY r > 0.5 * max(r) OVER (PARTITION BY station)), b AS (SELECT ok.* FROM ok JOIN br USING (station, day)), f AS (SELECT station, sum(m * t) / sum(t * t) AS s FROM b GROUP BY station)"


@query("r9_clear_sky", f"{CLEAR} SELECT b.station, sum(m * t) / sum(t * t) AS slope, count(*) AS n FROM b JOIN f USING (station) WHERE m > s * t GROUP BY b.station", "slope")
def _(t: Tables) -> DataFrame:
    rows = t.seen.select("station", F.expr("h DIV 86400").alias("day"), F.col("v").alias("m"), (60 + F.col("h") % 86400 / 3600.0 * 5).alias("top"))
    return regress.clear_sky_slope(rows, "station", "day", "m", "top", 0.5)


@query("r10_orthogonal", "s AS (SELECT field, count(*) AS n, var_pop(d) / 1e4 AS xx, var_pop(v) AS yy, covar_pop(d / 100.0::DOUBLE, v) AS xy, avg(d / 100.0::DOUBLE) AS mx, avg(v) AS my FROM daily GROUP BY field), b AS (SELECT *, (yy - xx + sqrt((yy - xx) * (yy - xx) + 4 * xy * xy)) / (2 * xy) AS slope FROM s) SELECT field, n, 1 / slope AS back FROM b", "back")
def _(t: Tables) -> DataFrame:
    fit = regress.orthogonal_fit(t.daily.withColumn("x", F.col("d") / 100.0), ["field"], "x", "v")
    return fit.select("field", "n", (1 / F.col("slope")).alias("back"))


@query("r10_ransac", rounds="slope icpt")
def _(t: Tables) -> DataFrame:
    yearly = t.daily.groupBy("field", F.year("date").alias("x")).agg(F.avg("v").alias("y"))
    return regress.ransac_fit(yearly, ["field"], "x", "y")


@query("r11_r12_horizon", rounds="angle metres")
def _(t: Tables) -> DataFrame:
    land = cells(t).withColumn("elev", 1000 + 500 * F.sin(F.col("i")) + 300 * F.cos(F.col("j")))
    rim = terrain.horizon(t.stations, land, 100_000.0, 36)
    sun = t.stations.select("station", F.lit(0.05).alias("mu")).withColumn("azimuth", F.explode(F.array(F.lit(35.0), F.lit(125.0), F.lit(275.0))))
    hit = terrain.blocked(sun, rim, 36).groupBy("station").agg(F.sum(F.col("blocked").cast("long")).alias("hits"))
    return rim.join(hit, "station")


@query("u4_per_series", "o AS (SELECT field, v, row_number() OVER (PARTITION BY field ORDER BY v) AS i, count(*) OVER (PARTITION BY field) AS n FROM series) SELECT field, 2 * sum((2 * i - n - 1) * v) / (any_value(n) * (any_value(n) - 1.0::DOUBLE)) AS spread, avg(v) FILTER (i > n // 4 AND i <= n - n // 4) AS middle FROM o GROUP BY field", "spread middle")
def _(t: Tables) -> DataFrame:
    """Mean difference of all pairs of values, from their order, and the mean of the middle half: reductions that Spark lacks."""
    return regress.per_series(t.series, ["field"], ["v"], spread_and_middle, ["spread", "middle"])


def spread_and_middle(v: object) -> tuple[float, float]:
    import numpy as np

    v, n = np.sort(v), len(v)
    return 2 * ((2 * np.arange(1, n + 1) - n - 1) * v).sum() / (n * (n - 1)), v[n // 4 : n - n // 4].mean()


@query("u1_each_run", "x AS (SELECT start, abs(v - lag(v) OVER (PARTITION BY start, station ORDER BY step)) AS d FROM fcst) SELECT start, avg(d) AS rough, count(d) AS n FROM x GROUP BY start HAVING count(d) > 0", "rough")
def _(t: Tables) -> DataFrame:
    return regress.each_run(t.fcst.select("start", "station", "step", "v"), "start", "cirrostrat.plans.space_queries.roughness", "start long, rough double, n long")


def roughness(rows: object) -> object:
    """The mean change from step to step over the stations of a run."""
    changes = rows.sort_values(["station", "step"]).groupby("station")["v"].diff().abs().dropna()
    return rows[["start"]].head(int(len(changes) > 0)).assign(rough=changes.mean(), n=len(changes))





@query("u2_interpolators", f"{WEIGHTS}, near1 AS (SELECT station, i, j FROM wt QUALIFY row_number() OVER (PARTITION BY station ORDER BY w DESC, i, j) = 1) SELECT station, d, 'bilinear' AS how, sum(w * v) AS v FROM grid JOIN wt USING (i, j) GROUP BY station, d UNION ALL SELECT station, d, 'nearest', v FROM grid JOIN near1 USING (i, j)", "v")
def _(t: Tables) -> DataFrame:
    out = [grid.interpolated(t.grid, off(t), ["d"], how).withColumn("how", F.lit(how)) for how in ("bilinear", "nearest")]
    inside = out[0].select("station").distinct()
    return out[0].unionByName(out[1].join(inside, "station", "left_semi"))


@query("m16_rotated_components", rounds="difference")
def _(t: Tables) -> DataFrame:
    """A turn of the components and its inverse give the scores again; the largest difference by component."""
    import numpy as np

    weights, _ = eof.loadings(matrix(t), "place", "time", "v", 2)
    weights, score = eof.scaled(weights, eof.scores(matrix(t), weights, "place", "time", "v"), "time")
    turn = np.array([[0.6, 0.8], [-0.8, 0.6]])
    back = eof.rotated(eof.rotated(score, turn, ["time"], "score"), turn.T, ["time"], "score").withColumnRenamed("score", "again")
    return score.join(back, ["time", "component"]).groupBy("component").agg(F.max(F.abs(F.col("score") - F.col("again"))).alias("difference"), F.count("*").alias("n"))


@query("w20_local_polynomial", rounds="smooth")
def _(t: Tables) -> DataFrame:
    from cirrostrat.operators.windows import local_polynomial

    at = t.series.groupBy("field").agg(F.explode(F.sequence(F.min("h"), F.max("h"), F.lit(86400).cast("long"))).alias("s"))
    return local_polynomial(t.series, ["field"], "h", "v", at, 10800)
