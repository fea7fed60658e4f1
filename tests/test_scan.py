"""Scans over spans against plain loops over whole series: runs over several spans, empty spans, null keys and values."""

import random

import pytest
from pyspark.sql import functions as F

from cirrostrat.operators import compare, join, scan, windows

WIDTH = 100


@pytest.fixture(scope="module")
def series(spark):
    """Key a: a value held over four spans, two of them empty; key b: short; a null key; times that are not distinct from others' times."""
    draw = random.Random(3)
    rows = []
    for k, top, n in (("a", 3000, 90), ("b", 150, 5), (None, 900, 30), ("c", 40_000, 12)):
        for t in sorted(draw.sample(range(top), n)):
            rows.append((k, t, draw.choice((None, None, None, 1.0, 2.0, 3.0)), draw.choice((True, False, False))))
    rows = [r if not (r[0] == "a" and 700 < r[1] < 1900) else (r[0], r[1], None, True) for r in rows]
    return rows, spark.createDataFrame(rows, "k string, t long, v double, f boolean").repartition(7)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_held_running_beside_numbered(series):
    rows, df = series
    cut = scan.spans(df, "t", WIDTH)
    x = scan.held(cut, ["k"], ["t"], {"back": F.col("v")})
    x = scan.held(x, ["k"], ["t"], {"ahead": F.col("v")}, forward=False)
    x = scan.running(x, ["k"], ["t"], "total", F.col("v"))
    x = scan.running(x, ["k"], ["t"], "most", F.col("v"), "max", before=True)
    x = scan.beside(x, ["k"], ["t"], {"v0": F.col("v"), "t0": F.col("t")}, {"t1": F.col("t")})
    x = scan.numbered(x, ["k"], ["t"], "piece", F.col("v"), lambda a, b: a != b)
    got = {(r.k, r.t): r for r in x.collect()}
    assert len(got) == len(rows)
    for k, own in by_key(rows).items():
        v = [r[2] for r in own]
        piece = 0
        for i, r in enumerate(own):
            g = got[k, r[1]]
            known, later = [y for y in v[: i + 1] if y is not None], [y for y in v[i:] if y is not None]
            before = [y for y in v[:i] if y is not None]
            piece += i > 0 and v[i - 1] is not None and v[i] is not None and v[i - 1] != v[i]
            assert (g.back, g.ahead) == (known[-1] if known else None, later[0] if later else None)
            assert (g.total, g.most) == (sum(known) if known else None, max(before) if before else None)
            assert (g.v0, g.t0, g.t1) == (v[i - 1] if i else None, own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None)
            assert g.piece == piece


def test_windows_over_spans(series):
    rows, df = series
    pieces = windows.interval_segments(df, ["k"], "t", 2, WIDTH)
    wide = windows.interval_segments(df, ["k"], "t", 2, 10**9)
    order = lambda d: sorted(map(str, d.collect()))
    assert order(pieces) == order(wide)
    assert order(windows.filled(df, ["k"], "t", "v", True, WIDTH)) == order(windows.filled(df, ["k"], "t", "v", True, 10**9))
    assert order(windows.regular(df, ["k"], "t", 7, "v", True, WIDTH)) == order(windows.regular(df, ["k"], "t", 7, "v", True, 10**9))
    spans = df.filter("k IS NOT NULL").select("k", "t", (F.col("t") + F.when(F.col("f"), 1000).otherwise(3)).alias("e"))
    got = {(r.k, r.start, r.end) for r in windows.merged_intervals(spans, ["k"], "t", "e", WIDTH).collect()}
    want = set()
    for k, own in by_key([r for r in rows if r[0]]).items():
        held = []
        for r in own:
            end = r[1] + (1000 if r[3] else 3)
            if held and r[1] <= held[-1][1]:
                held[-1][1] = max(held[-1][1], end)
            else:
                held.append([r[1], end])
        want |= {(k, a, b) for a, b in held}
    assert got == want


def test_islands_and_rows_around(series):
    rows, df = series
    month = df.withColumn("t", F.col("t") * 40_000)  # runs over several spans of the operators' own width
    got = {(r.k, r.start, r.end, r.length) for r in windows.islands(month, ["k"], "t", F.col("f")).collect()}
    want, around = set(), set()
    for k, own in by_key(rows).items():
        run = []
        for r in [*own, (k, 0, 0, False)]:
            if r[3]:
                run.append(r[1] * 40_000)
            elif run:
                want.add((k, run[0], run[-1], len(run)))
                run = []
        hits = [i for i, r in enumerate(own) if r[2] == 3.0]
        around |= {(k, r[1] * 40_000) for i, r in enumerate(own) if any(abs(i - j) <= 2 for j in hits)}
    assert got == want
    assert {(r.k, r.t) for r in windows.context(month, ["k"], "t", F.col("v") == 3.0, 2).collect()} == around
    small = scan.near(scan.spans(month, "t"), ["k"], ["t"], 2, 8)
    assert small.filter("_own").count() == len(rows) < small.count()


def test_as_of_over_empty_spans(spark, series):
    rows, df = series
    asks = spark.createDataFrame([(k, t) for k in ("a", "b", "c", None, "z") for t in (-5, 0, 70, 650, 1500, 2999, 39_000, 10**6)], "k string, s long")
    got = {(r.k, r.s): r.v for r in join.as_of(asks, df.select("k", "t", "v"), ["k"], "s", "v", "t", WIDTH).collect()}
    keyed = by_key(rows)
    for (k, s), v in got.items():
        known = [r[2] for r in keyed.get(k, []) if r[1] <= s and r[2] is not None]
        assert v == (known[-1] if known else None)
    assert len(got) == 40


def test_ranks_and_blocks_by_ranges(spark):
    draw = random.Random(8)
    rows = [("a", i, draw.random()) for i in range(300)] + [("b", i, 0.5) for i in range(40)]
    got = compare.candidates(spark.createDataFrame(rows, "k string, i long, q double").repartition(5), "q", ["k", "i"]).collect()
    for k in "ab":
        want = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        assert [r.i for r in sorted((g for g in got if g.k == k), key=lambda r: r.place)] == [r[1] for r in want]
    runs = spark.createDataFrame([(i, 121 if i % 50 < 30 else 145) for i in range(200)], "s long, n long").repartition(6)
    blocks = sorted(map(tuple, compare.length_blocks(runs, "s", "n").collect()))
    assert [b[1:] for b in blocks] == [(121, a, a + 29, 30) if j == 0 else (145, a + 30, a + 49, 20) for a in range(0, 200, 50) for j in (0, 1)]


def test_scans_of_nothing(series):
    none = series[1].filter("false")
    assert windows.interval_segments(none, ["k"], "t").count() == windows.filled(none, ["k"], "t", "v").count() == windows.islands(none, ["k"], "t", F.col("f")).count() == 0


def test_no_window_sorts_a_whole_series(series):
    """Windows of rows are partitioned by span or piece; those by key alone are ordered by span: they see the carries."""
    _, df = series
    f = F.col("f")
    for made in (windows.filled(df, ["k"], "t", "v"), windows.backward_pieces(df, "t", "t", ["k"]), windows.amounts(df, ["k"], "t", "v"), windows.islands(df, ["k"], "t", f), windows.context(df, ["k"], "t", f)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        parts = [line.rsplit("], [", 2)[1:] for line in plan.splitlines() if "Window [" in line]
        assert len(parts) > 1 and all("_span" in by or "_span" in order for by, order in parts)
