"""Text readers on byte ranges: headers, block changes and line ends that fall on the bounds of ranges, against plain loops over whole files."""

import re

import pytest

from cirrostrat.sources import text


@pytest.fixture(params=[40, 97, 1 << 20])
def ranges(spark, request):
    """Ranges of a few lines, or one for a file."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_lines_are_numbered_over_ranges(spark, tmp_path, ranges, end):
    files = {"a.txt": ["first", "", "x" * 150, *(f"line {i}" for i in range(60)), "", "é last"], "b.txt": ["one"], "c.txt": [""] * 9 + ["end"]}
    for name, rows in files.items():
        (tmp_path / name).write_bytes((end.join(rows) + end).encode())
    df = text.lines(spark, str(tmp_path))
    got = sorted((r.file.rsplit("/", 1)[1], r.n, r.line) for r in df.collect())
    assert got == sorted((name, n, line) for name, rows in files.items() for n, line in enumerate(rows) if line)
    assert (df.select("_span").distinct().count() > 5) == (ranges < 1000)


def test_logger_headers_over_ranges(spark, tmp_path, ranges):
    for k, names in (("p", ("TIMESTAMP", "temp", "wind")), ("q", ("TIMESTAMP", "wind"))):
        head = ['"TOA5","a very long first line of this file, longer than a range of bytes"', ",".join(f'"{n}"' for n in names), '"TS","C"', '"","Avg"']
        body = [f'"2024-01-01 {h:02d}:00:00",{",".join(str(h * 10 + i) for i in range(len(names) - 1))}' for h in range(24)]
        (tmp_path / f"{k}.dat").write_bytes(("\r\n".join(head + body) + "\r\n").encode())
    got = {(r.file[-5], r.ts.hour, r.name): r.value for r in text.logger_file(spark, str(tmp_path)).collect()}
    assert got == {("p", h, n): h * 10.0 + i for h in range(24) for i, n in enumerate(("temp", "wind"))} | {("q", h, "wind"): h * 10.0 for h in range(24)}


def test_stacked_tables_over_ranges(spark, tmp_path, ranges):
    years = [*range(1950, 1975), *range(1950, 1953), *range(1980, 1999)]
    rows = ["1950 1998", *(f" {y} " + " ".join(f"{m + 0.5}" if (y + m) % 7 else "-99.99" for m in range(12)) for y in years), "a footer"]
    (tmp_path / "x.data").write_text("\n".join(rows))
    got = sorted((r.block, r.month.year, r.month.month, r.value) for r in text.index_table(spark, str(tmp_path)).collect())
    blocks = [0 if i < 25 else 1 if i < 28 else 2 for i in range(len(years))]
    assert got == sorted((b, y, m + 1, m + 0.5) for b, y in zip(blocks, years) for m in range(12) if (y + m) % 7)
    kinds = {r.n: r.block for r in text.blocks_by_kind(spark, str(tmp_path), r"^ \d{4} ").collect()}
    want, block = {}, 0
    for n, line in enumerate(rows):
        block += n > 0 and bool(re.match(r"^ \d{4} ", line)) != bool(re.match(r"^ \d{4} ", rows[n - 1]))
        want[n] = block
    assert kinds == want


def test_basin_table_over_ranges(spark, tmp_path, ranges):
    rows = ["station of the upper basin", "", "DateTime,flow,level", *(f"2024-02-{d:02d} 06:00:00,{d if d % 5 else -6999},{d / 4}" for d in range(1, 29))]
    (tmp_path / "k.csv").write_bytes("\r".join(rows).encode())
    got = {(r.ts.day, r.name): r.value for r in text.hourly_basin_table(spark, str(tmp_path)).collect()}
    assert got == {(d, "flow"): float(d) if d % 5 else None for d in range(1, 29)} | {(d, "level"): d / 4 for d in range(1, 29)}


def test_soundings_of_more_levels_than_a_record_holds(spark, tmp_path):
    """Over 11,000 readings of a station in a day: pressures and counts would be cut to the columns of the format."""
    from pyspark.sql import functions as F

    from cirrostrat import plans

    n = 11_000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") % 86_400).alias("ts"), F.lit(3).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 500).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.k, r.p, r.temp) for r in plans.queries()["s5_soundings"](spark, str(tmp_path)).collect())
    assert got == [(k, 90000.0 - k * 100, float(k % 500) if k % 5 else None) for k in range(n)]
