"""Differences of versions by sums of ranges, and stores that are clustered by time."""

import random
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cirrostrat.operators import compare
from cirrostrat.sources import stores


def test_differences_by_ranges(spark):
    """Versions with equal, changed, missing and null parts, at several widths, against plain loops."""
    draw = random.Random(5)
    a = {(k, t): draw.choice((None, 1.0, 2.0, 3.0)) for k in ("x", "y", None) for t in range(0, 3000, 7)}
    b = dict(a)
    for key in draw.sample(sorted(a, key=str), 40):
        if draw.random() < 0.4:
            del b[key]
        else:
            b[key] = draw.choice((None, 5.0))
    b["x", 5000] = 1.0
    frame = lambda d: spark.createDataFrame([(k, t, v) for (k, t), v in d.items()], "k string, t long, v double").repartition(5)
    one, two = frame(a), frame(b)
    both = [key for key in a if key in b and key[0]]
    for width in (50, 400, 10**6):
        got = {r.k: (r.only_a, r.only_b, r.unequal, r.start, r.end) for r in compare.table_diff(one, two, "k", ["t"], "t", "v", width).filter("k IS NOT NULL").collect()}
        for k in "xy":
            own = [t for j, t in both if j == k]
            assert got[k] == (sum(j == k and (j, t) not in b for j, t in a), sum(j == k and (j, t) not in a for j, t in b), sum(a[k, t] != b[k, t] for t in own), min(own), max(own))
        cells = {(r.k, r.t): (r.a, r.b) for r in compare.differing_cells(one, two, ["k", "t"], "v", width).collect()}
        assert cells == {key: (a[key], b[key]) for key in both if None not in (a[key], b[key]) and a[key] != b[key]}
        equal = {r.k: (r.equal, r.unequal, r.first_unequal) for r in compare.inequality(one, two, "k", "t", "v", width).filter("k IS NOT NULL").collect()}
        assert equal == {k: (sum(a[j, t] == b[j, t] for j, t in both if j == k), sum(a[j, t] != b[j, t] for j, t in both if j == k), min((t for j, t in both if j == k and a[j, t] != b[j, t]), default=None)) for k in "xy"}


def test_equal_ranges_are_not_joined(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("t"), (F.col("id") % 9).cast("double").alias("v"))
    other = rows.withColumn("v", F.when(F.col("t") == 12_345, -1.0).otherwise(F.col("v")))
    equal = compare.equal_ranges(rows, other, "k", ["t"], "t", "v", 100)
    assert equal.count() == 199 and compare.changed(rows, equal, "k", "t", 100).count() == 100


def test_a_day_of_a_year_opens_few_files(spark, tmp_path):
    rows = spark.range(365 * 24 * 4).select(F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("field"), (F.col("id") * 900).alias("t"), F.rand(1).alias("v"))
    path = f"file://{tmp_path}/store"
    stores.store_by_field(rows, path, ts="t", files=300)
    first, last = 100 * 86400, 101 * 86400 - 1
    groups = hit = 0
    for f in Path(tmp_path, "store").rglob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("t")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            groups, hit = groups + 1, hit + (s.min <= last and s.max >= first)
    assert groups >= 290 and hit < 0.02 * groups
    assert stores.read_span(spark, path, "a", first, last).count() == 48
