"""Differences of two versions of a table, and set operations on runs and stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.functions.times import seconds
from cirrostrat.operators import scan
from cirrostrat.runtime import stash


def both_versions(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, `a`, `b`, in_a, in_b; every key of either."""
    x = a.select(*keys, F.col(value).alias("a"), F.lit(True).alias("in_a"))
    y = b.select(*keys, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    return x.join(y, list(keys), "full_outer").fillna(False, ["in_a", "in_b"])


def largest_mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], ts: str, value: str, n: int) -> DataFrame:
    """The n largest absolute differences at common keys, without those at the last time of the shorter version."""
    ends = a.agg(F.max(ts).alias("x")).join(b.agg(F.max(ts).alias("y")), how="cross").select(F.least("x", "y").alias("_end"))
    met = both_versions(a, b, keys, value).filter("in_a AND in_b").join(F.broadcast(ends), how="cross").filter(F.col(ts) < F.col("_end"))
    diff = F.abs(F.col("a") - F.col("b"))
    return met.select(*keys, "a", "b", diff.alias("diff")).filter("diff > 0").orderBy(F.desc("diff"), *keys).limit(n)


def dominating(df: DataFrame, a: str, b: str, times: float, n: int, keys: Sequence[str]) -> DataFrame:
    """The n smallest ratios a / b over `times`."""
    ratio = F.try_divide(F.col(a), F.col(b))
    return df.withColumn("ratio", ratio).filter(F.col("ratio") > times).orderBy("ratio", *keys).limit(n)


def candidates(df: DataFrame, measure: str, keys: Sequence[str], descending: bool = True) -> DataFrame:
    """Rows numbered by a measure of quality within each first key, to be gone through in that order. Rows are sorted by ranges and numbered inside of
    them, from the counts of the ranges before."""
    order = F.desc(measure) if descending else F.asc(measure)
    dealt = scan.ranges(df, F.col(keys[0]), order, *map(F.col, keys[1:]))
    return scan.running(dealt, keys[:1], [order, *keys[1:]], "place", F.lit(1).cast("long")).withColumn("place", F.col("place").cast("int")).drop("_span")


def ends(df: DataFrame, keys: Sequence[str], order: str, n: int, last: bool = False) -> DataFrame:
    """The first or last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def longest_record(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n")).agg(F.max_by(key, F.struct("n", -F.col(key))).alias(key), F.max("n").alias("n"))


def joined_runs(runs: Sequence[DataFrame], step: str, common: bool = True) -> DataFrame:
    """Runs one after another, columns that one lacks null; cut to the steps that all of them reach."""
    out = runs[0].withColumn("_k", F.lit(0))
    for k, r in enumerate(runs[1:], 1):
        out = out.unionByName(r.withColumn("_k", F.lit(k)), allowMissingColumns=True)
    if common:
        reach = out.groupBy("_k").agg(F.max(step).alias("_m")).agg(F.min("_m").alias("_reach"))
        out = out.join(F.broadcast(reach), how="cross").filter(F.col(step) <= F.col("_reach")).drop("_reach")
    return out.drop("_k")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def key_sets(tables: Sequence[DataFrame], key: str, how: str) -> DataFrame:
    """Keys in all tables, in the first only, or in an odd number of them (for two: in just one)."""
    sets = [t.select(key).dropna().distinct() for t in tables]
    if how == "all":
        out = sets[0]
        for s in sets[1:]:
            out = out.intersect(s)
        return out
    if how == "first":
        out = sets[0]
        for s in sets[1:]:
            out = out.subtract(s)
        return out
    union = sets[0]
    for s in sets[1:]:
        union = union.unionByName(s)
    return union.groupBy(key).agg(F.count("*").alias("_n")).filter("_n % 2 = 1").select(key)


def equal_ranges(a: DataFrame, b: DataFrame, group: str, keys: Sequence[str], ts: str, value: str, width: int = scan.MONTH) -> DataFrame:
    """(group, _range, n, start, end): the spans of `width` seconds of a group in which both versions hold the same rows, by their number and two sums of
    hashes. Only sums are shuffled, combined before; keys are unique in a version."""

    def sums(df: DataFrame) -> DataFrame:
        row = [*dict.fromkeys([group, *keys, ts]), value, F.col(value).isNull()]
        hashes = F.bit_xor(F.xxhash64(*row)).alias("_x"), F.sum(F.pmod(F.xxhash64(F.lit(7), *row), F.lit(1 << 31))).alias("_s")
        return df.groupBy(group, F.floor(seconds(ts) / width).alias("_range")).agg(F.count("*").alias("n"), *hashes, F.min(ts).alias("start"), F.max(ts).alias("end"))

    same = [group, "_range", "n", "_x", "_s"]
    return stash(sums(a).join(sums(b).select(*same), same).drop("_x", "_s"), "equal")


def changed(df: DataFrame, equal: DataFrame, group: str, ts: str, width: int = scan.MONTH) -> DataFrame:
    """The rows outside of equal ranges: where those are few enough to be sent to all tasks, no other row is shuffled."""
    return df.withColumn("_range", F.floor(seconds(ts) / width)).join(equal.select(group, "_range"), [group, "_range"], "left_anti").select(*df.columns)


def table_diff(a: DataFrame, b: DataFrame, group: str, keys: Sequence[str], ts: str, value: str, width: int = scan.MONTH) -> DataFrame:
    """Per group: rows only in a, only in b, unequal ones (two nulls are equal), and the first and last common time. Ranges of time that are equal in both
    versions are told by their sums, and not joined."""
    equal = equal_ranges(a, b, group, keys, ts, value, width)
    met = both_versions(changed(a, equal, group, ts, width), changed(b, equal, group, ts, width), [group, *keys], value)
    both = F.col("in_a") & F.col("in_b")
    count = lambda c: F.count(F.when(c, 1))
    differ = met.groupBy(group).agg(
        count(F.col("in_a") & ~F.col("in_b")).alias("only_a"), count(F.col("in_b") & ~F.col("in_a")).alias("only_b"), count(both & ~F.col("a").eqNullSafe(F.col("b"))).alias("unequal"),
        F.min(F.when(both, F.col(ts))).alias("start"), F.max(F.when(both, F.col(ts))).alias("end"),
    )
    none = [F.lit(0).cast("long").alias(c) for c in ("only_a", "only_b", "unequal")]
    parts = differ.unionByName(equal.select(group, *none, "start", "end"))
    return parts.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("only_a", "only_b", "unequal")), F.min("start").alias("start"), F.max("end").alias("end"))


def inequality(a: DataFrame, b: DataFrame, group: str, ts: str, value: str, width: int = scan.MONTH) -> DataFrame:
    """Per group: equal and unequal values, differences in what is missing, and the first time of inequality. Equal ranges are counted, not joined."""
    ranges = equal_ranges(a, b, group, [ts], ts, value, width)
    met = both_versions(changed(a, ranges, group, ts, width), changed(b, ranges, group, ts, width), [group, ts], value).filter("in_a AND in_b")
    same = F.col("a").eqNullSafe(F.col("b"))
    count = lambda c: F.count(F.when(c, 1))
    parts = met.groupBy(group).agg(count(same).alias("equal"), count(~same).alias("unequal"), count(F.col("a").isNull() != F.col("b").isNull()).alias("missing"), F.min(F.when(~same, F.col(ts))).alias("first_unequal"))
    zero = F.lit(0).cast("long")
    parts = parts.unionByName(ranges.select(group, F.col("n").alias("equal"), zero.alias("unequal"), zero.alias("missing"), F.lit(None).cast(dict(a.dtypes)[ts]).alias("first_unequal")))
    return parts.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("equal", "unequal", "missing")), F.min("first_unequal").alias("first_unequal"))


def spread_differences(a: DataFrame, b: DataFrame, group: str, ts: str, value: str) -> DataFrame:
    """Groups whose differences span more than one time."""
    met = both_versions(a, b, [group, ts], value).filter("in_a AND in_b AND NOT (a <=> b)")
    return met.groupBy(group).agg((F.max(ts) - F.min(ts)).alias("span")).filter("span > 0")


def differing_cells(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, width: int = scan.MONTH) -> DataFrame:
    """Cells of keys (group, time, ...) that both versions have with other values. Ranges of time with equal sums are left out before the join."""
    group, ts = keys[:2]
    equal = equal_ranges(a, b, group, keys[1:], ts, value, width)
    return both_versions(changed(a, equal, group, ts, width), changed(b, equal, group, ts, width), keys, value).filter("in_a AND in_b AND a <> b").select(*keys, "a", "b")


def odd_percentages(df: DataFrame, column: str) -> Column:
    """Whether a share of data is neither 0 nor 100."""
    return ~F.col(column).isin(0, 100)


def length_blocks(runs: DataFrame, start: str, length: str) -> DataFrame:
    """(block, length, first, last, runs): consecutive runs of one length, in the order of their starts."""
    dealt = scan.ranges(runs, F.col(start))
    marked = scan.numbered(dealt, [], [start], "block", F.col(length), lambda a, b: a != b)
    return marked.groupBy("block").agg(F.min(length).alias("length"), F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("runs"))


def attribute_changes(runs: DataFrame, start: str, attributes: str) -> DataFrame:
    """Rows (start, key, before, after) where an attribute of a map column differs from that of the run before."""
    long = runs.select(start, F.explode(attributes).alias("key", "after"))
    long = scan.beside(scan.ranges(long, F.col("key"), F.col(start)), ["key"], [start], {"before": F.col("after")})
    return long.filter("before IS NOT NULL AND NOT (before <=> after)").select(start, "key", "after", "before")
