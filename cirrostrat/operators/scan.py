"""Running values over long series in two passes: cut each key's rows into spans, reduce a span to a small carry, scan the carries, apply them inside spans.

A window by key alone sorts a whole series in one task. Here rows are windowed by key and span; what reaches further, as the last value held, the
number of a run or the reach of an interval, comes from the carries: one row for each key and span, which are joined back to the span's rows. Spans
without rows have no carry and change nothing. Rows whose order is null are a span of their own, before all others. Null keys are a key like any other.

`order` names the columns that order rows, of which the first one is what spans are cut by. Each function takes rows with `_span`, from `spans` or
`ranges`, and returns them with more columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cirrostrat.functions.times import seconds
from cirrostrat.runtime import stash

MONTH = 30 * 86400
FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def spans(df: DataFrame, at: str | Column, width: int = MONTH) -> DataFrame:
    """Rows by spans of `width` seconds of a time column, or units of a number."""
    return df.withColumn("_span", F.floor(seconds(at) / width))


def ranges(df: DataFrame, *order: Column) -> DataFrame:
    """Rows by ranges of a sort order, as many as there are shuffle partitions, where the values' spread isn't known beforehand. It is written once, so
    that a range stays as it is."""
    return stash(df.repartitionByRange(*order).withColumn("_span", F.spark_partition_id()), "ranges")


def inside(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    """The rows of one key and span, in order."""
    return Window.partitionBy(*keys, "_span").orderBy(*order)


def carry(df: DataFrame, keys: Sequence[str], summary: dict[str, Column], *scans: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """The rows with the columns of `scans`: window expressions over the spans of a key, in order, each one a row of `summary` aggregates. A later scan
    sees the columns of those before it."""
    w = Window.partitionBy(*keys).orderBy("_span")
    few = df.groupBy(*keys, "_span").agg(*(c.alias(n) for n, c in summary.items()))
    for one in scans:
        few = few.withColumns({n: c(w) for n, c in one.items()})
    own = {k: f"__k{i}" for i, k in enumerate((*keys, "_span"))}
    few = few.select(*(F.col(k).alias(n) for k, n in own.items()), *dict.fromkeys(n for one in scans for n in one))
    return df.join(few, [F.col(k).eqNullSafe(F.col(n)) for k, n in own.items()], "left").drop(*own.values())


def _exclusive(w: WindowSpec, forward: bool) -> WindowSpec:
    return w.rowsBetween(FIRST, -1) if forward else w.rowsBetween(1, LAST)


def held(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, Column], forward: bool = True) -> DataFrame:
    """By name, the last value that is not null up to a row, or the next one from it on."""
    at, w = F.struct(*order), inside(keys, *order)
    best, pick = (F.max_by, F.last) if forward else (F.min_by, F.first)
    summary = {f"__h{i}": best(v, F.when(v.isNotNull(), at)) for i, v in enumerate(values.values())}
    df = carry(df, keys, summary, {f"__c{i}": lambda s, i=i: pick(f"__h{i}", True).over(_exclusive(s, forward)) for i in range(len(values))})
    w = w.rowsBetween(FIRST, 0) if forward else w.rowsBetween(0, LAST)
    return df.withColumns({n: F.coalesce(pick(v, True).over(w), F.col(f"__c{i}")) for i, (n, v) in enumerate(values.items())}).drop(*(f"__c{i}" for i in range(len(values))))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, value: Column, fold: str = "sum", before: bool = False) -> DataFrame:
    """The sum or the maximum of a value up to a row, or up to the row before it; null where there is none."""
    one = {"sum": F.sum, "max": F.max}[fold]
    both = (lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))) if fold == "sum" else F.greatest
    df = carry(df, keys, {"__v": one(value)}, {"__c": lambda s: one("__v").over(_exclusive(s, True))})
    own = one(value).over(inside(keys, *order).rowsBetween(FIRST, -1 if before else 0))
    return df.withColumn(out, both(own, F.col("__c"))).drop("__c")


def beside(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """By name, values of the row before and of the row after; null at the ends."""
    before, after, at, w = before or {}, after or {}, F.struct(*order), inside(keys, *order)
    row = lambda values: F.struct(*(v.alias(n) for n, v in values.items()))
    sides = [(n, values, *of) for n, values, *of in (("__before", before, F.max_by, F.lag), ("__after", after, F.min_by, F.lead)) if values]
    df = carry(df, keys, {n: best(row(values), at) for n, values, best, _ in sides}, {n: lambda s, n=n, step=step: step(n).over(s) for n, _, _, step in sides})
    met = df.withColumns({n: F.coalesce(step(row(values)).over(w), F.col(n)) for n, values, _, step in sides})
    return met.withColumns({name: F.col(n)[name] for n, values, *_ in sides for name in values}).drop("__before", "__after")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, value: Column, begins: Callable[[Column, Column], Column]) -> DataFrame:
    """Number rows by pieces: 0 first, and one more at each row for which `begins` holds of the value before and its own."""
    at, w = F.struct(*order), inside(keys, *order)
    flag = lambda a, b: F.coalesce(begins(a["x"], b["x"]).cast("long"), F.lit(0).cast("long"))
    df = df.withColumn("__x", F.struct(value.alias("x")))
    df = df.withColumn("__b", flag(F.lag("__x").over(w), F.col("__x")))
    # What stood before a span, and so whether a piece begins with it, is known to the carries only.
    summary = {"__s": F.sum("__b"), "__f": F.min_by("__x", at), "__l": F.max_by("__x", at)}
    edge = {"__e": lambda s: flag(F.lag("__l").over(s), F.col("__f"))}
    ahead = {"__o": lambda s: F.coalesce(F.sum(F.col("__s") + F.col("__e")).over(_exclusive(s, True)), F.lit(0)) + F.col("__e")}
    df = carry(df, keys, summary, edge, ahead)
    return df.withColumn(out, F.col("__o") + F.sum("__b").over(w.rowsBetween(FIRST, 0))).drop("__x", "__b", "__e", "__o")


def near(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows: int, size: int = 100_000) -> DataFrame:
    """Rows by pieces (`_span`) of their number `_n` in the series. Rows within `rows` of another piece stand there as well, not `_own`, so that a window
    over so many rows on each side can be partitioned by piece."""
    df = running(df, keys, order, "_n", F.lit(1).cast("long")).drop("_span")
    size = max(size, 4 * rows)
    pieces = F.array_distinct(F.array(*(F.floor((F.col("_n") + d) / size) for d in (-rows, 0, rows))))
    return df.withColumn("_span", F.explode(pieces)).withColumn("_own", F.col("_span") == F.floor(F.col("_n") / size))
