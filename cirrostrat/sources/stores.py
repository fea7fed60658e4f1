"""Stores: tables by field, versions of metadata, reading a span of time, text export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store_by_field(df: DataFrame, path: str, field: str = "field", mode: str = "append", ts: str | None = None, files: int | None = None) -> None:
    """Parquet in a folder for each field; rows of a field are gathered first, so that each gets few files, and large fields still get many. With `ts`, a file
    holds a range of times (of about one in `files` of all rows), in order, so that reading a span opens few of them."""
    if ts is None:
        dealt = df.hint("rebalance", field)
    else:
        dealt = (df.repartitionByRange(files, field, ts) if files else df.repartitionByRange(field, ts)).sortWithinPartitions(field, ts)
    dealt.write.mode(mode).partitionBy(field).parquet(path)


def store_version(df: DataFrame, path: str, version: str) -> None:
    """Add or replace one version (yyyymmdd) of a table; other versions stay."""
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The last version; only its folder is read."""
    df = spark.read.parquet(path)
    last = df.agg(F.max("version")).first()[0]
    return df.filter(F.col("version") == F.lit(last)).drop("version")


def read_span(spark: SparkSession, path: str, field: str | None = None, first: object = None, last: object = None, ts: str = "t") -> DataFrame:
    """Rows of a field from `first` to `last`, both included. The field prunes folders, the times are pushed down to the files."""
    df = spark.read.parquet(path)
    if field is not None:
        df = df.filter(F.col("field") == field)
    if first is not None:
        df = df.filter(F.col(ts) >= F.lit(first))
    return df.filter(F.col(ts) <= F.lit(last)) if last is not None else df


def text_table(df: DataFrame, columns: Sequence[str], separator: str = "|") -> DataFrame:
    """`line`: the columns joined, nulls empty, for write.text."""
    return df.select(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))


def append_result(spark: SparkSession, row: dict, path: str) -> None:
    """Add one row of an experiment's figures to a table."""
    spark.createDataFrame([row]).coalesce(1).write.mode("append").parquet(path)
