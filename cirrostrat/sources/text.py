"""Readers of the text formats of stations, soundings, indexes and flight lines. Missing markers become null here and nowhere else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrostrat.operators import scan

RAW = "s_cod string, datetime timestamp, min double, ave double, max double, data_pc double"


def cleaned(value: Column, *missing: float) -> Column:
    """Null for the given markers and for not-a-number."""
    return F.when(~value.isin(*missing) & ~F.isnan(value), value) if missing else F.when(~F.isnan(value), value)


def raw_csv(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Sensor records: lines that begin with # are comments, there is no header, wholly empty columns were dropped by the writer. The order of rows is
    that of their times wherever it is asked for; a file is read in parallel."""
    df = spark.read.schema(RAW).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    return df.select(*(names or df.columns))


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that have no value in any row; one pass of counts."""
    n = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if n[c]))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line, _span) with the number of each line in its file, whatever line ends it has; empty lines are left out. Large files are read in byte
    ranges by many tasks. Lines of a range are counted as they come, and numbers go on from the counts of the ranges before, so no line is shuffled.
    `_span` is where a line's range begins, for the scans of `operators.scan`."""
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_span")
    read = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    ranges = read.groupBy("file", "_span").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("file").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "_span", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_to_n"))
    return read.join(ranges, ["file", "_span"]).select("file", (F.col("_id") + F.col("_to_n")).alias("n"), "line", "_span").filter(F.col("line") != "")


def logger_file(spark: SparkSession, path: str, header: int = 1, skip: Sequence[int] = (0, 2, 3)) -> DataFrame:
    """(file, ts, name, value) of files with rows of names and units before the data; the first column is the time."""
    rows = lines(spark, path).withColumn("parts", F.split(F.regexp_replace("line", '"', ""), ","))
    names = rows.filter(F.col("n") == header).select("file", F.posexplode("parts").alias("at", "name"))
    data = rows.filter(~F.col("n").isin(header, *skip))
    cells = data.select("file", F.try_to_timestamp(F.col("parts")[0]).alias("ts"), F.posexplode("parts").alias("at", "value")).filter("at > 0 AND ts IS NOT NULL")
    return cells.join(names, ["file", "at"]).select("file", "ts", "name", F.expr("try_cast(value AS double)").alias("value"))


def fixed_width(line: Column, fields: Sequence[tuple[str, int, int, str]]) -> list[Column]:
    """Columns (name, first, length, type) of a line; blanks are null."""
    cut = lambda a, n: F.nullif(F.trim(F.substring(line, a + 1, n)), F.lit(""))
    return [(cut(a, n) if kind == "string" else cut(a, n).try_cast(kind)).alias(name) for name, a, n, kind in fields]


def daily_file(spark: SparkSession, path: str, missing: int = -9999) -> DataFrame:
    """(station, field, date, value, mflag, qflag, sflag): one line a month with 31 days of value and flags; days that don't exist or hold nothing are left out."""
    text = spark.read.text(path)
    head = fixed_width(F.col("value"), [("station", 0, 11, "string"), ("year", 11, 4, "int"), ("month", 15, 2, "int"), ("field", 17, 4, "string")])
    days = text.select("value", *head).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(31))))
    at = 22 + (F.col("day") - 1) * 8
    part = lambda a, n: F.substring(F.col("value"), at + a, F.lit(n))
    flag = lambda a: F.nullif(F.trim(part(a, 1)), F.lit(""))
    out = days.select("station", "field", F.try_make_timestamp("year", "month", "day", F.lit(0), F.lit(0), F.lit(0.0)).cast("date").alias("date"), F.nullif(F.trim(part(0, 5)).try_cast("int"), F.lit(missing)).cast("double").alias("v"), flag(5).alias("mflag"), flag(6).alias("qflag"), flag(7).alias("sflag"))
    return out.filter("date IS NOT NULL AND v IS NOT NULL").withColumnRenamed("v", "value")


STATION_LIST = (("id", 0, 11, "string"), ("lat", 12, 8, "double"), ("lon", 21, 9, "double"), ("elev", 31, 6, "double"), ("state", 38, 2, "string"), ("name", 41, 30, "string"))


def station_list(spark: SparkSession, path: str, fields: Sequence[tuple[str, int, int, str]] = STATION_LIST) -> DataFrame:
    """A list of stations by column positions, with the number in each id."""
    out = spark.read.text(path).select(*fixed_width(F.col("value"), fields))
    return out.withColumn("number", F.nullif(F.regexp_extract("id", r"(\d+)", 1), F.lit("")).try_cast("long"))


HEADER = (("station", 0, 11, "string"), ("year", 12, 4, "int"), ("month", 17, 2, "int"), ("day", 20, 2, "int"), ("hour", 23, 2, "int"), ("n_levels", 31, 4, "int"))
LEVEL = (("lvltyp1", 0, 1, "int"), ("lvltyp2", 1, 1, "int"), ("p", 9, 6, "double"), ("gph", 16, 5, "double"), ("temp", 22, 5, "double"), ("rh", 28, 5, "double"), ("dpdp", 34, 5, "double"), ("wdir", 40, 5, "double"), ("wspd", 46, 5, "double"))


def soundings(spark: SparkSession, path: str) -> DataFrame:
    """(station, ts, at, levels' columns): archives in which a # line heads the levels of one sounding. Records are cut at line feeds that # follows, so
    one long archive is read by many tasks."""
    records = spark.read.option("lineSep", "\n#").text(path).select(F.ltrim(F.col("value"), F.lit("#")).alias("value")).filter(F.trim("value") != "")
    parts = records.select(F.split(F.regexp_replace("value", r"\s+$", ""), "\n").alias("rows"))
    head = parts.select(*fixed_width(F.col("rows")[0], HEADER), F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("at", "line"))
    ts = F.try_make_timestamp("year", "month", "day", F.when(F.col("hour") == 99, 0).otherwise(F.col("hour")), F.lit(0), F.lit(0.0))
    out = head.select("station", ts.alias("ts"), "at", *fixed_width(F.col("line"), LEVEL))
    number = [n for n, _, _, kind in LEVEL if kind == "double"]
    return out.withColumns({n: F.when(~F.col(n).isin(-9999.0, -8888.0), F.col(n)) for n in number})


def monthly_soundings(spark: SparkSession, path: str, stations: Sequence[str] | None = None, missing_level: int = 9999) -> DataFrame:
    """(station, month, level, value, n, hour, variable) of white-space tables; hour and variable from names like `temp_00z.txt`."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.col("_metadata.file_name").alias("name"))
    c = lambda k, kind: F.get("c", F.lit(k)).try_cast(kind)
    out = rows.select(c(0, "string").alias("station"), F.make_date(c(1, "int"), c(2, "int"), F.lit(1)).alias("month"), F.nullif(c(3, "int"), F.lit(missing_level)).alias("level"), c(4, "double").alias("value"), c(5, "int").alias("n"), F.nullif(F.regexp_extract("name", r"_(\d\d)z", 1), F.lit("")).try_cast("int").alias("hour"), F.regexp_extract("name", r"^([A-Za-z]+)_", 1).alias("variable"))
    return out.filter(F.col("station").isin(list(stations))) if stations is not None else out


def index_table(spark: SparkSession, path: str, missing: Sequence[float] = (-99.99, -99.9, -999.9)) -> DataFrame:
    """(file, block, month, value) of tables with a year and twelve months a line. Other lines are headers and footers; where years
    don't go on by one a new block begins, as in files that stack several tables."""
    rows = lines(spark, path).filter(F.col("line").rlike(r"^\s*\d{4}(\s+-?[\d.]+){12}\s*$")).withColumn("c", F.split(F.trim("line"), r"\s+"))
    rows = rows.withColumn("year", F.col("c")[0].cast("int"))
    rows = scan.numbered(rows, ["file"], ["n"], "block", F.col("year"), lambda a, b: b != a + 1)
    long = rows.select("file", "block", "year", F.posexplode(F.slice("c", 2, 12)).alias("m", "v"))
    value = F.col("v").cast("double")
    return long.select("file", "block", F.make_date("year", F.col("m") + 1, F.lit(1)).alias("month"), cleaned(value, *missing).alias("value")).filter("value IS NOT NULL")


def blocks_by_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, n, line, block): a new block begins where lines change between matching a pattern and not."""
    rows = scan.numbered(lines(spark, path), ["file"], ["n"], "block", F.col("line").rlike(kind), lambda a, b: a != b)
    return rows.drop("_span")


def flight_lines(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """Columns of the schema and `ts`. Files with a column `sod` alone take the date from eight digits of the file name; those with year, doy and sod carry
    it. Longitudes over 180 are wrapped."""
    df = spark.read.schema(schema).option("comment", "#").option("sep", separator).option("ignoreLeadingWhiteSpace", True).csv(path)
    base = F.make_date("year", F.lit(1), F.lit(1)) + (F.col("doy") - 1) if "doy" in df.columns else F.try_to_timestamp(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")
    out = df.withColumn("ts", F.timestamp_seconds(F.unix_date(base).cast("double") * 86400 + F.col("sod")))
    return out.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))


def hemisphere_number(text: Column) -> Column:
    """A coordinate with N, S, E or W behind it; south and west are negative."""
    size = F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double")
    return F.when(F.upper(F.right(F.trim(text), F.lit(1))).isin("S", "W"), -size).otherwise(size)


def year_month_table(spark: SparkSession, path: str, missing: str = "-") -> DataFrame:
    """(file, month, value) of lines with a year and twelve white-space cells, `-` being missing."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), r"\s+").alias("c")).filter(F.size("c") >= 13)
    long = rows.select("file", F.col("c")[0].try_cast("int").alias("year"), F.posexplode(F.slice("c", 2, 12)).alias("m", "v")).filter(F.col("year").isNotNull() & (F.col("v") != missing))
    return long.select("file", F.make_date("year", F.col("m") + 1, F.lit(1)).alias("month"), F.col("v").try_cast("double").alias("value")).filter("value IS NOT NULL")


def hourly_basin_table(spark: SparkSession, path: str, missing: Sequence[str] = ("-6999", "-6934", "-7002.7", "#NUM!", "NAN", ""), start: str = "DateTime") -> DataFrame:
    """(file, ts, name, value) of tables whose header is the line that begins with `start`, whatever line ends they have; what can't be read as
    a time is left out."""
    rows = lines(spark, path)
    heads = rows.filter(F.col("line").startswith(start)).groupBy("file").agg(F.min_by(F.struct("n", "line"), "n").alias("h")).select("file", F.col("h.n").alias("hn"), F.split("h.line", ",").alias("names"))
    data = rows.join(heads, "file").filter("n > hn").withColumn("c", F.split("line", ","))
    cells = data.select("file", F.try_to_timestamp(F.col("c")[0]).alias("ts"), F.posexplode(F.arrays_zip("names", "c")).alias("at", "x")).filter("at > 0 AND ts IS NOT NULL")
    return cells.select("file", "ts", F.col("x.names").alias("name"), F.when(~F.coalesce(F.trim("x.c"), F.lit("")).isin(list(missing)), F.trim("x.c")).try_cast("double").alias("value"))


def merged_variants(df: DataFrame, name: str, variants: Sequence[str]) -> DataFrame:
    """One column from several spellings, of which a row may fill one; rows that fill more make this raise when they are read."""
    present = [v for v in variants if v in df.columns]
    filled = sum((F.col(v).isNotNull().cast("int") for v in present), F.lit(0))
    value = F.when(filled <= 1, F.coalesce(*map(F.col, present))).otherwise(F.raise_error(F.concat(F.lit(f"several values for {name}"))).cast(dict(df.dtypes)[present[0]]))
    return df.withColumn("_m", value).drop(*present).withColumnRenamed("_m", name)
