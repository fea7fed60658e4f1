"""Links of web pages, and what kind of parser accepts a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def links(pages: DataFrame, pattern: str = ".*", path_pattern: str | None = None, query_pattern: str | None = None, key: str = "page_id") -> DataFrame:
    """(page_id, href, text, scheme, netloc, path, query, fragment): the first link of each href in a page, absolute or not."""
    found = pages.select(key, F.posexplode(F.expr(r"regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"[^>]*>([^<]*)', 0)")).alias("at", "tag"))
    found = found.select(key, "at", F.regexp_extract("tag", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("tag", r">([^<]*)$", 1).alias("text")).filter(F.col("href").rlike(pattern))
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy(key, "href").orderBy("at"))).filter("_r = 1")
    part = lambda p, k=1: F.regexp_extract("href", p, k)
    out = first.select(key, "href", "text", part(r"^([A-Za-z][\w+.-]*):").alias("scheme"), part(r"^(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)").alias("netloc"), part(r"^(?:(?:[A-Za-z][\w+.-]*:)?//[^/?#]*)?([^?#]*)").alias("path"), part(r"\?([^#]*)").alias("query"), part(r"#(.*)$").alias("fragment"))
    if path_pattern:
        out = out.filter(F.col("path").rlike(path_pattern))
    return out.filter(F.col("query").rlike(query_pattern)) if query_pattern else out


def accepting(df: DataFrame, parsers: dict[str, Column]) -> DataFrame:
    """`parsers`: the sorted names of those whose condition holds; `failed` where there is none."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in sorted(parsers.items()))))
    return df.withColumn("parsers", names).withColumn("failed", F.size("parsers") == 0)
