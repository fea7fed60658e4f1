"""Connected components of a table of links, by alternating large stars and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.runtime import drop_stash, stash


def _distinct(links: DataFrame) -> DataFrame:
    return stash(links.filter("u != v").distinct(), "links")


def _stars(links: DataFrame) -> bool:
    """Whether each u has one v only, and no v is a u as well."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the smallest node that it reaches. Links with a null end are left out, and
    one from a node to itself gives no row. The number of rounds grows with the logarithm of the longest chain. Minima are combined before
    the shuffle, and the joins are on plain keys, which Spark splits where one is frequent."""
    links = _distinct(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written before the join, so that both of its sides are plain shuffles and Spark can split a hub's links.
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.filter("u != v"), "large")
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        used, links = (links, least, large, low), _distinct(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        for df in used:
            drop_stash(df)
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of nodes 0 to n - 1 that each one reaches through links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label
