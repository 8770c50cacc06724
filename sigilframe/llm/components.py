"""Connected components of a table of links, by alternating large and small stars.

Each round ties a node's larger neighbours to its smallest one, then its smaller ones likewise; every component ends as
a star around its smallest node, after a number of rounds that grows with the logarithm of its diameter. Minima are taken before
the shuffle, and each round's links are stored in the shared folder. Nothing but two numbers a round reaches the driver.
A hot star's links are read by several tasks where Spark's skew handling is on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the smallest node of its component. Links may repeat;
    links with a null end or to the node itself count for nothing."""
    e = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    was = None
    while (now := _mark(e)) != was:
        was = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = _with_least(large, least)
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        e = stored(small.distinct(), "links")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def _with_least(e: DataFrame, least: DataFrame) -> DataFrame:
    """Links with the minimum of their u. A side that leaves an aggregate by u would stay as it is dealt, and then neither side can be split; with
    a hash of u as a second key both are dealt for the join itself, minima by one row a node, so that a hot node's links can be."""
    twin = F.xxhash64("u").alias("twin")
    return e.select("u", "v", twin).join(least.select("u", "m", twin), ["u", "twin"])


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
