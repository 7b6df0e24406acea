"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize


def components(links: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """Every node that has a link, with the smallest node it reaches: ``(node, component)``.

    Large-star and small-star steps in turn (each node hands its neighbours to
    the smallest node it knows) until the links are stars. A step shuffles the
    links once or twice; hubs are split by their number of links, and every
    step is a written table. Links that are stars already take no step. Self-links
    are ignored; nulls are not allowed.
    """
    edges = _written(links.select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b")))
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = _smallest(both)
        large = join_counted(both, stars, "a", "fan_in").filter("b > a")
        large = _written(large.select(F.col("b").alias("a"), F.col("root").alias("b")))
        stars = _smallest(large)
        small = join_counted(large, stars, "a", "fan_in").select(F.col("b").alias("a"), F.col("root").alias("b"))
        edges = _written(small.unionByName(stars.select("a", F.col("root").alias("b"))))
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link and is the smaller end of none, so that no step would change a thing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("links"), F.lit(False).alias("is_root"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("links"), F.lit(True).alias("is_root")))
    told = ends.groupBy("node").agg(F.sum("links").alias("links"), F.bool_or("is_root").alias("is_root"))
    return told.filter("links > 1 or (links > 0 and is_root)").isEmpty()


def _written(edges: DataFrame) -> DataFrame:
    return materialize(edges.filter("a <> b").distinct())


def _smallest(edges: DataFrame) -> DataFrame:
    least = F.least("a", F.min("b")).alias("root")
    return materialize(edges.groupBy("a").agg(least, F.count("*").alias("fan_in")))
