"""Connected components of a link table by alternating large and small stars, each round a join and written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustloom.llm.common import scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v. Large: neighbours above u go to the smallest of u's neighbourhood; small: those below, and u itself."""
    if large:
        near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.where("v > u")
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        centre = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.union(near.select("u", F.col("u").alias("v")))
    return moved.join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Each node that points has one target, and no target points."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("points")).union(links.select(F.col("v").alias("node"), F.lit(0).alias("points")))
    odd = ends.groupBy("node").agg(F.sum("points").alias("n"), F.min("points").alias("least")).where("n > 1 OR (n = 1 AND least = 0)")
    return odd.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, label for each node of links (u, v): label is the smallest node it is connected with.

    Nodes that no link touches have no row; an empty table gives an empty one. Loops of u with itself don't count.
    """
    now = scratch(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    while not _is_forest_of_stars(now):
        now = scratch(_star(_star(now, large=True), large=False).distinct(), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
