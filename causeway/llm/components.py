"""Connected components of a link table, by alternating large and small stars; nothing of it goes to the driver but a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: neighbours above u go to the least of u and its neighbours. Small star: u and its neighbours below it go to the least of those."""
    near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) if small else _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if not small:
        least = least.select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v: any bigints, either order, repeats allowed) -> (node, component) of every node that occurs, component being its least node.

    Rounds grow with the logarithm of the longest path. A node of very many links only meets map-side minima and a join
    that adaptive execution may split. No links give no rows; self-links and nulls are ignored.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        edges = written(_star(_star(edges, small=False), small=True), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
