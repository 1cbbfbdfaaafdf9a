"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is two aggregations and joins over the links; a written table cuts the lineage after each
round, and nothing but a count and a checksum comes to the driver. The number of rounds grows with the
logarithm of the longest chain. A node with a third of all links is only ever a partial minimum and a
joined key, which Spark splits where skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, temporary


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable), for each node of a link between different nodes.
    Null ends and self-links are ignored, repeated links count once; no links, no rows."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark = links.sparkSession
    edges, before = materialize(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before, last = state, edges
        with temporary(spark):
            both = edges.union(edges.select("v", "u"))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = materialize(large, "edges")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = materialize(moved.union(least).distinct(), "edges", keep=True)
        drop(last)
