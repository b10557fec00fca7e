"""Connected components by alternating large-star and small-star steps.

Both steps replace edges by edges to smaller vertices: the large star of u links its larger neighbours to
its smallest one, the small star links its smaller ones and u itself. They end at stars around the smallest
vertex of each component after about log(vertices) rounds, also on long chains. A vertex with a third of all
edges is one group of a partial aggregation and one key of a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialised


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) with u > v, one row an edge; returns such rows."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``links`` (a, b); the component is its smallest vertex."""
    edges = materialised(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        edges = materialised(_star(_star(edges, large=True), large=False), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
