"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (summed before its shuffle) and a join on the node, whose large partitions AQE can
split; nothing is gathered per node, so a hub with a third of all edges does no harm. Tables between the steps are
checkpointed, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge table, summed without overflow."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large star: every greater neighbour of a node goes to the node's least neighbour;
    small star: every lesser neighbour, and the node itself, do."""
    if large:
        around = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = checkpointed(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    met = around.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return checkpointed(out.where("u > v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); root is the least node of its component."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, before = checkpointed(pairs.distinct()), None
    while (now := _digest(edges)) != before and now[0]:
        before = now
        edges = _stars(_stars(edges, large=True), large=False)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
