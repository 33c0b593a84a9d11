"""Lineage cuts and connected components, shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later jobs read it there and do not recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge list; root is the smallest node that it reaches.

    Alternates large-star and small-star rounds until no edge changes: a round only ever moves edges to smaller
    nodes, so it ends, after a number of rounds that grows with the logarithm of a component's size. Each round takes minima by
    node with partial aggregation before the shuffle and joins them back, so that a node with very
    many neighbours is a skewed join, which adaptive execution splits, and not one large group.
    """
    pairs = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = cut(small.where("u <> v").distinct())
        state = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    return pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
