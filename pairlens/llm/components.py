"""Connected components by alternating large-star and small-star steps.

Both steps replace a node's edges by edges to the smallest node around it; no neighbourhood is ever collected.
Each step is written to the shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.session import new_state_path


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b: long); component is the smallest node.

    Loops, repeated edges and edges with a null end don't matter. Nodes that only have loops are left out.
    """
    spark, folder = edges.sparkSession, new_state_path(edges.sparkSession, "components")
    edges = (edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges.write.parquet(f"{folder}/0")
    step, before = 0, None
    while True:
        edges = spark.read.parquet(f"{folder}/{step}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.col("b").cast("decimal(20, 0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, step = state, step + 1
        _large_star(edges).distinct().write.parquet(f"{folder}/{step}l")
        _small_star(spark.read.parquet(f"{folder}/{step}l")).distinct().write.parquet(f"{folder}/{step}")
