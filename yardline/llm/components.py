"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """``id, component_id`` of every vertex of ``edges`` (columns ``a``, ``b``); a component's id is its least vertex.

    Each round points every vertex to its least neighbour, follows one more
    pointer, and contracts the edges. Vertices that are not their own target
    vanish, so rounds grow with the logarithm of the longest path. A vertex
    with very many edges is combined before the shuffle.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = stored(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component_id", F.col("id")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        target = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        next_ = target.select(F.col("a").alias("m"), F.col("m").alias("m2"))
        target = stored(target.join(next_, "m").select(F.col("a").alias("v"), F.col("m2").alias("t")))
        labels = stored(
            labels.join(target, F.col("component_id") == F.col("v"), "left").select("id", F.coalesce("t", "component_id").alias("component_id"))
        )
        left = target.select(F.col("v").alias("a"), F.col("t").alias("x"))
        right = target.select(F.col("v").alias("b"), F.col("t").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = stored(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return labels
