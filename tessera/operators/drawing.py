"""Frames for drawing: what a plot needs, without plotting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import linalg


def communities(edges: DataFrame, layout: DataFrame, partition: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with place, community and size; edges once each with both places) of a laid-out subgraph.

    Sizes are 15 and 220 times the node's share of the largest score.
    """
    top = scores.join(layout.select("id"), "id", "left_semi").agg(F.max("score").alias("_top"))
    nodes = layout.join(partition, "id", "left").join(scores, "id", "left").crossJoin(F.broadcast(top))
    size = 15 + 220 * F.coalesce(F.col("score") / F.when(F.col("_top") > 0, F.col("_top")), F.lit(0.0))
    nodes = nodes.select("id", "x", "y", "community", size.alias("size"))
    ends = [layout.select(F.col("id").alias(a), F.col("x").alias(f"x_{a}"), F.col("y").alias(f"y_{a}")) for a in ("src", "dst")]
    once = edges.where(F.col("src").cast("string") < F.col("dst").cast("string"))
    return nodes, once.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", "x_src", "y_src", "x_dst", "y_dst")


def plane(points: DataFrame, labels: DataFrame, width: int, key: str = "id") -> DataFrame:
    """(key, x, y, cluster): points on their first two principal components, with their labels."""
    means = [F.avg(F.col("features")[k]).alias(f"m{k}") for k in range(width)]
    centre = points.agg(F.array(*means).alias("_centre"))
    centred = points.crossJoin(F.broadcast(centre)).select(key, F.zip_with("features", "_centre", lambda a, b: a - b).alias("features"))
    _, vectors, _ = linalg.pca(centred, width)
    on = linalg.project(centred, vectors, 2, key)
    return on.join(labels, key).select(key, F.col("projected")[0].alias("x"), F.col("projected")[1].alias("y"), "cluster")
