"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._stage import Stage


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """node, comp: for every node of the edges (a, b), the smallest node that it reaches.

    Each round takes the smallest label among a node and its neighbours, then the label of
    that label; the rounds grow with the logarithm of the longest path. A node with very many
    edges is pre-aggregated before each shuffle.
    """
    both = stage.table(f"{name}-edges", edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stage.table(f"{name}-0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    at = 0
    while True:
        seen = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = label.join(seen, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("comp").alias("top"))
        new = low.join(up, "low").select("node", F.least("low", "top").alias("comp"), (F.least("low", "top") != F.col("comp")).alias("moved"))
        at += 1
        new = stage.table(f"{name}-{at}", new)
        stage.drop(f"{name}-{at - 1}")
        label = new.select("node", "comp")
        if not new.filter("moved").limit(1).count():
            return label
