"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node.

    Rounds of two steps until nothing changes: each node takes the smallest label
    around it (a partial aggregation), then the label of its label, which halves
    the way to the root. Labels stay in tables; each round is written to the
    checkpoint folder. Joins on a hot label are plain equality joins, which
    adaptive execution splits.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a <> b").distinct())
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("seen").alias("near"))
        )
        taken = labels.join(around, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        up = taken.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = materialize(
            taken.join(up, "root").select("node", "old", F.least("root", "up").alias("root"))
        )
        labels = jumped.select("node", "root")
        if jumped.filter("old <> root").isEmpty():
            return labels
