"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runscope.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of numbers → ``(node, root)``: nodes of one component share a root.

    In each round every node moves to the smallest node, by a hash that changes with the round,
    within two steps, and the edges move along. A star becomes a point in one round, a path
    shrinks by a share, so the rounds grow with the logarithm of the nodes. All tables are written
    to the shared folder between rounds.
    """
    edges = written(_clean(edges), "edges")
    labels = None
    number = 0
    while not edges.isEmpty():
        number += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def order(name: str, salt: int = number) -> F.Column:
            return F.struct(F.xxhash64(F.lit(salt), name).alias("h"), F.col(name).alias("node"))

        near = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        near = near.select("node", F.least("m", order("node")).alias("m"))
        near = written(near, "near")
        # the smallest that any neighbour moves to
        far = both.join(near.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("far"))
        moved = written(
            far.join(near, "node").select("node", F.least("far", "m")["node"].alias("root")), "moved"
        )
        a = moved.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        b = moved.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        edges = written(
            _clean(edges.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "edges"
        )
        if labels is None:
            labels = moved
        else:
            step = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = written(
                labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels"
            )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
