"""Connected components by joins: smallest label over neighbours, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, store


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node reachable.

    Each round gives a node the least label of itself and its neighbours, then the label of its label. A node's edges
    are only ever reduced by min, which is summed up before the shuffle, so a node with very many edges is no hot task.
    """
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    held = labels
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = store(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        changed = after.filter("was <> root").limit(1).count()
        discard(held)
        held, labels = after, after.select("node", "root")
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
