"""Iterations by joins, with their lineage cut in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one is made, but only for a local session."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="albumen-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once: written to the shared folder and read back, so that what follows knows its size and a lost
    executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): the least node reachable over edges(a, b), each given in both directions."""
    labels = nodes.select("node", F.col("node").alias("label"))
    edges = cut(edges)
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = cut(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = after.select("node", "label")
        if not after.filter("was <> label").limit(1).count():
            return labels
    raise RuntimeError("no fixed point")
