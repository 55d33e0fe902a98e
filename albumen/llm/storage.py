"""Scratch tables in the folder that all executors share.

Lineage is cut by writing a table there and reading it back, so a lost executor costs a re-read and never the work
before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one is set, but only for a local session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="albumen-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spare(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/albumen-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new scratch table and reads it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "scratch_path", None)):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs send their Python workers that many rows at once: long texts then take less memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
