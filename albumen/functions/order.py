"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.iterate import cut


def ranges(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """df in order of key, with _part and _at: the range partition of a row and its place there. Bounds come from a sample of
    the keys, so ranges hold about as many rows each however the keys lie."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.desc(key) if descending else F.asc(key)
    dealt = df.repartitionByRange(n, order).sortWithinPartitions(order)
    return cut(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))


def dense_positions(df: DataFrame, key: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """df with 1-based positions by a unique key. Ranges get offsets from their counts: one row for each is ever gathered."""
    dealt = ranges(df, key, descending)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
