"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected as often as its source's target asks: target / size of the source. Documents are
numbered in classes of like size, at random within a class; their expected copies are summed up along that order, one
random offset is added, and a document is emitted once for each integer that its stretch of the sum crosses. So every
class is taken in its share, and the words that are taken miss the target by about the size of one long document, and by
less as the offset is the best of a few random ones. Numbering is a range partition and partition counts, so a source may
hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import spare, store

WEIGHTS = (1, 2, 3)
#: Most times that a source, and so a document, is taken.
MOST = 3
#: Random offsets of which each source takes the one whose words come nearest to its target.
OFFSETS = 32


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 0 in that order, by range partitions and their counts."""
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part, at = spare(rows, "part"), spare(rows, "at")
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = store(dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(name))
    return dealt.join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col(at)).drop(part, at)


def _level(sources: DataFrame, most: int) -> float:
    """The words of one unit of weight, after the excess of sources above their bound has been shared out."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    level, bound = 0.0, None
    while True:
        over = F.col("size") * most < F.col("weight") * F.lit(level)
        row = sources.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("size") * most)), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if row.n == bound or not row.weight:
            return level
        level, bound = (total - row.held) / row.weight, row.n


def _offset(seed: int, source: Column, j: int) -> Column:
    said = F.concat(F.lit(f"{seed}:{j}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _copies(offset: Column) -> Column:
    """Integers that a document's stretch of the running sum of expected copies crosses."""
    return (F.floor(F.col("_rate") * (F.col("_nth") + 1) + offset) - F.floor(F.col("_rate") * F.col("_nth") + offset)).cast("long")


def _mix(docs: DataFrame, carry: list[str], weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """carry and _source, _size, _source_size, _target, _copies of every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(c) for c in carry], F.col("doc_id").alias("_id"), F.col("source").alias("_source"), size.alias("_size"), F.xxhash64("text").alias("_print"), F.monotonically_increasing_id().alias("_row"))
    drawn = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary"))
    order = [F.col("_source").asc_nulls_last(), F.length(F.bin("_size")), drawn, F.col("_size"), F.col("_print"), F.col("_row")]
    rows = numbered(rows, order, "_place").drop("_print", "_row")
    sources = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.min("_place").alias("start"))
    sources = numbered(sources, [F.col("_source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = store(sources.withColumn("weight", weight.cast("long")), "sources")
    level = _level(sources, most)
    target = F.least(F.col("weight") * F.lit(level), (F.col("size") * most).cast("double"))
    sources = sources.select(F.col("_source").alias("_s"), F.col("size").alias("_source_size"), target.alias("_target"), "start")
    sources = store(sources.withColumn("_rate", F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)), "targets")

    joined = rows.join(sources, rows["_source"].eqNullSafe(sources["_s"])).withColumn("_nth", F.col("_place") - F.col("start"))
    offsets = [_offset(seed, F.col("_source"), j) for j in range(OFFSETS)]
    words = joined.groupBy("_source").agg(F.first("_target").alias("_target"), *[F.sum(F.col("_size") * _copies(F.lit(0.0) + u)).alias(f"w{j}") for j, u in enumerate(offsets)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{j}") - F.col("_target")).alias("d"), F.lit(j).alias("j"), u.alias("u")) for j, u in enumerate(offsets)]))
    chosen = store(words.select(F.col("_source").alias("_c"), nearest["u"].alias("_u")), "offsets")
    joined = joined.join(chosen, joined["_source"].eqNullSafe(chosen["_c"]))
    return joined.select(*carry, "_source", "_size", "_source_size", "_target", _copies(F.col("_u")).alias("_copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of docs(doc_id, text, source).

    size: words of the text (null: 0). Sources, by code point and null last, weigh `weights` in turn; targets share the
    size of all documents by weight, but for what is above `most` times a source's size, which the others share. A
    document is taken whole, 0 to `most` times; taken is its size times its copies. The same rows and seed give the same
    result on any number of partitions.

    Null is a source of its own. Rows under one id, repeated rows and null ids are rows of their own. A text of any length
    is counted whole. A source without words has target 0 and copies 0. An empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    out = _mix(docs.select("doc_id", "text", "source"), ["doc_id"], weights, most, seed)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of the mix themselves, each as often as it is taken, with all their columns; rules as in `mix`.

    Columns may have any name that does not start with an underscore followed by one of this module's own names.
    """
    names = {c: f"_kept{i}" for i, c in enumerate(docs.columns)}
    held = docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(k) for c, k in names.items()])
    out = _mix(held, list(names.values()), weights, most, seed)
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col(k).alias(c) for c, k in names.items()])
