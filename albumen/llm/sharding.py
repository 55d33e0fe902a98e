"""Balanced label propagation: documents with equal texts move to one shard under row quotas. DataFrame functions only.

Linked documents hang on their text's hash. In each round a text's documents look at where the others are and move to
the best-liked shard that still has room; a text that fills several shards gets several. Moves are settled on (text,
shard) counts, not on rows, so a text with a third of all rows is a few cells. At the end a linked document's shard is
its label; only what a label has above the shard's quota moves on, whole texts where possible, and documents that
nothing is linked with fill up what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, store

SHARDS = 24
ROUNDS = 3
#: Room of a shard while labels move, above its even share.
SLACK = 1.02


def _described(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit(11), text).alias("l"))


def _propagate(rows: DataFrame, shards: int, rounds: int) -> DataFrame:
    """(k, l, label, n): how many documents of each text are on each label, after moving under quotas."""
    cells = store(rows.groupBy("k", "l", F.pmod(F.xxhash64("doc_id", "k"), F.lit(shards)).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")), "cells")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    room_of = max(1.0, SLACK * total / shards)
    linked = cells.join(cells.groupBy("k", "l").agg(F.sum("n").alias("of")).filter("of > 1"), ["k", "l"])
    alone = store(cells.join(linked.select("k", "l").distinct(), ["k", "l"], "left_anti").select("k", "l", "label", "n"), "alone")
    cells = store(linked.select("k", "l", "label", "n"), "linked")
    for turn in range(rounds):
        every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("label"))
        load = every.join(cells.groupBy("label").agg(F.sum("n").alias("load")), "label", "left").select("label", F.coalesce("load", F.lit(0)).alias("load"))
        # a text's homes: the labels of most of its documents, among equals the emptiest; one, or as many as it fills
        liked = cells.join(F.broadcast(load), "label")
        order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "load", F.xxhash64("k", F.lit(turn), "label").alias("h"), "label")))  # `shards` entries at most
        homes = liked.groupBy("k", "l").agg(F.transform(F.slice(order, F.lit(1), F.ceil(F.sum("n") / room_of).cast("int")), lambda x: x["label"]).alias("homes"))
        moves = cells.join(homes, ["k", "l"]).withColumn("at_home", F.array_contains("homes", F.col("label")))
        away = F.get("homes", F.pmod(F.xxhash64("label", F.lit(turn), "k"), F.size("homes")).cast("int"))
        moves = moves.withColumn("aim", F.when(F.col("at_home"), F.col("label")).otherwise(away)).withColumn("asks", F.when(F.col("at_home"), 0).otherwise(F.col("n"))).drop("homes", "at_home")
        asked = moves.groupBy("aim").agg(F.sum("asks").alias("asked"))
        left = moves.groupBy("label").agg(F.sum("asks").alias("left"))
        # each shard lets in the same share of what every text asks for, up to its room
        grant = load.join(left, "label", "left").join(asked.withColumnRenamed("aim", "label"), "label", "left").select(F.col("label").alias("aim"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(room_of) - F.col("load") + F.coalesce("left", F.lit(0))) / F.greatest(F.coalesce("asked", F.lit(0)), F.lit(1)))).alias("share"))
        moved = moves.join(F.broadcast(grant), "aim").withColumn("go", F.when(F.col("share") >= 1, F.col("asks")).otherwise(F.floor(F.col("asks") * F.col("share") + F.pmod(F.xxhash64("k", "label"), F.lit(1000)) / 1000.0)).cast("long"))
        moved = moved.withColumn("go", F.least("go", "asks"))
        parts = moved.select("k", "l", F.explode(F.array(F.struct("label", (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("aim").alias("label"), F.col("go").alias("n")))).alias("c")).select("k", "l", "c.label", "c.n").filter("n > 0")
        cells = store(parts.groupBy("k", "l", "label").agg(F.sum("n").alias("n")), "linked")
    return alone.unionByName(cells)


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null), label of every row.

    Counts of the shards are at most one apart; slots run from 0 without gaps. label: the shard that the document was
    propagated to, null for a document whose text stands once; shard is label, but for the rows that a label has above
    its shard's count. Those and the documents without a label fill up the room that is left, one text after another.
    size: UTF-8 bytes of the text (null: none) plus 8; null and empty texts are equal texts. Repeated rows are rows of
    their own; ties go by id, null ids first. Texts of any length are hashed whole. An empty table gives none; further
    columns are ignored, whatever their names.
    """
    rows = store(_described(docs.select("doc_id", "text")), "described")
    cells = _propagate(rows, shards, rounds)
    # each text's labels as ranges of its documents' numbers; a document's number comes from its hash order
    by_text = Window.partitionBy("k", "l").orderBy("label")
    runs = cells.withColumn("upto", F.sum("n").over(by_text)).groupBy("k", "l").agg(F.sum("n").alias("of"), F.sort_array(F.collect_list(F.struct("upto", "label"))).alias("runs"))
    runs = store(runs, "runs")
    spread = rows.join(runs, ["k", "l"])  # read back, so that a hot text's partition can be split
    # the place of a document within its text, as a share of the hash range: no numbering of a large text in one task
    place = F.pmod(F.xxhash64("doc_id", "l"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("of")
    label = F.coalesce(F.element_at(F.filter("runs", lambda r: r["upto"] > place), 1)["label"], F.element_at("runs", -1)["label"])
    labelled = spread.select("doc_id", "size", "text_crc32", "k", "l", F.when(F.col("of") > 1, label).otherwise(shards).alias("label"))
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["label", "k", "l", "doc_id"]
    ordered = labelled.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ordered = store(ordered.select("doc_id", "size", "text_crc32", "label", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "ordered")
    discard(rows, runs)

    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = parts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    count = dict.fromkeys(range(shards + 1), 0) | {r.label: r.n for r in ordered.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    total = sum(count.values())
    quota = [total // shards + (s < total % shards) for s in range(shards)]  # the first shards hold one row more
    held = [min(count[s], quota[s]) for s in range(shards)]
    start = [sum(count[t] for t in range(s)) for s in range(shards + 1)]  # of a label's rows in the order
    spilt = [sum(count[t] - held[t] for t in range(s)) for s in range(shards + 1)]  # rows beyond their label's count, before
    room = [sum(quota[t] - held[t] for t in range(s)) for s in range(shards)]  # left in the shards before
    pick = lambda values, at: F.get(F.array(*[F.lit(v).cast("long") for v in values]), at.cast("int"))

    out = ordered.join(F.broadcast(before), "part").withColumn("own", F.col("before") + F.col("at") - pick(start, F.col("label")))
    stays = F.col("own") < pick([*held, 0], F.col("label"))
    out = out.withColumn("stays", stays).withColumn("rest", pick(spilt, F.col("label")) + F.col("own") - pick([*held, 0], F.col("label")))
    # the last shard whose room starts at or before the row's place in the rest, and that has room
    open_ = [s for s in range(shards) if quota[s] > held[s]] or [0]
    into = F.greatest(*[F.when(F.col("rest") >= room[s], F.lit(s)).otherwise(F.lit(open_[0])) for s in open_], F.lit(open_[0]))
    out = out.withColumn("shard", F.when(F.col("stays"), F.col("label")).otherwise(into).cast("int"))
    slot = F.when(F.col("stays"), F.col("own")).otherwise(pick(held, F.col("shard")) + F.col("rest") - pick(room, F.col("shard")))
    named = F.when(F.col("label") < shards, F.col("label").cast("int")).alias("label")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), named)


def cut_edges(docs: DataFrame, sharded: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row: linked (texts of several documents), cut (those in several shards), away (documents outside the shard
    that has most of their text), and cut_by_hash, away_by_hash: the same if ids were hashed to shards.

    docs(doc_id, text) and sharded(doc_id, shard) of unique ids.
    """
    both = _described(docs.select("doc_id", "text")).join(sharded.select("doc_id", "shard"), "doc_id").withColumn("hashed", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def of(column: str, cut: str, away: str) -> DataFrame:
        per = both.groupBy("k", "l", column).agg(F.count(F.lit(1)).alias("n")).groupBy("k", "l").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("most"), F.sum("n").alias("of")).filter("of > 1")
        return per.agg(F.count(F.lit(1)).alias("linked"), F.count_if(F.col("c") > 1).alias(cut), F.coalesce(F.sum(F.col("of") - F.col("most")), F.lit(0)).alias(away))

    return of("shard", "cut", "away").crossJoin(of("hashed", "cut_by_hash", "away_by_hash").drop("linked"))  # a row each
