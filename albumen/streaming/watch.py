"""Structured Streaming over watched folders: files to ingest, folder state and the tagging queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import prefix_match, touch_watch_folders
from ..operators.ingest import ingest_new_files
from ..operators.iterate import cut
from ..sources.media import SCHEMA, classify_media, content_hash, only_media


def watched_files(spark: SparkSession, folder: str, pattern: str = "*", max_files: int | None = None) -> DataFrame:
    """A stream of the media files below a folder, with content hashes; at most max_files of them in a batch."""
    reader = spark.readStream.schema(SCHEMA).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).load(folder)
    return only_media(files).select("path", "length", "modificationTime", content_hash().alias("hash"), classify_media().alias("media_type"))


def debounce(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One event for each path within the watermark's delay. events: path, ts."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path"])


def settled(events: DataFrame, quiet: str = "5 seconds", delay: str = "1 minute", ts: str = "modificationTime") -> DataFrame:
    """The last event of each path once no other came for `quiet`, with the columns of events.

    Events of a path that lie closer than `quiet` are one session, however long it is; of equal times the greatest row
    counts. A session is given out when the watermark (the latest time less `delay`) has passed its end; events that come
    later than that are lost, and so are those without a time. Repeated events change nothing.
    """
    rest = [c for c in events.columns if c not in ("path", ts)]
    calm = events.withWatermark(ts, delay).groupBy(F.session_window(ts, quiet), "path").agg(F.max(F.struct(ts, *rest)).alias("last"))
    return calm.select("path", "last.*").select(*events.columns)


def watch_ingest(files: DataFrame, library_path: str, checkpoint: str, available_now: bool = True, after=None, progress_path: str | None = None) -> StreamingQuery:
    """Appends what is new to the Parquet library(path, length, modificationTime, hash, media_type) at library_path.

    Files of one batch are taken once for each path and content. A batch that is run again after a failure finds its own
    rows in the library and adds nothing. after(batch_rows, batch_id) sees the rows that were added. files may be
    `settled`: then a path that is made and changed is taken once, as it was last. progress_path keeps what was scanned
    of each folder, in a folder for each batch that a repeated batch writes again; `scan_progress` reads it.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        library = spark.read.schema(batch.schema).option("ignoreMissingFiles", True).parquet(library_path)
        # cut off from the library, which is about to change
        new = cut(ingest_new_files(batch, library, dedupe_within_batch=True).filter("not path_conflict").select(*batch.columns))
        new.write.mode("append").parquet(library_path)
        if progress_path is not None:
            folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
            seen = batch.groupBy(folder).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
            seen.write.mode("overwrite").parquet(f"{progress_path}/batch={batch_id}")
        if after is not None:
            after(new, batch_id)

    spark = files.sparkSession
    empty = spark.createDataFrame([], files.schema)
    empty.write.mode("append").parquet(library_path)  # so that there is a library to read
    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def scan_progress(spark: SparkSession, progress_path: str) -> DataFrame:
    """(folder, files, bytes, last_batch) of what the batches of watch_ingest have scanned so far."""
    rows = spark.read.schema("folder string, files long, bytes long, batch long").parquet(progress_path)
    return rows.groupBy("folder").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.max("batch").alias("last_batch"))


def watch_state(watch: DataFrame, added: DataFrame) -> DataFrame:
    """watch folders after the added files: last_checked moves to the latest."""
    return touch_watch_folders(watch, added.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), F.col("modificationTime").alias("ts")))


def auto_tag_queue(added: DataFrame, watch: DataFrame) -> DataFrame:
    """Added files below a watch folder with auto_tag."""
    on = watch.filter("auto_tag").select(F.col("path").alias("watch_path"))
    return prefix_match(added, on, "path", "watch_path").select(*added.columns).distinct()


def merge_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(kind, photo_hash, tag, value, updated_at, by_device, deleted): the last write of each key wins, ties go to the greater device; deletions stay as tombstones."""
    key = ["kind", "photo_hash", "tag"]
    w = Window.partitionBy(*key).orderBy(F.desc("updated_at"), F.desc("by_device"), F.desc("value"))
    return state.unionByName(changes).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def live(state: DataFrame) -> DataFrame:
    return state.filter(~F.col("deleted"))


def changes_since(state: DataFrame, cursor, kinds: list[str] | None = None, cut_after: int | None = None) -> DataFrame:
    """What another device has yet to see: rows written after the cursor, of these kinds, tombstones among them.

    cut_after: a page of about that many rows, in order of writing; rows of one time are never parted, so the greatest
    updated_at of a page (`next_cursor`) is where the next one starts.
    """
    out = state.filter(F.col("updated_at") > F.lit(cursor))
    out = out if kinds is None else out.filter(F.col("kind").isin(*kinds))
    if cut_after is None:
        return out
    last = out.select("updated_at").orderBy("updated_at").limit(cut_after).agg(F.max("updated_at").alias("_last"))
    return out.join(F.broadcast(last), F.col("updated_at") <= F.col("_last")).drop("_last")


def next_cursor(page: DataFrame, cursor) -> DataFrame:
    """One row: the cursor after a page; the same where it is empty."""
    return page.agg(F.coalesce(F.max("updated_at"), F.lit(cursor)).alias("next_cursor"))


def _held(spark: SparkSession, state_path: str, below: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """For each bucket its versions in order, of batches that were written whole (and come before batch `below`)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[tuple[int, str]]] = {}
    for done in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/v*/_SUCCESS")) or []:
        folder = done.getPath().getParent()
        version = int(folder.getName()[1:])
        if below is None or version < below:
            for part in fs.listStatus(folder):
                if part.isDirectory() and (name := part.getPath().getName()).startswith("bucket="):
                    found.setdefault(int(name[7:]), []).append((version, part.getPath().toString()))
    return {b: sorted(v) for b, v in found.items()}


def merged_state(spark: SparkSession, schema, state_path: str, buckets: list[int] | None = None, below: int | None = None) -> DataFrame:
    """The state that merge_stream keeps: of every bucket its last version."""
    held = _held(spark, state_path, below)
    paths = [held[b][-1][1] for b in (sorted(held) if buckets is None else buckets) if b in held]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_stream(changes: DataFrame, state_path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the merged state of a change stream under state_path, in buckets of the key's hash.

    A batch reads and writes only the buckets that its changes fall in, so what it writes follows the batch and not the
    state. Each touched bucket gets a version of the batch's number; a batch that is run again starts from the versions
    before its own and writes the same. The version before the last is kept for that, older ones go.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.withColumn("bucket", F.pmod(F.xxhash64("kind", "photo_hash", "tag"), F.lit(buckets)).cast("int")))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # `buckets` rows at most
        before = merged_state(spark, batch.schema, state_path, touched, batch_id)
        merged = merge_changes(before, rows.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64("kind", "photo_hash", "tag"), F.lit(buckets)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/v{batch_id}")
        for versions in (v for b, v in _held(spark, state_path).items() if b in touched):
            for _, old in versions[:-2]:
                path = spark._jvm.org.apache.hadoop.fs.Path(old)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
