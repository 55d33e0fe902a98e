"""Duplicate ranking, timelines, unions and case-insensitive tag rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut
from .stats import duplicate_groups, entity_counts, taken, visible


def extension(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


# fixed values
#: Tags that a task orders, about.
ROWS_A_TASK = 250_000
RAW_ORIGINALS = ("cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf", "pef", "srw", "x3f", "3fr")


def format_priority(path: str = "path") -> Column:
    e = extension(path)
    return F.when(e.isin(*RAW_ORIGINALS), 800).when(e.isin("heic", "heif", "avif"), 500).when(e == "png", -50).when(e.isin("bmp", "tif", "tiff"), -200).otherwise(0)


def is_invested() -> Column:
    return (F.col("tag_count") > 0) | (F.col("person_count") > 0) | (F.col("collection_count") > 0) | F.col("has_xmp")


def keeper_score() -> Column:
    """A photo's worth as the one to keep, from its row and counts."""
    rating = F.coalesce("rating", F.lit(0))
    return (
        F.when(F.col("favorite"), 100000.0).otherwise(0.0)
        + F.when(is_invested(), 20000.0).otherwise(0.0)
        + F.when(F.col("has_xmp"), 3000.0).otherwise(0.0)
        + F.when(rating < 0, -50000.0).otherwise(rating * 2000.0)
        + F.col("person_count") * 800.0
        + F.col("collection_count") * 500.0
        + format_priority()
        + F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0)) / 1000000.0 * 150.0
        + F.coalesce("blur_score", F.lit(0.0)) * 1.5
        + F.col("tag_count") * 30.0
        + F.col("size") / 1048576.0 * 3.0
    )


def explain_keeper() -> Column:
    """Reasons for a score, the weightiest first."""
    why = [
        F.when(F.col("favorite"), "favorite"),
        F.when(F.col("rating") > 0, F.format_string("rated %d", "rating")),
        F.when(F.col("rating") < 0, "rejected"),
        F.when(F.col("person_count") > 0, F.format_string("%d named faces", "person_count")),
        F.when(F.col("collection_count") > 0, F.format_string("in %d collections", "collection_count")),
        F.when(F.col("tag_count") > 0, F.format_string("%d tags", "tag_count")),
        F.when(F.col("has_xmp"), "sidecar"),
        F.when(format_priority() > 0, "better format"),
    ]
    return F.array_compact(F.array(*why))


def cleanup_rows(photos: DataFrame, tags: DataFrame, faces: DataFrame, members: DataFrame) -> DataFrame:
    """photos with their counts and has_xmp."""
    return entity_counts(photos, tags, faces, members).withColumn("has_xmp", F.col("status").isin("xmp_written", "xmp_sync"))


def rank_keepers(photos: DataFrame, tags: DataFrame, faces: DataFrame, members: DataFrame, folder: str | None = None) -> DataFrame:
    """Each duplicate group's photos by worth; the first is the keeper.

    A null blur counts as the group's median. Ties go to the older date (none last), then the lower id. reclaimable:
    bytes of the group's other photos that nobody has invested in.
    """
    rows = cleanup_rows(duplicate_groups(photos, folder), tags, faces, members)
    group = Window.partitionBy("phash")
    rows = rows.withColumn("blur_score", F.coalesce("blur_score", F.percentile("blur_score", F.lit(0.5)).over(group)))
    rows = rows.withColumn("score", keeper_score()).withColumn("invested", is_invested()).withColumn("reasons", explain_keeper())
    rows = rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("score"), F.asc_nulls_last("date_taken"), "photo_id")))
    spare = F.when((F.col("rank") > 1) & ~F.col("invested"), F.col("size")).otherwise(0)
    return rows.withColumn("reclaimable", F.sum(spare).over(group)).withColumn("confidence", F.lit(0.95))


def timeline(photos: DataFrame, offset: int = 0, limit: int = 100, folder: str | None = None, month: str | None = None) -> DataFrame:
    """A page of visible photos, newest first, in a row for each date with its photos in order."""
    p = visible(photos).withColumn("day", taken())
    p = p if folder is None else p.filter(F.col("folder") == folder)
    p = p if month is None else p.filter(F.date_format("day", "yyyy-MM") == month)
    page = p.orderBy(F.desc("day"), F.desc("created_at"), "photo_id").offset(offset).limit(limit)
    items = F.sort_array(F.collect_list(F.struct((-F.unix_date("created_at")).alias("o"), F.col("photo_id").alias("id"))))
    return page.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.transform(items, lambda x: x["id"]).alias("photo_ids"))


def on_this_day(photos: DataFrame, mm_dd: str) -> DataFrame:
    d = taken()
    return visible(photos).filter(F.date_format(d, "MM-dd") == mm_dd).select("photo_id", d.alias("day"))


def collision_free_names(rows: DataFrame, target: str, name: str, order: str, sep: str = "-") -> DataFrame:
    """rows with new_name: repeats of a name within a target get -1, -2, ... before the extension, then once more where a made name meets a given one."""

    def suffixed(df: DataFrame, col: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(target, F.lower(col)).orderBy(F.col("_made"), order)) - 1
        stem, ext = F.regexp_extract(col, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(col, r"^(.*?)(\.[^.]*)?$", 2)
        out = df.withColumn("_n", n)
        return out.withColumn("_next", F.when(F.col("_n") > 0, F.concat(stem, F.lit(sep), F.col("_n").cast("string"), ext)).otherwise(F.col(col))).withColumn("_made", F.col("_made") | (F.col("_n") > 0))

    once = suffixed(rows.withColumn("_made", F.lit(False)), name).withColumn("_first", F.col("_next")).drop("_n", "_next")
    twice = suffixed(once, "_first").withColumnRenamed("_next", "new_name")
    return twice.drop("_made", "_first", "_n")


def bounded_recent(rows: DataFrame, key: str, when: str, n: int = 500) -> DataFrame:
    """The newest n rows of each key; ties at the edge stay."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(when)))).filter(F.col("_r") <= n).drop("_r")


def largest_unassigned_face(faces: DataFrame) -> DataFrame:
    """(photo_id, face_id): of faces without a person the largest, ties to the lower id."""
    area = (F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))
    return faces.filter("assignment <> 'named'").groupBy("photo_id").agg(F.max_by("face_id", F.struct(area, -F.col("face_id"))).alias("face_id"))


def ordered_union(results: list[DataFrame], key: str = "photo_id") -> DataFrame:
    """Rows of ranked results (key, rank): each key at its first place, earlier results first."""
    every = None
    for i, r in enumerate(results):
        part = r.select(F.lit(i).alias("source"), key, "rank")
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.min(F.struct("source", "rank")).alias("o")).select(key, "o.source", "o.rank")


def intersect_groups(hits: DataFrame, key: str = "photo_id") -> DataFrame:
    """hits (query_id, group_id, key): keys in every group of the query that has any hit."""
    groups = hits.groupBy("query_id").agg(F.countDistinct("group_id").alias("need"))
    found = hits.groupBy("query_id", key).agg(F.countDistinct("group_id").alias("have"))
    return found.join(groups, "query_id").filter("have = need").select("query_id", key)


def map_points(photos: DataFrame, limit: int | None = None) -> DataFrame:
    """Visible photos with a place: from their own coordinates, else the estimated ones. photos: estimated_lat/lon/location."""
    cols = ["photo_id", "created_at"]
    own = visible(photos).filter("gps_lat is not null and gps_lon is not null").select(*cols, F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"), F.lit("gps").alias("source"))
    guess = visible(photos).filter("gps_lat is null and estimated_lat is not null and estimated_lon is not null").select(*cols, F.col("estimated_lat").alias("lat"), F.col("estimated_lon").alias("lon"), F.lit("ai").alias("source"))
    if limit is not None:
        own, guess = (x.orderBy(F.desc("created_at"), "photo_id").limit(limit) for x in (own, guess))
    return own.unionByName(guess)


def dedupe_tags_by_case(tags: DataFrame, order: str = "tag_id") -> DataFrame:
    """One tag of those alike but for case: one that starts with a capital, else the lowest id.

    The rows are written down and counted first, so that a task orders about ROWS_A_TASK of them, however many there are.
    """
    tags = cut(tags)
    parts = max(int(tags.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tags.count() // ROWS_A_TASK))
    tags = tags.withColumn("_k", F.lower("tag")).repartition(parts, "photo_id", "_k")
    upper = F.substring("tag", 1, 1) != F.lower(F.substring("tag", 1, 1))
    w = Window.partitionBy("photo_id", "_k").orderBy(upper.desc(), order)
    return tags.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_k")
