"""Aggregates over the library. Private photos count unless a function says otherwise."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def taken(default: str = "created_at") -> Column:
    return F.coalesce("date_taken", default)


def visible(photos: DataFrame) -> DataFrame:
    return photos.filter(~F.col("private"))


def library_stats(photos: DataFrame, tags: DataFrame, usage: DataFrame, faces: DataFrame) -> DataFrame:
    """One row of counts by status, of tags, folders and faces, and the total cost."""
    by = lambda s: F.count_if(F.col("status") == s)
    p = photos.agg(F.count(F.lit(1)).alias("total"), by("tagged").alias("tagged"), by("pending").alias("pending"), by("error").alias("error"), F.countDistinct("folder").alias("folders"))
    t = tags.agg(F.count(F.lit(1)).alias("total_tags"), F.countDistinct("tag").alias("distinct_tags"))
    u = usage.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"))
    f = faces.agg(F.count(F.lit(1)).alias("total_faces"))
    return p.crossJoin(t).crossJoin(u).crossJoin(f)  # one row each


def folder_counts(photos: DataFrame) -> DataFrame:
    return photos.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def folder_progress(photos: DataFrame) -> DataFrame:
    return photos.groupBy("folder").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "tagged").alias("tagged"))


def provider_stats(usage: DataFrame, providers: DataFrame) -> DataFrame:
    """Successes, failures and cost of each listed provider; unused ones show 0."""
    got = usage.groupBy("provider").agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.sum("cost_usd").alias("cost"))
    return providers.join(got, "provider", "left").na.fill({"ok": 0, "failed": 0, "cost": 0.0})


def cost_dashboard(usage: DataFrame, list_price: float = 0.0005) -> DataFrame:
    """Total cost, successes, average and savings against a list price."""
    a = usage.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"), F.count_if("success").alias("successes"))
    avg = F.when(F.col("successes") > 0, F.col("total_cost") / F.col("successes")).otherwise(0.0)
    return a.select("*", avg.alias("avg_cost"), F.greatest(F.lit(0.0), F.col("successes") * list_price - F.col("total_cost")).alias("savings"))


def cost_by_provider(usage: DataFrame) -> DataFrame:
    return usage.filter("success").groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost"), F.avg("cost_usd").alias("avg_cost"))


def daily_cost(usage: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    day = F.to_date("created_at")
    return usage.filter(F.col("success") & (day >= F.date_sub(F.lit(as_of), days))).groupBy(day.alias("day")).agg(F.sum("cost_usd").alias("cost"), F.count(F.lit(1)).alias("n"))


def budget_status(usage: DataFrame, as_of: dt.date, limit: float) -> DataFrame:
    """Spend since the month's start, what remains of the limit, and whether it is used up (a limit of 0 never is)."""
    month = F.trunc(F.lit(as_of), "month")
    spent = usage.filter(F.to_date("created_at") >= month).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent"))
    return spent.select("spent", F.greatest(F.lit(0.0), F.lit(float(limit)) - F.col("spent")).alias("remaining"), (F.lit(limit > 0) & (F.col("spent") >= float(limit))).alias("over"))


def run_breakdown(results: DataFrame) -> DataFrame:
    """Of one tagging run: tagged, failed and cost of each provider."""
    return results.groupBy("provider").agg(F.count_if("success").alias("tagged"), F.count_if(~F.col("success")).alias("failed"), F.sum("cost_usd").alias("cost"))


def tag_counts(tags: DataFrame, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Photos of each tag, most first, ties by tag; a prefix matches in any case."""
    if prefix is not None:
        tags = tags.filter(F.lower("tag").startswith(prefix.lower()))
    out = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "tag").limit(limit or (200 if prefix is None else 50))


def tag_details(tags: DataFrame, limit: int = 500) -> DataFrame:
    out = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("source")).alias("sources"))
    return out.orderBy(F.desc("n"), "tag").limit(limit)


def trending_tags(photos: DataFrame, tags: DataFrame, as_of: dt.date, days: int, limit: int) -> DataFrame:
    """Tags of photos tagged in the last days; counts of all time where there are none. photos: photo_id, tagged_at."""
    days = min(365, max(1, days))
    named = tags.filter(F.trim("tag") != "")
    recent = photos.filter(F.col("tagged_at") >= F.date_sub(F.lit(as_of), days)).select("photo_id")
    lately = named.join(recent, "photo_id", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    empty = lately.agg((F.count(F.lit(1)) == 0).alias("none"))
    always = named.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(empty)).filter("none").drop("none")
    return lately.unionByName(always).orderBy(F.desc("n"), "tag").limit(limit)


def photos_by_month(photos: DataFrame, limit: int = 24) -> DataFrame:
    return visible(photos).groupBy(F.date_format(taken(), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("month")).limit(limit)


def top_tags(photos: DataFrame, tags: DataFrame, limit: int = 30) -> DataFrame:
    return tag_counts(tags.join(visible(photos).select("photo_id"), "photo_id", "left_semi"), limit=limit)


def media_breakdown(photos: DataFrame) -> DataFrame:
    return visible(photos).groupBy(F.coalesce("media_type", F.lit("image")).alias("media_type")).agg(F.count(F.lit(1)).alias("n"))


def rating_distribution(photos: DataFrame) -> DataFrame:
    return visible(photos).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def top_locations(photos: DataFrame, limit: int = 20) -> DataFrame:
    """photos: estimated_location."""
    named = visible(photos).filter(F.coalesce("estimated_location", F.lit("")) != "")
    return named.groupBy("estimated_location").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "estimated_location").limit(limit)


def storage_by_folder(photos: DataFrame, limit: int = 15) -> DataFrame:
    return visible(photos).groupBy("folder").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes"), "folder").limit(limit)


def library_totals(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def entity_counts(photos: DataFrame, tags: DataFrame, faces: DataFrame, members: DataFrame) -> DataFrame:
    """photos with tag_count, person_count (named faces) and collection_count."""
    t = tags.groupBy("photo_id").agg(F.count(F.lit(1)).alias("tag_count"))
    f = faces.filter("assignment = 'named'").groupBy("photo_id").agg(F.count(F.lit(1)).alias("person_count"))
    c = members.groupBy("photo_id").agg(F.count(F.lit(1)).alias("collection_count"))
    return photos.join(t, "photo_id", "left").join(f, "photo_id", "left").join(c, "photo_id", "left").na.fill(0, ["tag_count", "person_count", "collection_count"])


def calendar_month(photos: DataFrame, year: int, month: int) -> DataFrame:
    d = taken()
    return photos.filter((F.year(d) == year) & (F.month(d) == month)).groupBy(F.dayofmonth(d).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("photo_id").alias("first_id"))


def year_month_counts(photos: DataFrame) -> DataFrame:
    d = taken()
    return photos.groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(F.count(F.lit(1)).alias("n")).filter("year > 0 and month between 1 and 12")


def timeline_buckets(photos: DataFrame, folder: str | None = None) -> DataFrame:
    photos = visible(photos)
    photos = photos if folder is None else photos.filter(F.col("folder") == folder)
    return photos.groupBy(F.date_format(taken(), "yyyy-MM").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def collections_with_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    return collections.join(n, "collection_id", "left").na.fill(0, ["n"])


def persons_with_counts(persons: DataFrame, faces: DataFrame, photos: DataFrame) -> DataFrame:
    """Persons with the number of their faces on visible photos."""
    n = faces.filter("person_id is not null").join(visible(photos).select("photo_id"), "photo_id", "left_semi").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    return persons.join(n, "person_id", "left").na.fill(0, ["n"])


def state_counts(faces: DataFrame) -> DataFrame:
    return faces.groupBy("assignment").agg(F.count(F.lit(1)).alias("n"))


def suggested_blur_threshold(photos: DataFrame, low: float = 25.0, high: float = 120.0, least: int = 50) -> DataFrame:
    """One row: the value at 0-based rank max(1, floor(0.03 n)) of ascending scores, within bounds; null below `least` rows.

    The rank is found over distinct scores and their counts, summed up before any shuffle.
    """
    counts = photos.filter("blur_score is not null").groupBy("blur_score").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    # only the lowest scores can hold the rank: bands of scores are ranked first, then the one band in question
    banded = counts.withColumn("band", F.floor("blur_score"))
    bands = banded.groupBy("band").agg(F.sum("c").alias("bc")).withColumn("upto", F.sum("bc").over(Window.orderBy("band"))).crossJoin(F.broadcast(total))
    rank = F.greatest(F.lit(1), F.floor(F.col("n") * 0.03))
    hit = bands.withColumn("rank", rank).filter("upto > rank and upto - bc <= rank").select("band", (F.col("rank") - (F.col("upto") - F.col("bc"))).alias("within"), "n")
    inside = banded.join(F.broadcast(hit), "band").withColumn("upto", F.sum("c").over(Window.partitionBy("band").orderBy("blur_score")))
    value = inside.filter("upto > within").agg(F.min("blur_score").alias("v"), F.max("n").alias("n"))
    return value.select(F.when(F.coalesce("n", F.lit(0)) >= least, F.least(F.lit(high), F.greatest(F.lit(low), F.col("v")))).alias("threshold"))


def duplicate_groups(photos: DataFrame, folder: str | None = None) -> DataFrame:
    """Visible images that share a perceptual hash; a folder (prefix) decides which groups, members are library-wide."""
    images = visible(photos).filter("media_type = 'image' and phash is not null")
    scope = images if folder is None else images.filter((F.col("folder") == folder) | F.col("folder").startswith(folder))
    many = scope.groupBy("phash").agg(F.count(F.lit(1)).alias("c")).filter("c >= 2").select("phash")
    return images.join(many, "phash", "left_semi")


def protected(photos: DataFrame, tags: DataFrame, faces: DataFrame, members: DataFrame) -> DataFrame:
    """Rows without protection: not favorite, rated under 3, and without tag, named face or collection."""
    plain = photos.filter(~F.col("favorite") & (F.coalesce("rating", F.lit(0)) < 3))
    for child in (tags, faces.filter("assignment = 'named'"), members):
        plain = plain.join(child.select("photo_id"), "photo_id", "left_anti")
    return plain


def cleanup_summary(photos: DataFrame, tags: DataFrame, faces: DataFrame, members: DataFrame) -> DataFrame:
    """One row: duplicate groups, members, reclaimable bytes; unprotected blurry photos and bytes; missing features; total."""
    groups = photos.filter("media_type = 'image' and phash is not null").groupBy("phash").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"), F.max("size").alias("m")).filter("c > 1")
    dup = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("s") - F.col("m")), F.lit(0)).alias("reclaimable"))
    limit = suggested_blur_threshold(photos).select(F.coalesce("threshold", F.lit(100.0)).alias("t"))
    blurry = protected(photos.crossJoin(F.broadcast(limit)).filter("blur_score < t"), tags, faces, members).agg(F.count(F.lit(1)).alias("blurry"), F.coalesce(F.sum("size"), F.lit(0)).alias("blurry_bytes"))
    lack = photos.agg(F.count_if(F.col("phash").isNull()).alias("no_phash"), F.count_if(F.col("blur_score").isNull()).alias("no_blur"), F.count(F.lit(1)).alias("total"))
    return dup.crossJoin(blurry).crossJoin(lack)  # one row each
