"""Aggregates, ranking and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import stats as S
from .registry import query

AS_OF = dt.date(2024, 1, 31)
T = "coalesce(date_taken, created_at)"


@query("library_stats", """SELECT * FROM (SELECT count(*) total, count(*) FILTER (status='tagged') tagged, count(*) FILTER (status='pending') pending, count(*) FILTER (status='error') error, count(DISTINCT folder) folders FROM photos),
(SELECT count(*) total_tags, count(DISTINCT tag) distinct_tags FROM tags), (SELECT round(sum(cost_usd), 6) total_cost FROM provider_usage), (SELECT count(*) total_faces FROM faces)""")
def _(lib):
    return S.library_stats(lib.photos, lib.tags, lib.provider_usage, lib.faces).withColumn("total_cost", F.round("total_cost", 6))


@query("folder_counts", "SELECT folder, count(*) n FROM photos GROUP BY 1", ("photos",))
def _(lib):
    return S.folder_counts(lib.photos)


@query("folder_progress", "SELECT folder, count(*) total, count(*) FILTER (status='tagged') tagged FROM photos GROUP BY 1", ("photos",))
def _(lib):
    return S.folder_progress(lib.photos)


@query("provider_stats", """SELECT p.provider, count(*) FILTER (success) ok, count(*) FILTER (NOT success) failed, round(coalesce(sum(cost_usd), 0), 6) AS cost
FROM (VALUES ('p0'),('p1'),('p2'),('p3'),('p9')) p(provider) LEFT JOIN provider_usage u ON u.provider = p.provider GROUP BY 1""", ("provider_usage",))
def _(lib):
    providers = lib.spark.createDataFrame([(f"p{i}",) for i in (0, 1, 2, 3, 9)], "provider string")
    return S.provider_stats(lib.provider_usage, providers).withColumn("cost", F.round("cost", 6))


@query("cost_dashboard", """SELECT round(c, 6) total_cost, s AS successes, round(c / s, 9) avg_cost, round(greatest(0, s * 0.0005 - c), 6) savings FROM (SELECT sum(cost_usd) c, count(*) FILTER (success) s FROM provider_usage)""", ("provider_usage",))
def _(lib):
    return S.cost_dashboard(lib.provider_usage).select(F.round("total_cost", 6).alias("total_cost"), "successes", F.round("avg_cost", 9).alias("avg_cost"), F.round("savings", 6).alias("savings"))


@query("cost_by_provider", "SELECT provider, count(*) n, round(sum(cost_usd), 6) AS cost, round(avg(cost_usd), 9) avg_cost FROM provider_usage WHERE success GROUP BY 1", ("provider_usage",))
def _(lib):
    return S.cost_by_provider(lib.provider_usage).select("provider", "n", F.round("cost", 6).alias("cost"), F.round("avg_cost", 9).alias("avg_cost"))


@query("daily_cost", "SELECT CAST(created_at AS DATE) AS day, round(sum(cost_usd), 6) AS cost, count(*) n FROM provider_usage WHERE success AND CAST(created_at AS DATE) >= DATE '2024-01-01' GROUP BY 1", ("provider_usage",))
def _(lib):
    return S.daily_cost(lib.provider_usage, AS_OF).withColumn("cost", F.round("cost", 6))


@query("budget_status", """SELECT round(s, 6) spent, round(greatest(0, 0.05 - s), 6) remaining, s >= 0.05 AS over FROM (SELECT sum(cost_usd) s FROM provider_usage WHERE CAST(created_at AS DATE) >= DATE '2024-01-01')""", ("provider_usage",))
def _(lib):
    return S.budget_status(lib.provider_usage, AS_OF, 0.05).select(F.round("spent", 6).alias("spent"), F.round("remaining", 6).alias("remaining"), "over")


@query("run_breakdown", "SELECT provider, count(*) FILTER (success) tagged, count(*) FILTER (NOT success) failed, round(sum(cost_usd), 6) AS cost FROM provider_usage WHERE CAST(created_at AS DATE) = DATE '2024-01-10' GROUP BY 1", ("provider_usage",))
def _(lib):
    run = lib.provider_usage.filter(F.to_date("created_at") == F.lit(dt.date(2024, 1, 10)))
    return S.run_breakdown(run).withColumn("cost", F.round("cost", 6))


@query("tag_counts", "SELECT tag, count(*) n FROM tags GROUP BY 1 ORDER BY n DESC, tag LIMIT 200", ("tags",))
def _(lib):
    return S.tag_counts(lib.tags)


@query("tag_counts_prefix", "SELECT tag, count(*) n FROM tags WHERE lower(tag) LIKE 'red%' GROUP BY 1 ORDER BY n DESC, tag LIMIT 50", ("tags",))
def _(lib):
    return S.tag_counts(lib.tags, prefix="RED")


@query("tag_details", "SELECT tag, count(*) n, list_sort(list(DISTINCT source)) sources FROM tags GROUP BY 1 ORDER BY n DESC, tag LIMIT 500", ("tags",))
def _(lib):
    return S.tag_details(lib.tags)


TAGGED_AT = "CASE WHEN status = 'tagged' THEN created_at END"


@query("trending_tags", "SELECT tag, count(*) n FROM tags WHERE trim(tag) <> '' AND photo_id IN (SELECT photo_id FROM photos WHERE status = 'tagged' AND created_at >= DATE '2002-12-01') GROUP BY 1 ORDER BY n DESC, tag LIMIT 20", ("photos", "tags"))
def _(lib):
    return S.trending_tags(lib.photos.withColumn("tagged_at", F.expr(TAGGED_AT)), lib.tags, dt.date(2002, 12, 31), 30, 20)


@query("trending_tags_empty_window", "SELECT tag, count(*) n FROM tags WHERE trim(tag) <> '' GROUP BY 1 ORDER BY n DESC, tag LIMIT 20", ("tags",))
def _(lib):
    return S.trending_tags(lib.photos.withColumn("tagged_at", F.expr(TAGGED_AT)), lib.tags, dt.date(2024, 1, 31), 7, 20)


@query("photos_by_month", f"SELECT strftime({T}, '%Y-%m') AS month, count(*) n FROM photos WHERE NOT private GROUP BY 1 ORDER BY 1 DESC LIMIT 24", ("photos",))
def _(lib):
    return S.photos_by_month(lib.photos)


@query("top_tags", "SELECT tag, count(*) n FROM tags WHERE photo_id IN (SELECT photo_id FROM photos WHERE NOT private) GROUP BY 1 ORDER BY n DESC, tag LIMIT 30", ("photos", "tags"))
def _(lib):
    return S.top_tags(lib.photos, lib.tags)


@query("media_breakdown", "SELECT coalesce(media_type, 'image') media_type, count(*) n FROM photos WHERE NOT private GROUP BY 1", ("photos",))
def _(lib):
    return S.media_breakdown(lib.photos)


@query("rating_distribution", "SELECT rating, count(*) n FROM photos WHERE NOT private GROUP BY 1", ("photos",))
def _(lib):
    return S.rating_distribution(lib.photos)


PLACE = "CASE WHEN photo_id % 3 = 0 THEN 'Place ' || CAST(photo_id % 29 AS STRING) WHEN photo_id % 3 = 1 THEN '' END"


@query("top_locations", f"SELECT estimated_location, count(*) n FROM (SELECT *, {PLACE} AS estimated_location FROM photos) WHERE NOT private AND coalesce(estimated_location, '') <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20", ("photos",))
def _(lib):
    return S.top_locations(lib.photos.withColumn("estimated_location", F.expr(PLACE)))


@query("storage_by_folder", "SELECT folder, CAST(sum(size) AS BIGINT) bytes, count(*) n FROM photos WHERE NOT private GROUP BY 1 ORDER BY bytes DESC, folder LIMIT 15", ("photos",))
def _(lib):
    return S.storage_by_folder(lib.photos)


@query("library_totals", "SELECT count(*) n, CAST(coalesce(sum(size), 0) AS BIGINT) bytes FROM photos", ("photos",))
def _(lib):
    return S.library_totals(lib.photos)


COUNTS = """(SELECT p.*, coalesce(t.c, 0) tag_count, coalesce(f.c, 0) person_count, coalesce(m.c, 0) collection_count, false has_xmp FROM photos p
LEFT JOIN (SELECT photo_id, count(*) c FROM tags GROUP BY 1) t USING (photo_id) LEFT JOIN (SELECT photo_id, count(*) c FROM faces WHERE assignment = 'named' GROUP BY 1) f USING (photo_id)
LEFT JOIN (SELECT photo_id, count(*) c FROM collection_photos GROUP BY 1) m USING (photo_id))"""


@query("entity_counts", f"SELECT photo_id, tag_count, person_count, collection_count FROM {COUNTS}")
def _(lib):
    return S.entity_counts(lib.photos, lib.tags, lib.faces, lib.collection_photos).select("photo_id", "tag_count", "person_count", "collection_count")


@query("cleanup_rows", f"SELECT photo_id, tag_count, person_count, collection_count, has_xmp, size FROM {COUNTS}")
def _(lib):
    return R.cleanup_rows(lib.photos, lib.tags, lib.faces, lib.collection_photos).select("photo_id", "tag_count", "person_count", "collection_count", "has_xmp", "size")


@query("invested_photos", f"SELECT photo_id FROM {COUNTS} WHERE tag_count > 0 OR person_count > 0 OR collection_count > 0")
def _(lib):
    return R.cleanup_rows(lib.photos, lib.tags, lib.faces, lib.collection_photos).filter(R.is_invested()).select("photo_id")


@query("calendar_month", f"SELECT CAST(day({T}) AS INT) AS day, count(*) n, min(photo_id) first_id FROM photos WHERE year({T}) = 1995 AND month({T}) = 7 GROUP BY 1", ("photos",))
def _(lib):
    return S.calendar_month(lib.photos, 1995, 7)


@query("year_month_counts", f"SELECT CAST(year({T}) AS INT) AS year, CAST(month({T}) AS INT) AS month, count(*) n FROM photos GROUP BY 1, 2", ("photos",))
def _(lib):
    return S.year_month_counts(lib.photos)


@query("timeline_buckets", f"SELECT strftime({T}, '%Y-%m') bucket, count(*) n FROM photos WHERE NOT private AND folder = '/lib/1-URGENT' GROUP BY 1", ("photos",))
def _(lib):
    return S.timeline_buckets(lib.photos, "/lib/1-URGENT")


@query("collections_with_counts", "SELECT c.collection_id, c.name, count(m.photo_id) n FROM (SELECT CAST(range AS BIGINT) collection_id, 'Album ' || CAST(range AS STRING) AS name FROM range(7)) c LEFT JOIN collection_photos m USING (collection_id) GROUP BY 1, 2", ("collection_photos",))
def _(lib):
    albums = lib.spark.range(7).select(F.col("id").alias("collection_id"), F.concat(F.lit("Album "), F.col("id").cast("string")).alias("name"))
    return S.collections_with_counts(albums, lib.collection_photos)


@query("persons_with_counts", "SELECT r.person_id, r.name, count(p.photo_id) n FROM persons r LEFT JOIN faces f ON f.person_id = r.person_id LEFT JOIN photos p ON p.photo_id = f.photo_id AND NOT p.private GROUP BY 1, 2", ("photos", "persons", "faces"))
def _(lib):
    return S.persons_with_counts(lib.persons, lib.faces, lib.photos)


@query("state_counts", "SELECT assignment, count(*) n FROM faces GROUP BY 1", ("faces",))
def _(lib):
    return S.state_counts(lib.faces)


BLUR = "(SELECT CASE WHEN count(*) >= 50 THEN least(120, greatest(25, list_sort(list(blur_score))[CAST(greatest(1, floor(count(*) * 0.03)) AS INT) + 1])) END threshold FROM photos WHERE blur_score IS NOT NULL)"


@query("suggested_blur_threshold", f"SELECT CAST(threshold AS DOUBLE) threshold FROM {BLUR}", ("photos",))
def _(lib):
    return S.suggested_blur_threshold(lib.photos)


@query("cleanup_summary", f"""SELECT * FROM (SELECT count(*) AS groups, CAST(sum(c) AS BIGINT) members, CAST(sum(s - m) AS BIGINT) reclaimable FROM (SELECT count(*) c, sum(size) s, max(size) m FROM photos WHERE media_type = 'image' AND phash IS NOT NULL GROUP BY phash HAVING count(*) > 1)),
(SELECT count(*) blurry, CAST(coalesce(sum(size), 0) AS BIGINT) blurry_bytes FROM {COUNTS}, {BLUR} WHERE blur_score < coalesce(threshold, 100) AND NOT favorite AND coalesce(rating, 0) < 3 AND tag_count = 0 AND person_count = 0 AND collection_count = 0),
(SELECT count(*) FILTER (phash IS NULL) no_phash, count(*) FILTER (blur_score IS NULL) no_blur, count(*) total FROM photos)""")
def _(lib):
    return S.cleanup_summary(lib.photos, lib.tags, lib.faces, lib.collection_photos)


DUPES = "(SELECT * FROM photos WHERE NOT private AND media_type = 'image' AND phash IN (SELECT phash FROM photos WHERE NOT private AND media_type = 'image' {} GROUP BY 1 HAVING count(*) > 1))"


@query("duplicate_groups", f"SELECT photo_id, phash, size FROM {DUPES.format('')}", ("photos",))
def _(lib):
    return S.duplicate_groups(lib.photos).select("photo_id", "phash", "size")


@query("duplicate_groups_in_folder", f"""SELECT photo_id, phash, folder FROM {DUPES.format("AND starts_with(folder, '/lib/3')")}""", ("photos",))
def _(lib):
    return S.duplicate_groups(lib.photos, "/lib/3").select("photo_id", "phash", "folder")


SCORED = f"""scored AS (SELECT *, CASE WHEN favorite THEN 100000.0E0 ELSE 0.0E0 END + CASE WHEN tag_count > 0 OR person_count > 0 OR collection_count > 0 THEN 20000.0E0 ELSE 0.0E0 END + CASE WHEN rating < 0 THEN -50000.0E0 ELSE rating * 2000.0E0 END
 + person_count * 800.0E0 + collection_count * 500.0E0 + CASE WHEN path LIKE '%.cr2' THEN 800 WHEN path LIKE '%.heic' THEN 500 WHEN path LIKE '%.png' THEN -50 WHEN path LIKE '%.tif' THEN -200 ELSE 0 END
 + CAST(width AS DOUBLE) * height / 1000000.0E0 * 150 + coalesce(blur_score, med, 0) * 1.5E0 + tag_count * 30.0E0 + size / 1048576.0E0 * 3 AS score
 FROM {COUNTS} JOIN (SELECT phash, quantile_cont(blur_score, 0.5) med FROM {DUPES.format('')} GROUP BY 1) USING (phash) WHERE NOT private AND media_type = 'image'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY phash ORDER BY score DESC, date_taken ASC NULLS LAST, photo_id) AS rk, tag_count > 0 OR person_count > 0 OR collection_count > 0 AS invested FROM scored)"""


@query("rank_keepers", f""", {SCORED} SELECT photo_id, phash, rk AS rank, round(score, 3) AS score, CAST(sum(CASE WHEN rk > 1 AND NOT invested THEN size ELSE 0 END) OVER (PARTITION BY phash) AS BIGINT) reclaimable, 0.95E0 AS confidence FROM ranked""")
def _(lib):
    out = R.rank_keepers(lib.photos, lib.tags, lib.faces, lib.collection_photos)
    return out.select("photo_id", "phash", F.col("rank").cast("long").alias("rank"), F.round("score", 3).alias("score"), "reclaimable", "confidence")


@query("explain_keepers", f""", {SCORED} SELECT photo_id, list_filter([CASE WHEN favorite THEN 'favorite' END, CASE WHEN rating > 0 THEN 'rated ' || rating END, CASE WHEN rating < 0 THEN 'rejected' END, CASE WHEN person_count > 0 THEN person_count || ' named faces' END, CASE WHEN collection_count > 0 THEN 'in ' || collection_count || ' collections' END, CASE WHEN tag_count > 0 THEN tag_count || ' tags' END, CASE WHEN path LIKE '%.heic' THEN 'better format' END], lambda x: x IS NOT NULL) AS reasons FROM ranked WHERE rk = 1""")
def _(lib):
    return R.rank_keepers(lib.photos, lib.tags, lib.faces, lib.collection_photos).filter("rank = 1").select("photo_id", "reasons")


@query("timeline_page", f"""SELECT day, count(*) n, list(photo_id ORDER BY created_at DESC, photo_id) photo_ids FROM (SELECT *, {T} AS day FROM photos WHERE NOT private ORDER BY day DESC, created_at DESC, photo_id LIMIT 200 OFFSET 50) GROUP BY 1""", ("photos",))
def _(lib):
    return R.timeline(lib.photos, 50, 200)


@query("timeline_month", f"""SELECT {T} AS day, count(*) n, list(photo_id ORDER BY created_at DESC, photo_id) photo_ids FROM photos WHERE NOT private AND folder = '/lib/5-LOW' AND strftime({T}, '%Y-%m') = '1996-03' GROUP BY 1""", ("photos",))
def _(lib):
    return R.timeline(lib.photos, 0, 1_000_000, "/lib/5-LOW", "1996-03")


@query("on_this_day", f"SELECT photo_id, {T} AS day FROM photos WHERE NOT private AND strftime({T}, '%m-%d') = '07-04'", ("photos",))
def _(lib):
    return R.on_this_day(lib.photos, "07-04")


@query("collision_free_names", """, n AS (SELECT photo_id, folder, 'IMG' || CAST(photo_id % 97 AS STRING) || '.jpg' AS name FROM photos)
SELECT photo_id, CASE WHEN r > 0 THEN replace(name, '.jpg', '-' || r || '.jpg') ELSE name END new_name FROM (SELECT *, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY photo_id) - 1 AS r FROM n)""", ("photos",))
def _(lib):
    rows = lib.photos.select("photo_id", "folder", F.concat(F.lit("IMG"), (F.col("photo_id") % 97).cast("string"), F.lit(".jpg")).alias("name"))
    return R.collision_free_names(rows, "folder", "name", "photo_id").select("photo_id", "new_name")


@query("bounded_recent", "SELECT provider, photo_id FROM (SELECT *, rank() OVER (PARTITION BY provider ORDER BY created_at DESC) r FROM provider_usage) WHERE r <= 50", ("provider_usage",))
def _(lib):
    return R.bounded_recent(lib.provider_usage, "provider", "created_at", 50).select("provider", "photo_id")


@query("largest_unassigned_face", "SELECT photo_id, face_id FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY (x2 - x1) * (y2 - y1) DESC, face_id) r FROM faces WHERE assignment <> 'named') WHERE r = 1", ("faces",))
def _(lib):
    return R.largest_unassigned_face(lib.faces)


@query("ordered_union", """, a AS (SELECT photo_id, row_number() OVER (ORDER BY photo_id) AS rank FROM photos WHERE favorite), b AS (SELECT photo_id, row_number() OVER (ORDER BY photo_id DESC) AS rank FROM photos WHERE rating = 5)
SELECT photo_id, 0 AS source, rank FROM a UNION ALL SELECT photo_id, 1, rank FROM b WHERE photo_id NOT IN (SELECT photo_id FROM a)""", ("photos",))
def _(lib):
    from ..functions.order import dense_positions

    p = lib.photos
    return R.ordered_union([dense_positions(p.filter("favorite"), "photo_id").select("photo_id", "rank"), dense_positions(p.filter("rating = 5"), "photo_id", descending=True).select("photo_id", "rank")])


@query("intersect_groups", "SELECT CAST(1 AS BIGINT) query_id, photo_id FROM photos WHERE favorite AND rating >= 3 AND media_type = 'image'", ("photos",))
def _(lib):
    p = lib.photos
    hit = lambda g, c: p.filter(c).select(F.lit(1).cast("long").alias("query_id"), F.lit(g).alias("group_id"), "photo_id")
    return R.intersect_groups(hit(1, "favorite").unionByName(hit(2, "rating >= 3")).unionByName(hit(3, "media_type = 'image'")))


EST = "CASE WHEN photo_id % 4 = 0 THEN 40.0E0 + photo_id % 7 END"


@query("map_points", f"SELECT photo_id, created_at, coalesce(gps_lat, e) lat, CASE WHEN gps_lat IS NULL THEN e ELSE gps_lon END lon, CASE WHEN gps_lat IS NULL THEN 'ai' ELSE 'gps' END AS source FROM (SELECT *, {EST} e FROM photos) WHERE NOT private AND coalesce(gps_lat, e) IS NOT NULL", ("photos",))
def _(lib):
    return R.map_points(lib.photos.withColumn("estimated_lat", F.expr(EST)).withColumn("estimated_lon", F.expr(EST)))


@query("dedupe_tags_by_case", """, v AS (SELECT photo_id, tag, photo_id * 10 AS tag_id FROM tags UNION ALL SELECT photo_id, upper(substr(tag, 1, 1)) || substr(tag, 2), photo_id * 10 + 1 FROM tags WHERE photo_id % 3 = 0 UNION ALL SELECT photo_id, upper(tag), photo_id * 10 + 2 FROM tags WHERE photo_id % 4 = 0)
SELECT photo_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, lower(tag) ORDER BY (substr(tag, 1, 1) <> lower(substr(tag, 1, 1))) DESC, tag_id, tag) r FROM v) WHERE r = 1""", ("tags",))
def _(lib):
    t = lib.tags
    up = t.filter("photo_id % 3 = 0").select("photo_id", F.concat(F.upper(F.substring("tag", 1, 1)), F.expr("substr(tag, 2)")).alias("tag"), (F.col("photo_id") * 10 + 1).alias("tag_id"))
    full = t.filter("photo_id % 4 = 0").select("photo_id", F.upper("tag").alias("tag"), (F.col("photo_id") * 10 + 2).alias("tag_id"))
    return R.dedupe_tags_by_case(t.select("photo_id", "tag", (F.col("photo_id") * 10).alias("tag_id")).unionByName(up).unionByName(full)).select("photo_id", "tag")
