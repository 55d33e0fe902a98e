"""Ingest, plans and exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import ingest as I
from .registry import query


def listing(lib):
    """Files derived from the photos: half are known, a quarter moved, some changed."""
    p = lib.photos
    path = F.when(F.col("photo_id") % 4 == 1, F.concat(F.lit("/card"), "path")).otherwise(F.col("path"))
    hashed = F.when(F.col("photo_id") % 4 == 2, F.md5(F.concat("hash", F.lit("x")))).otherwise(F.when(F.col("photo_id") % 4 == 3, F.md5((F.col("photo_id") - F.col("photo_id") % 8).cast("string"))).otherwise(F.col("hash")))
    return p.select(F.when(F.col("photo_id") % 4 == 3, F.concat(F.lit("/new"), "path")).otherwise(path).alias("path"), hashed.alias("hash"), F.col("size").alias("length"), F.col("created_at").alias("modificationTime"), "photo_id", "date_taken")


LIST = "l AS (SELECT CASE photo_id % 4 WHEN 1 THEN '/card' || path WHEN 3 THEN '/new' || path ELSE path END AS path, CASE photo_id % 4 WHEN 2 THEN md5(hash || 'x') WHEN 3 THEN md5(CAST(photo_id - photo_id % 8 AS VARCHAR)) ELSE hash END AS hash, size AS length, created_at AS modificationTime, photo_id, date_taken FROM photos), lib AS (SELECT * FROM photos WHERE photo_id % 8 <> 0)"


def library(lib):
    return lib.photos.filter("photo_id % 8 <> 0")


NAMES = "jpg jpeg png webp gif bmp tiff tif heic heif avif tga ico pnm pbm pgm ppm dds qoi cr2 cr3 nef arw dng srf sr2 orf rw2 raf pef raw mp4 mov avi mkv wmv flv webm m4v 3gp mts m2ts jfif jp2 psd svg jxl srw nrw x3f 3fr mpg mpeg txt MP4 Nef"
NAMED = f"named AS (SELECT photo_id, folder || '/f' || photo_id || '.' || string_split('{NAMES}', ' ')[CAST(photo_id % {len(NAMES.split())} AS INT) + 1] AS path FROM photos)"


def named(lib):
    """The photos under names of every extension that is told apart, and of some that are not."""
    ext = F.element_at(F.split(F.lit(NAMES), " "), (F.col("photo_id") % len(NAMES.split()) + 1).cast("int"))
    return lib.photos.select("photo_id", F.concat("folder", F.lit("/f"), "photo_id", F.lit("."), ext).alias("path"))


@query("classify_media", f", {NAMED} SELECT photo_id, CASE WHEN regexp_matches(lower(path), '[.](mp4|mov|avi|mkv|wmv|flv|webm|m4v|3gp|mts|m2ts)$') THEN 'video' WHEN regexp_matches(lower(path), '[.](cr2|cr3|nef|arw|dng|srf|sr2|orf|rw2|raf|pef|raw)$') THEN 'raw' ELSE 'image' END AS kind FROM named", ("photos",))
def _(lib):
    from ..sources.media import classify_media

    return named(lib).select("photo_id", classify_media().alias("kind"))


@query("media_files", f", {NAMED} SELECT photo_id, path FROM named WHERE NOT regexp_matches(path, '[.](jfif|jp2|psd|svg|jxl|srw|nrw|x3f|3fr|mpg|mpeg|txt)$')", ("photos",))
def _(lib):
    from ..sources.media import only_media

    return only_media(named(lib))


@query("format_priority", f", {NAMED} SELECT photo_id, CASE WHEN regexp_matches(lower(path), '[.](cr2|cr3|nef|arw|dng|orf|rw2|raf|pef|srw|x3f|3fr)$') THEN 800 WHEN regexp_matches(path, '[.](heic|heif|avif)$') THEN 500 WHEN path LIKE '%.png' THEN -50 WHEN regexp_matches(path, '[.](bmp|tif|tiff)$') THEN -200 ELSE 0 END AS points FROM named", ("photos",))
def _(lib):
    from ..operators.ranking import format_priority

    return named(lib).select("photo_id", format_priority().alias("points"))


@query("resume_scan", f", {LIST} SELECT photo_id FROM l WHERE photo_id % 3 <> 0 OR photo_id % 5 = 0", ("photos",))
def _(lib):
    files = listing(lib)
    done = files.filter("photo_id % 3 = 0").withColumn("length", F.when(F.col("photo_id") % 5 == 0, F.col("length") + 1).otherwise(F.col("length")))
    return I.resume_scan(files, done).select("photo_id")


@query("scan_checkpoint", f", {LIST} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, max(path) FILTER (photo_id % 3 = 0) AS last_path, count(*) FILTER (photo_id % 3 = 0) AS processed, count(*) AS total FROM l GROUP BY 1", ("photos",))
def _(lib):
    return I.scan_checkpoint(listing(lib), listing(lib).filter("photo_id % 3 = 0"))


@query("watch_state", f", {LIST} SELECT folder AS path, greatest(max(modificationTime), DATE '2002-06-01') AS last_checked FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, * FROM l WHERE photo_id % 4 IN (0, 2)) WHERE folder IN ('/lib/1-URGENT', '/lib/5-LOW') GROUP BY 1 UNION ALL SELECT '/none', NULL", ("photos",))
def _(lib):
    from ..streaming.watch import watch_state

    watch = lib.spark.createDataFrame([("/lib/1-URGENT", dt.date(2002, 6, 1)), ("/lib/5-LOW", dt.date(2002, 6, 1)), ("/none", None)], "path string, last_checked date")
    return watch_state(watch, listing(lib))


@query("content_hash", "SELECT doc_id, 'sha2:' || sha256(text) AS hash FROM documents WHERE text IS NOT NULL", None)
def _(lib):
    from ..sources.media import content_hash

    return lib.raw("documents").filter("text is not null").select("doc_id", content_hash("text").alias("hash"))


@query("reuse_hashes", "SELECT photo_id, CASE WHEN photo_id % 3 = 0 THEN 'cached' ELSE md5(path) END AS hash, photo_id % 3 = 0 AS reused FROM photos", ("photos",))
def _(lib):
    f = lib.photos.select("photo_id", "path", F.col("size").alias("length"), F.col("created_at").alias("modificationTime"))
    cache = lib.photos.select("path", F.when(F.col("photo_id") % 3 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("photo_id") % 3 == 2, F.date_add("created_at", 1)).otherwise(F.col("created_at")).alias("mtime"), F.lit("cached").alias("hash"))
    return I.reuse_hashes(f, cache, F.md5("path")).select("photo_id", "hash", "reused")


@query("updated_hash_cache", "SELECT path, CASE WHEN photo_id % 2 = 0 THEN md5(path) ELSE 'old' END AS hash FROM photos", ("photos",))
def _(lib):
    cache = lib.photos.select("path", "size", F.col("created_at").alias("mtime"), F.lit("old").alias("hash"))
    new = lib.photos.filter("photo_id % 2 = 0").select("path", F.col("size").alias("length"), F.col("created_at").alias("modificationTime"), F.md5("path").alias("hash"))
    return I.updated_hash_cache(cache, new).select("path", "hash")


@query("ingest_new_files", f", {LIST} SELECT path, min(hash) AS hash, path IN (SELECT path FROM lib) AS path_conflict FROM l WHERE hash NOT IN (SELECT hash FROM lib) GROUP BY path", ("photos",))
def _(lib):
    return I.ingest_new_files(listing(lib), library(lib)).select("path", "hash", "path_conflict")


@query("ingest_new_files_deduped", f", {LIST} SELECT min(path) AS path, hash FROM l WHERE hash NOT IN (SELECT hash FROM lib) GROUP BY hash", ("photos",))
def _(lib):
    return I.ingest_new_files(listing(lib), library(lib), True).select("path", "hash")


@query("scan_log", f", {LIST} SELECT '/card' AS folder, n AS new_files, t - n AS skipped, t AS total FROM (SELECT count(DISTINCT path) n FROM l WHERE hash NOT IN (SELECT hash FROM lib) AND path NOT IN (SELECT path FROM lib)), (SELECT count(*) t FROM l)", ("photos",))
def _(lib):
    files = listing(lib)
    return I.scan_log(I.ingest_new_files(files, library(lib)), files, "/card", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 5)).select("folder", "new_files", "skipped", "total")


@query("recent_scans", "SELECT event_id AS scan_id, ts AS started FROM events ORDER BY ts DESC, event_id DESC LIMIT 20", None)
def _(lib):
    return I.recent_scans(lib.raw("events").select(F.col("event_id").alias("scan_id"), F.col("ts").alias("started")), 20)


@query("oldest_plausible_date", """SELECT photo_id, CASE WHEN d2 < d1 OR d1 IS NULL THEN d2 ELSE d1 END AS date_taken FROM (SELECT photo_id, CASE WHEN photo_id % 3 = 0 THEN CAST(date_taken AS TIMESTAMP) + INTERVAL 9 HOUR END d1, CASE WHEN photo_id % 2 = 0 THEN TIMESTAMP '1993-05-06 12:00:00' ELSE CAST(created_at AS TIMESTAMP) END d2 FROM photos)""", ("photos",))
def _(lib):
    p = lib.photos
    rows = p.select("photo_id", F.when(F.col("photo_id") % 2 == 0, F.concat("folder", F.lit("/trip_1993-05-06/20991399_a.jpg"))).otherwise(F.col("path")).alias("path"), F.when(F.col("photo_id") % 3 == 0, F.date_format("date_taken", "yyyy:MM:dd '09:00:00'")).alias("exif_original"), F.lit("0000:00:00 00:00:00").alias("exif_digitized"), F.lit("garbage").alias("exif_datetime"), F.lit(None).cast("string").alias("gps_date"), F.col("created_at").alias("mtime"), F.lit("1970-01-01").cast("date").alias("birthtime"))
    return I.oldest_plausible_date(rows, dt.datetime(2024, 1, 1)).select("photo_id", "date_taken")


@query("normalise_manual_date", "SELECT photo_id, CASE photo_id % 4 WHEN 0 THEN date_trunc('year', CAST(created_at AS TIMESTAMP)) + INTERVAL 12 HOUR WHEN 1 THEN date_trunc('month', CAST(created_at AS TIMESTAMP)) + INTERVAL 12 HOUR WHEN 2 THEN CAST(created_at AS TIMESTAMP) + INTERVAL 12 HOUR END AS date_taken, photo_id % 4 = 3 AS rejected FROM photos", ("photos",))
def _(lib):
    d = F.when(F.col("photo_id") % 4 == 0, F.date_format("created_at", "yyyy")).when(F.col("photo_id") % 4 == 1, F.date_format("created_at", "yyyy-MM")).when(F.col("photo_id") % 4 == 2, F.date_format("created_at", " yyyy-MM-dd ")).otherwise("last summer")
    return I.normalise_manual_date(lib.photos.select("photo_id", d.alias("date"))).select("photo_id", "date_taken", "rejected")


@query("backfill_dates", "SELECT photo_id, coalesce(date_taken, CASE WHEN photo_id % 4 = 0 THEN DATE '1999-01-02' END, created_at) AS date_taken FROM photos", ("photos",))
def _(lib):
    found = lib.photos.filter("date_taken is null").select("photo_id", F.expr("CASE WHEN photo_id % 4 = 0 THEN DATE '1999-01-02' END").alias("metadata_date"), F.col("created_at").alias("file_date"))
    return I.backfill_dates(lib.photos, found).select("photo_id", "date_taken")


@query("gps_from_dms", """SELECT photo_id, CASE WHEN photo_id % 7 <> 0 THEN round(-(36 + (photo_id % 60) / 60.0E0 + (photo_id % 59) / 3600.0E0), 6) END AS gps_lat, CASE WHEN photo_id % 7 <> 0 THEN round(26 + 30 / 60.0E0, 6) END AS gps_lon FROM photos""", ("photos",))
def _(lib):
    rat = lambda n, d: F.struct(n.cast("long").alias("num"), d.cast("long").alias("den"))
    one = F.lit(1)
    rows = lib.photos.select("photo_id", F.array(rat(F.lit(36), one), rat(F.col("photo_id") % 60, F.when(F.col("photo_id") % 7 == 0, 0).otherwise(1)), rat(F.col("photo_id") % 59, one)).alias("lat"), F.lit("S").alias("lat_ref"), F.array(rat(F.lit(26), one), rat(F.lit(60), F.lit(2)), rat(F.lit(0), one)).alias("lon"), F.lit("E").alias("lon_ref"), rat(F.lit(5), one).alias("alt"))
    return I.gps_from_dms(rows).select("photo_id", F.round("gps_lat", 6).alias("gps_lat"), F.round("gps_lon", 6).alias("gps_lon"))


@query("plan_device_import", f""", {LIST}, n AS (SELECT hash, min(path) AS path, arg_min(coalesce(date_taken, modificationTime), path) AS d FROM l WHERE hash NOT IN (SELECT hash FROM lib) GROUP BY hash)
SELECT path, strftime(d, '%Y') || '/' || strftime(d, '%Y-%m') || ' - ' || monthname(d) AS target_dir FROM n""", ("photos",))
def _(lib):
    files = listing(lib).select("path", "hash", F.col("date_taken").alias("exif_date"), F.col("modificationTime").alias("mtime"))
    return I.plan_device_import(files, library(lib)).select("path", "target_dir")


@query("record_device_imports", f", {LIST} SELECT b.photo_id, max(a.photo_id) AS object_id FROM l a JOIN (SELECT hash, min(photo_id) photo_id FROM photos GROUP BY 1) b USING (hash) GROUP BY 1", ("photos",))
def _(lib):
    objects = listing(lib).select(F.lit("d1").alias("device_id"), F.col("photo_id").alias("object_id"), "hash")
    none = lib.spark.createDataFrame([], "photo_id long, device_id string, object_id long")
    return I.record_device_imports(none, objects, lib.photos).select("photo_id", "object_id")


@query("plan_device_cleanup", "SELECT photo_id AS object_id, CASE WHEN photo_id % 3 = 0 THEN 'not_imported' WHEN favorite THEN 'keep' ELSE 'delete' END AS action FROM photos", ("photos",))
def _(lib):
    objects = lib.photos.select(F.lit("d1").alias("device_id"), F.col("photo_id").alias("object_id"))
    imports = lib.photos.filter("photo_id % 3 <> 0").select("photo_id", F.lit("d1").alias("device_id"), F.col("photo_id").alias("object_id"))
    return I.plan_device_cleanup(objects, imports, lib.photos).select("object_id", "action")


@query("plan_collection_export", "SELECT collection_id, photo_id, 'IMG_' || lpad(CAST(photo_id AS VARCHAR), 7, '0') || '.' || split_part(path, '.', 2) AS target_name FROM collection_photos JOIN photos USING (photo_id)", ("photos", "collection_photos"))
def _(lib):
    return I.plan_collection_export(lib.photos, lib.collection_photos).select("collection_id", "photo_id", "target_name")


@query("missing_files", "SELECT photo_id FROM photos WHERE photo_id % 4 IN (1, 3)", ("photos",))
def _(lib):
    return I.missing_files(lib.photos, listing(lib)).select("photo_id")


@query("orphan_thumbnails", "SELECT count(*) n, CAST(sum(size) AS BIGINT) bytes FROM photos WHERE photo_id % 5 = 0", ("photos",))
def _(lib):
    thumbs = lib.photos.select(F.concat(F.when(F.col("photo_id") % 5 == 0, F.lit("zz")).otherwise(""), F.substring("hash", 1, 24), F.lit(".jpg")).alias("name"), "size")
    return I.orphan_thumbnails(thumbs, lib.photos).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("health_report", "SELECT count(*) FILTER (photo_id % 4 IN (1, 3)) orphaned, count(*) FILTER (photo_id % 5 = 0) missing_thumbnails, count(*) total FROM photos", ("photos",))
def _(lib):
    return I.health_report(lib.photos, listing(lib), lib.photos.filter("photo_id % 5 <> 0").select(I.thumbnail_name().alias("name")))


@query("relink", "SELECT photo_id, CASE WHEN photo_id % 6 = 0 THEN '/moved/' || photo_id || '.jpg' ELSE path END AS path, CASE WHEN photo_id % 6 = 0 THEN '/moved' ELSE folder END AS folder FROM photos", ("photos",))
def _(lib):
    prop = lib.photos.filter("photo_id % 6 < 2").select("photo_id", F.concat(F.lit("/moved/"), F.col("photo_id").cast("string"), F.lit(".jpg")).alias("new_path"), F.when(F.col("photo_id") % 6 == 0, F.col("hash")).otherwise("no").alias("new_hash"))
    return I.relink(lib.photos, prop)[0].select("photo_id", "path", "folder")


@query("parse_tag_responses", """SELECT photo_id, CASE photo_id % 5 WHEN 4 THEN [] ELSE ['red car', 'sea', 'tag' || photo_id % 9] END AS tags, CASE photo_id % 5 WHEN 0 THEN 'A view' END AS description, CASE photo_id % 5 WHEN 0 THEN 1.5E0 END AS lat FROM photos""", ("photos",))
def _(lib):
    n = (F.col("photo_id") % 9).cast("string")
    items = F.concat(F.lit('" Red Car ","sea", "TAG'), n, F.lit('"'))
    text = F.when(F.col("photo_id") % 5 == 0, F.concat(F.lit('```json\n{"tags": ['), items, F.lit('], "description": "A view", "location": {"name": "Bay", "lat": 1.5, "lon": 20}}\n```')))
    text = text.when(F.col("photo_id") % 5 == 1, F.concat(F.lit("["), items, F.lit("]"))).when(F.col("photo_id") % 5 == 2, F.concat(F.lit('Here you are: {"tags": ['), items, F.lit("]} Enjoy!")))
    text = text.when(F.col("photo_id") % 5 == 3, F.concat(F.lit("Tags:\n- Red Car\n* sea\n3. TAG"), n)).otherwise("I can't see it.\n- sorry")
    return I.parse_tag_responses(lib.photos.select("photo_id", text.alias("response"))).select("photo_id", "tags", "description", "lat")


@query("apply_tag_results", "SELECT photo_id, CASE photo_id % 4 WHEN 0 THEN 'tagged' WHEN 1 THEN 'error' ELSE status END AS status, CASE photo_id % 4 WHEN 0 THEN 'seen' END AS description FROM photos", ("photos",))
def _(lib):
    res = lib.photos.filter("photo_id % 4 < 2").select("photo_id", F.lit("p1").alias("provider"), (F.col("photo_id") % 4 == 0).alias("ok"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.lit("seen").alias("description"), F.lit(0.01).alias("cost_usd"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"))
    return I.apply_tag_results(lib.photos.withColumn("description", F.lit(None).cast("string")), lib.tags, lib.provider_usage, res)[0].select("photo_id", "status", "description")


@query("allocate_providers", "SELECT photo_id, CASE WHEN (row_number() OVER (ORDER BY photo_id) - 1) % 2 = 0 THEN 'a' ELSE 'c' END AS provider FROM photos", ("photos",))
def _(lib):
    return I.allocate_providers(lib.photos, lib.spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.14)], "name string, cost double"))


@query("cached_lookup", "SELECT photo_id, CASE WHEN lower(tag) LIKE 'red%' THEN 'v2' END AS val FROM tags", ("tags",))
def _(lib):
    t = lib.tags
    cache = t.filter("tag like 'red%'").select("tag").distinct()
    cache = cache.select("tag", F.lit("v1").alias("val"), F.lit(1).alias("created_at")).unionByName(cache.select(F.concat(F.upper("tag"), F.lit(" ")).alias("tag"), F.lit("v2").alias("val"), F.lit(2).alias("created_at")))
    return I.cached_lookup(t, cache, "tag", "val")[0].select("photo_id", "val")


@query("export_table", "SELECT photo_id, folder, coalesce(string_agg(tag, '; ' ORDER BY tag), '') AS tags, CAST(NULL AS DOUBLE) AS gps_lat FROM photos LEFT JOIN tags USING (photo_id) GROUP BY 1, 2", ("photos", "tags"))
def _(lib):
    return I.export_table(lib.photos, lib.tags, True).select("photo_id", "folder", "tags", "gps_lat")


@query("export_documents", "SELECT photo_id, count(tag) n, round(coalesce(sum(confidence), 0), 4) AS conf, any_value(gps_lat) AS lat FROM photos LEFT JOIN tags USING (photo_id) GROUP BY 1", ("photos", "tags"))
def _(lib):
    d = I.export_documents(lib.photos, lib.tags)
    t = F.coalesce("tags", F.array().cast(d.schema["tags"].dataType))
    return d.select("photo_id", F.size(t).cast("long").alias("n"), F.round(F.aggregate(t, F.lit(0.0), lambda s, x: s + x["confidence"]), 4).alias("conf"), F.col("gps.lat").alias("lat"))


@query("export_markdown", "SELECT folder, count(*) n FROM (SELECT folder FROM photos UNION ALL SELECT '' FROM (SELECT DISTINCT tag FROM tags LIMIT 50)) GROUP BY 1", ("photos", "tags"))
def _(lib):
    return I.markdown_lines(lib.photos, lib.tags).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_metadata", "SELECT p.hash, p.rating, t.tags, f.persons FROM photos p LEFT JOIN (SELECT photo_id, list(tag ORDER BY tag) tags FROM tags GROUP BY 1) t USING (photo_id) LEFT JOIN (SELECT photo_id, list_sort(list(DISTINCT name)) persons FROM faces JOIN persons USING (person_id) GROUP BY 1) f USING (photo_id) LEFT JOIN descriptions d USING (photo_id) WHERE tags IS NOT NULL OR persons IS NOT NULL OR coalesce(description, '') <> '' OR coalesce(rating, 0) <> 0 OR favorite", ("photos", "tags", "faces", "persons", "descriptions"))
def _(lib):
    p = lib.photos.join(lib.descriptions, "photo_id", "left")
    return I.snapshot_metadata(p, lib.tags, lib.faces, lib.persons).select("hash", "rating", F.transform("tags", lambda t: t["tag"]).alias("tags"), "persons")


def snap(lib):
    p = lib.photos.withColumn("description", F.expr("CASE WHEN photo_id % 10 = 0 THEN 'kept' END"))
    return p, I.snapshot_metadata(p.filter("photo_id % 10 < 3"), lib.tags, lib.faces, lib.persons)


@query("restore_metadata", "SELECT photo_id, CASE WHEN photo_id % 10 < 3 AND coalesce(rating, 0) <> 0 THEN rating ELSE 0 END AS rating, CASE WHEN photo_id % 10 = 0 AND (coalesce(rating, 0) <> 0 OR favorite OR true) THEN 'kept' END AS description FROM photos", ("photos",))
def _(lib):
    p, s = snap(lib)
    blank = p.withColumn("rating", F.lit(0)).withColumn("favorite", F.lit(False)).withColumn("description", F.lit(None).cast("string"))
    return I.restore_metadata(s, blank, lib.tags.limit(0), lib.faces, lib.persons)["photos"].select("photo_id", "rating", "description")


@query("restore_counts", "SELECT count(DISTINCT p.photo_id) photos, CAST(coalesce(sum(n), 0) AS BIGINT) tags, 0 AS new_persons FROM photos p LEFT JOIN (SELECT photo_id, count(*) n FROM tags GROUP BY 1) t USING (photo_id) WHERE photo_id % 10 < 3 AND (n IS NOT NULL OR coalesce(rating, 0) <> 0 OR favorite OR photo_id % 10 = 0 OR photo_id IN (SELECT photo_id FROM faces WHERE person_id IS NOT NULL))", ("photos", "tags", "faces"))
def _(lib):
    p, s = snap(lib)
    return I.restore_counts(s, p, lib.persons)


@query("metadata_sidecars", "SELECT p.photo_id, list_concat(coalesce(t.tags, []), coalesce(f.names, [])) AS subjects, CASE WHEN rating < 0 THEN -1 ELSE least(rating, 5) END AS xmp_rating, CASE WHEN favorite THEN 'Red' END AS label, round(coalesce(f.w, 0), 5) AS w FROM photos p LEFT JOIN (SELECT photo_id, list(tag ORDER BY tag) tags FROM tags GROUP BY 1) t USING (photo_id) LEFT JOIN (SELECT photo_id, list(DISTINCT name) names, sum(CAST(x2 - x1 AS DOUBLE) / width) w FROM faces JOIN persons USING (person_id) JOIN photos USING (photo_id) GROUP BY 1) f USING (photo_id)", ("photos", "tags", "faces", "persons"))
def _(lib):
    s = I.metadata_sidecars(lib.photos, lib.tags, lib.faces, lib.persons)
    w = F.aggregate(F.coalesce("regions", F.array().cast(s.schema["regions"].dataType)), F.lit(0.0), lambda a, r: a + r["w"])
    return s.select("photo_id", "subjects", "xmp_rating", "label", F.round(w, 5).alias("w"))


@query("sidecar_xml")
def _(lib):
    return I.sidecar_xml(I.metadata_sidecars(lib.photos, lib.tags, lib.faces, lib.persons))


@query("fix_health", "SELECT photo_id, tag FROM tags WHERE photo_id IN (SELECT photo_id FROM photos WHERE photo_id % 4 IN (0, 2)) OR photo_id NOT IN (SELECT photo_id FROM photos)", ("photos", "tags"))
def _(lib):
    return I.fix_health(lib.photos, listing(lib), {"tags": lib.tags}, lib.provider_usage)["tags"].select("photo_id", "tag")


@query("tag_and_export", "SELECT p.photo_id, len(list_distinct(list_concat(coalesce(t.tags, []), ['holiday']))) + len(coalesce(f.names, [])) AS n FROM photos p LEFT JOIN (SELECT photo_id, list(tag) tags FROM tags GROUP BY 1) t USING (photo_id) LEFT JOIN (SELECT photo_id, list(DISTINCT name) names FROM faces JOIN persons USING (person_id) GROUP BY 1) f USING (photo_id) WHERE p.photo_id % 30 = 0", ("photos", "tags", "faces", "persons"))
def _(lib):
    side = I.tag_and_export(lib.tags, lib.photos, lib.photos.filter("photo_id % 30 = 0"), ["holiday"], lib.faces, lib.persons)[1]
    return side.select("photo_id", F.size("subjects").cast("long").alias("n"))
