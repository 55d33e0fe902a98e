"""Filters, predicates and joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import filters as L
from .registry import query

T = "coalesce(date_taken, created_at)"
TAGS = "(SELECT photo_id, count(*) tag_count, list_sort(list(tag)) all_tags FROM tags GROUP BY 1)"


@query("photo_summary", f"SELECT photo_id, coalesce(tag_count, 0) tag_count, coalesce(all_tags[1:10], []) AS tags FROM photos LEFT JOIN {TAGS} USING (photo_id)", ("photos", "tags"))
def _(lib):
    return L.photo_summary(lib.photos, lib.tags).select("photo_id", "tag_count", "tags")


@query("list_photos", "SELECT photo_id, path FROM photos WHERE NOT private AND folder = '/lib/2-HIGH' AND status = 'tagged' AND photo_id IN (SELECT photo_id FROM tags WHERE tag = (SELECT min(tag) FROM tags)) ORDER BY created_at DESC, photo_id LIMIT 50", ("photos", "tags"))
def _(lib):
    tag = lib.tags.agg(F.min("tag").alias("tag"))
    hits = lib.tags.join(F.broadcast(tag), "tag", "left_semi").select("photo_id")
    return L.page(L.list_photos(lib.photos, lib.tags, "/lib/2-HIGH", "tagged").join(hits, "photo_id", "left_semi"), 0, 50).select("photo_id", "path")


@query("list_photos_total", "SELECT count(*) n FROM photos WHERE NOT private AND folder = '/lib/2-HIGH' AND status = 'tagged'", ("photos",))
def _(lib):
    return L.list_photos(lib.photos, lib.tags, "/lib/2-HIGH", "tagged").agg(F.count(F.lit(1)).alias("n"))


@query("visible_photos", "SELECT photo_id FROM photos WHERE NOT private", ("photos",))
def _(lib):
    from ..operators.stats import visible

    return visible(lib.photos).select("photo_id")


@query("vault_list", f"SELECT photo_id, {T} AS day FROM photos WHERE private", ("photos",))
def _(lib):
    return L.vault_list(lib.photos).select("photo_id", "day")


RULES = [{"field": "tag", "operator": "contains", "value": "RING"}, {"field": "folder", "operator": "contains", "value": "HIGH"}, {"field": "date_from", "operator": ">=", "value": "2002-03-01"}, {"field": "colour", "operator": "equals", "value": "x"}]


@query("smart_collection", "SELECT photo_id FROM photos WHERE NOT private AND lower(folder) LIKE '%high%' AND created_at >= DATE '2002-03-01' AND photo_id IN (SELECT photo_id FROM tags WHERE lower(tag) LIKE '%ring%') ORDER BY created_at DESC, photo_id LIMIT 1000", ("photos", "tags"))
def _(lib):
    return L.smart_collection(lib.photos, lib.tags, RULES, limit=1000).select("photo_id")


@query("smart_collection_strict", "SELECT photo_id FROM photos WHERE NOT private AND status <> 'tagged' AND folder = '/lib/5-LOW'", ("photos",))
def _(lib):
    return L.smart_collection(lib.photos, lib.tags, [{"field": "status", "operator": "not_equals", "value": "tagged"}, {"field": "folder", "operator": "equals", "value": "/lib/5-LOW"}], strict_ops=True).select("photo_id")


@query("field_filter", f"""SELECT photo_id FROM photos WHERE year(date_taken) BETWEEN 1994 AND 1996 AND coalesce(rating, 0) >= 3 AND NOT favorite AND path LIKE '%.jpg' AND photo_id NOT IN (SELECT photo_id FROM tags WHERE lower(tag) LIKE '%plate%')""", ("photos", "tags"))
def _(lib):
    return L.field_filter(L.photo_summary(lib.photos, lib.tags, 1_000_000), [("year", "1994-1996"), ("rating", ">=3"), ("!fav", "On"), ("ext", "JPG"), ("!tag", "Plate")]).select("photo_id")


@query("field_filter_person", f"""SELECT photo_id FROM photos WHERE coalesce(CAST(date_taken AS VARCHAR), '') <= '1997' AND media_type = 'image' AND photo_id NOT IN (SELECT photo_id FROM faces JOIN persons USING (person_id) WHERE lower(name) LIKE '%person 3%')""", ("photos", "faces", "persons"))
def _(lib):
    named = lib.faces.join(lib.persons, "person_id").select("photo_id", "name")
    return L.field_filter(L.photo_summary(lib.photos, lib.tags), [("before", "1997"), ("media", "image"), ("!person", "person 3")], named).select("photo_id")


@query("work_queue_pending", "SELECT photo_id FROM photos WHERE status = 'pending'", ("photos",))
def _(lib):
    return L.work_queue(lib.photos, "pending").select("photo_id")


@query("work_queue_phash", "SELECT photo_id FROM photos WHERE phash IS NULL AND media_type = 'image'", ("photos",))
def _(lib):
    return L.work_queue(lib.photos, "phash").select("photo_id")


@query("work_queue_blur", "SELECT photo_id FROM photos WHERE blur_score IS NULL AND media_type = 'image'", ("photos",))
def _(lib):
    return L.work_queue(lib.photos, "blur").select("photo_id")


@query("work_queue_clip", "SELECT face_id FROM (SELECT face_id, CASE WHEN face_id % 5 = 0 THEN NULL WHEN face_id % 5 = 1 THEN 'small' ELSE 'base' END clip_tier FROM faces) WHERE clip_tier IS DISTINCT FROM 'base'", ("faces",))
def _(lib):
    f = lib.faces.withColumn("clip_emb", F.col("embedding")).withColumn("clip_tier", F.expr("CASE WHEN face_id % 5 = 0 THEN NULL WHEN face_id % 5 = 1 THEN 'small' ELSE 'base' END"))
    return L.work_queue(f, "clip", "base").select("face_id")


@query("photos_by_ids", "SELECT photo_id, rating, r AS rank FROM photos JOIN (SELECT o_orderkey photo_id, row_number() OVER (ORDER BY o_orderkey DESC) r FROM orders WHERE o_orderkey % 100 = 7) USING (photo_id) WHERE NOT private", ("photos",))
def _(lib):
    from ..functions.order import dense_positions

    ids = dense_positions(lib.raw("orders").filter("o_orderkey % 100 = 7").select(F.col("o_orderkey").alias("photo_id")), "photo_id", descending=True)
    return L.photos_by_ids(lib.photos, ids).select("photo_id", "rating", "rank")


@query("photo_detail", "SELECT photo_id, path, t AS tags FROM photos LEFT JOIN (SELECT photo_id, list_sort(list(tag || '|' || source)) t FROM tags GROUP BY 1) USING (photo_id) WHERE photo_id % 50 = 3", ("photos", "tags"))
def _(lib):
    ids = lib.photos.filter("photo_id % 50 = 3").select("photo_id")
    return L.photo_detail(lib.photos, lib.tags, ids).select("photo_id", "path", F.transform("tags", lambda t: F.concat(t["tag"], F.lit("|"), t["source"])).alias("tags"))


@query("folder_scope_exact", "SELECT photo_id FROM photos WHERE folder = '/lib/3-MEDIUM'", ("photos",))
def _(lib):
    return L.folder_scope(lib.photos, "/lib/3-MEDIUM").select("photo_id")


@query("folder_scope_prefix", "SELECT photo_id FROM photos WHERE starts_with(folder, '/lib/4')", ("photos",))
def _(lib):
    return L.folder_scope(lib.photos, "/lib/4", "prefix").select("photo_id")


HEX = "lpad(to_hex(CAST(photo_id * 7919 % 16777216 AS BIGINT)), 6, '0')"


@query("search_by_color", """SELECT photo_id FROM photos WHERE NOT private AND sqrt(pow((photo_id * 7919 % 16777216) // 65536 - 32, 2) + pow((photo_id * 7919 % 16777216) // 256 % 256 - 64, 2) + pow((photo_id * 7919 % 16777216) % 256 - 96, 2)) <= 60""", ("photos",))
def _(lib):
    p = lib.photos.withColumn("dominant_colors", F.array(F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("photo_id") * 7919 % 16777216), 6, "0")))))
    return L.search_by_color(p, "#204060", 60).select("photo_id")


@query("rename_preview", """SELECT photo_id, CASE WHEN photo_id % 3 = 0 THEN 'New_York_' ELSE '' END || CASE WHEN photo_id % 2 = 0 THEN 'a_red_car_on_' ELSE '' END || CASE WHEN date_taken IS NULL THEN '' ELSE strftime(date_taken, '%Y-%m-%d') || '_' END || lpad(CAST(photo_id % 900 AS VARCHAR), 3, '0') || '.' || regexp_extract(path, '[.]([a-z0-9]+)$', 1) AS new_name FROM photos""", ("photos",))
def _(lib):
    p = lib.photos.select("photo_id", "path", (F.col("photo_id") % 900).alias("ord"), F.expr("CASE WHEN photo_id % 3 = 0 THEN ' New York!' END").alias("location"), F.expr("CASE WHEN photo_id % 2 = 0 THEN ' a red  car on the hill' END").alias("description"), F.col("date_taken").alias("date"))
    return L.rename_preview(p).select("photo_id", "new_name")


@query("sharpness_rules", """SELECT photo_id, greatest(blur_score, c, m) sharp, coalesce(c >= 150 AND blur_score > 0 AND c / CASE WHEN blur_score > 0 THEN blur_score END >= 1.5, false) AS bokeh FROM (SELECT photo_id, blur_score, CAST(photo_id % 700 AS DOUBLE) c, CAST(photo_id % 300 AS DOUBLE) m FROM photos WHERE blur_score IS NOT NULL)""", ("photos",))
def _(lib):
    p = lib.photos.filter("blur_score is not null").withColumn("c", (F.col("photo_id") % 700).cast("double")).withColumn("m", (F.col("photo_id") % 300).cast("double"))
    return p.select("photo_id", L.effective_sharpness("blur_score", "c", "m").alias("sharp"), F.coalesce(L.is_bokeh("blur_score", "c"), F.lit(False)).alias("bokeh"))


@query("photos_with_tag", "SELECT photo_id FROM photos WHERE NOT private AND photo_id IN (SELECT photo_id FROM tags WHERE lower(tag) LIKE '%hot%')", ("photos", "tags"))
def _(lib):
    return L.list_photos(lib.photos, lib.tags).join(lib.tags.filter(L.contains("tag", "HOT")).select("photo_id"), "photo_id", "left_semi").select("photo_id")


@query("search_person", "SELECT photo_id FROM photos WHERE NOT private AND photo_id IN (SELECT photo_id FROM faces JOIN persons USING (person_id) WHERE lower(name) LIKE '%son 4%')", ("photos", "faces", "persons"))
def _(lib):
    return L.search_person(lib.photos, lib.faces, lib.persons, "SON 4").select("photo_id")


@query("related_tags", ", x AS (SELECT min(tag) tag FROM tags) SELECT tag, count(*) n FROM tags WHERE tag <> (SELECT tag FROM x) AND photo_id IN (SELECT photo_id FROM tags WHERE tag = (SELECT tag FROM x)) GROUP BY 1 ORDER BY n DESC, tag LIMIT 30", ("tags",))
def _(lib):
    mine = F.broadcast(lib.tags.agg(F.min("tag").alias("tag")))
    ids = lib.tags.join(mine, "tag", "left_semi").select("photo_id")
    marked = lib.tags.join(ids, "photo_id", "left_semi").join(mine, "tag", "left_anti").unionByName(lib.tags.join(mine, "tag", "left_semi").withColumn("tag", F.lit("$self")))
    return L.related_tags(marked, "$SELF", 30)


@query("tag_cooccurrence", "SELECT a.tag a, b.tag b, count(*) n FROM (SELECT DISTINCT photo_id, lower(tag) tag FROM tags) a JOIN (SELECT DISTINCT photo_id, lower(tag) tag FROM tags) b ON a.photo_id = b.photo_id AND a.tag < b.tag GROUP BY 1, 2 HAVING count(*) >= 2", ("tags",))
def _(lib):
    return L.tag_cooccurrence(lib.tags)


@query("faces_to_scan", "SELECT photo_id, CASE WHEN path LIKE '%.jpg' OR path LIKE '%.png' THEN 0 ELSE 1 END AS first FROM photos WHERE NOT private AND folder = '/lib/2-HIGH' AND photo_id NOT IN (SELECT photo_id FROM faces) AND photo_id NOT IN (SELECT photo_id FROM tags WHERE lower(tag) IN ('red plate', 'hot ring'))", ("photos", "faces", "tags"))
def _(lib):
    return L.faces_to_scan(lib.photos, lib.faces, lib.tags, "/lib/2-HIGH", ("red plate", "hot ring")).select("photo_id", "first")


ART = "Painting,drawing,CARTOON,illustration,anime,manga,comic,comic book,sculpture,statue,artwork,digital art,concept art,pencil drawing,ink drawing,oil painting,watercolor,sketch,poster,graffiti,resim,çizim,karikatür,illüstrasyon,heykel,tablo,sanat eseri,çizgi film,çizgi roman,suluboya,yağlı boya,eskiz,render,portrait,photo,old painting,drawings,art,book,film"


@query("faces_to_scan_art", f"SELECT photo_id FROM photos WHERE NOT private AND photo_id NOT IN (SELECT photo_id FROM faces) AND photo_id NOT IN (SELECT photo_id FROM tags) AND string_split('{ART}', ',')[CAST(photo_id % {ART.count(',') + 1} AS INT) + 1] IN ('render', 'portrait', 'photo', 'old painting', 'drawings', 'art', 'book', 'film') UNION ALL SELECT photo_id FROM photos WHERE NOT private AND photo_id NOT IN (SELECT photo_id FROM faces) AND photo_id IN (SELECT photo_id FROM tags)", ("photos", "faces", "tags"))
def _(lib):
    word = F.element_at(F.split(F.lit(ART), ","), (F.col("photo_id") % (ART.count(",") + 1) + 1).cast("int"))
    art = lib.photos.join(lib.tags.select("photo_id"), "photo_id", "left_anti").select("photo_id", word.alias("tag"))
    return L.faces_to_scan(lib.photos, lib.faces, art.unionByName(lib.tags.select("photo_id", "tag"))).select("photo_id")


@query("blurry_photos", "SELECT photo_id, blur_score FROM photos WHERE NOT private AND blur_score < 300 AND NOT favorite AND coalesce(rating, 0) < 3 AND photo_id NOT IN (SELECT photo_id FROM tags) AND photo_id NOT IN (SELECT photo_id FROM faces WHERE assignment = 'named') AND photo_id NOT IN (SELECT photo_id FROM collection_photos)")
def _(lib):
    return L.blurry_photos(lib.photos, lib.tags, lib.faces, lib.collection_photos, 300).select("photo_id", "blur_score")


@query("blurry_photos_all", "SELECT photo_id FROM photos WHERE NOT private AND blur_score < 300", ("photos",))
def _(lib):
    return L.blurry_photos(lib.photos, lib.tags, lib.faces, lib.collection_photos, 300, True).select("photo_id")


@query("faces_with_person", "SELECT face_id, photo_id, x1, name FROM faces LEFT JOIN persons USING (person_id)", ("faces", "persons"))
def _(lib):
    return L.faces_with_person(lib.faces, lib.persons).select("face_id", "photo_id", "x1", "name")


@query("known_faces", "SELECT face_id, person_id FROM faces WHERE assignment = 'named' AND embedding IS NOT NULL", ("faces",))
def _(lib):
    return L.known_faces(lib.faces).select("face_id", "person_id")


@query("unassigned_faces", "SELECT face_id FROM faces WHERE assignment = 'unassigned' AND photo_id IN (SELECT photo_id FROM photos WHERE NOT private)", ("faces", "photos"))
def _(lib):
    return L.unassigned_faces(lib.faces, lib.photos).select("face_id")


@query("propagatable_faces", "SELECT face_id FROM faces WHERE assignment <> 'named' AND photo_id IN (SELECT photo_id FROM photos WHERE NOT private AND folder = '/lib/1-URGENT')", ("faces", "photos"))
def _(lib):
    return L.unassigned_faces(lib.faces, lib.photos, "/lib/1-URGENT", True).select("face_id")


WATCH = [("/lib",), ("/lib/1-URGENT",), ("/lib/2-HIGH/",), ("/lib/2",), ("/other",)]


@query("watch_folder_counts", "SELECT w.path, count(p.photo_id) n FROM (VALUES ('/lib'),('/lib/1-URGENT'),('/lib/2-HIGH/'),('/lib/2'),('/other')) w(path) LEFT JOIN photos p ON p.folder = rtrim(w.path, '/') OR starts_with(p.folder, rtrim(w.path, '/') || '/') GROUP BY 1", ("photos",))
def _(lib):
    return L.watch_folder_counts(lib.spark.createDataFrame(WATCH, "path string"), lib.photos)


@query("touch_watch_folders", "SELECT w.path, max(p.created_at) AS last_checked FROM (VALUES ('/lib'),('/lib/1-URGENT'),('/lib/2-HIGH/'),('/lib/2'),('/other')) w(path) LEFT JOIN photos p ON p.photo_id % 41 = 0 AND (p.folder = rtrim(w.path, '/') OR starts_with(p.folder, rtrim(w.path, '/') || '/')) GROUP BY 1", ("photos",))
def _(lib):
    watch = lib.spark.createDataFrame(WATCH, "path string").withColumn("last_checked", F.lit(None).cast("date"))
    events = lib.photos.filter("photo_id % 41 = 0").select(F.upper(F.regexp_replace("folder", "/", "\\\\")).alias("folder"), F.col("created_at").alias("ts"))
    return L.touch_watch_folders(watch, events).select("path", "last_checked")


@query("person_tags", "SELECT DISTINCT photo_id, name AS tag, 'face' AS source FROM faces JOIN persons USING (person_id)", ("faces", "persons"))
def _(lib):
    return L.person_tags(lib.faces, lib.persons).select("photo_id", "tag", "source")


@query("person_timeline", f"SELECT photo_id, {T} AS day FROM photos WHERE NOT private AND photo_id IN (SELECT photo_id FROM faces WHERE person_id = 3)", ("photos", "faces"))
def _(lib):
    return L.person_timeline(lib.photos, lib.faces, 3)


_ = dt
