"""Set-based maintenance of tags, photos, collections and faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintain as M
from .registry import query


def incoming(lib):
    return lib.tags.filter("photo_id % 3 = 0").select("photo_id", F.initcap("tag").alias("tag"), F.lit(5.0).alias("confidence"), F.lit("new").alias("source"), F.lit(1).alias("ord")).unionByName(
        lib.photos.filter("photo_id % 4 = 0").select("photo_id", F.lit("fresh").alias("tag"), F.lit(1.0).alias("confidence"), F.lit("new").alias("source"), F.lit(2).alias("ord"))
    )


@query("upsert_tags", """SELECT photo_id, CASE WHEN photo_id % 3 = 0 THEN upper(substr(tag, 1, 1)) || lower(substr(split_part(tag, ' ', 1), 2)) || ' ' || upper(substr(split_part(tag, ' ', 2), 1, 1)) || substr(split_part(tag, ' ', 2), 2) ELSE tag END AS tag, CASE WHEN photo_id % 3 = 0 THEN greatest(confidence, 5.0) ELSE confidence END AS confidence, CASE WHEN photo_id % 3 = 0 THEN 'new' ELSE source END AS source FROM tags
UNION ALL SELECT photo_id, 'fresh', 1.0, 'new' FROM photos WHERE photo_id % 4 = 0""", ("photos", "tags"))
def _(lib):
    return M.upsert_tags(lib.tags, incoming(lib))


@query("add_manual_tags", "SELECT photo_id, tag, source FROM tags UNION ALL SELECT photo_id, t.tag, 'manual' FROM photos p, (VALUES ('red plate'), ('holiday')) t(tag) WHERE photo_id % 7 = 0 AND NOT EXISTS (SELECT 1 FROM tags x WHERE x.photo_id = p.photo_id AND x.tag = t.tag)", ("photos", "tags"))
def _(lib):
    return M.add_manual_tags(lib.tags, lib.photos.filter("photo_id % 7 = 0"), ["red plate", "holiday"]).select("photo_id", "tag", "source")


@query("remove_tags", "SELECT photo_id, tag FROM tags WHERE NOT (photo_id % 5 = 0 AND tag = 'red plate')", ("tags",))
def _(lib):
    return M.remove_tags(lib.tags, lib.photos.filter("photo_id % 5 = 0").select("photo_id", F.lit("RED Plate").alias("tag")), any_case=True).select("photo_id", "tag")


@query("merge_tags", "SELECT DISTINCT photo_id, CASE WHEN tag IN ('red plate', 'hot plate') THEN 'plate' WHEN tag = 'hot ring' THEN 'large rod' ELSE tag END AS tag FROM tags", ("tags",))
def _(lib):
    mapping = lib.spark.createDataFrame([("red plate", "plate"), ("hot plate", "plate"), ("hot ring", "large rod")], "source string, target string")
    return M.merge_tags(lib.tags, mapping).select("photo_id", "tag")


@query("delete_tags", "SELECT photo_id, tag FROM tags WHERE tag NOT IN ('red plate', 'hot ring')", ("tags",))
def _(lib):
    return M.delete_tags(lib.tags, lib.spark.createDataFrame([("red plate",), ("hot ring",)], "tag string")).select("photo_id", "tag")


@query("set_ratings", "SELECT photo_id, CASE WHEN photo_id % 10 = 0 THEN 4 ELSE rating END AS rating FROM photos", ("photos",))
def _(lib):
    return M.update_columns(lib.photos, lib.photos.filter("photo_id % 10 = 0").select("photo_id", F.lit(4).alias("rating")), "photo_id", ["rating"]).select("photo_id", "rating")


@query("set_flags", "SELECT photo_id, CASE WHEN photo_id % 9 = 0 THEN true ELSE favorite END AS favorite, CASE WHEN photo_id % 9 = 0 THEN false ELSE private END AS private FROM photos", ("photos",))
def _(lib):
    return M.update_columns(lib.photos, lib.photos.filter("photo_id % 9 = 0").select("photo_id", F.lit(True).alias("favorite"), F.lit(False).alias("private")), "photo_id", ["favorite", "private"]).select("photo_id", "favorite", "private")


@query("set_status", "SELECT photo_id, CASE WHEN photo_id IN (SELECT photo_id FROM descriptions) THEN 'tagged' ELSE status END AS status FROM photos", ("photos", "descriptions"))
def _(lib):
    return M.update_columns(lib.photos, lib.descriptions.select("photo_id", F.lit("tagged").alias("status")), "photo_id", ["status"]).select("photo_id", "status")


@query("set_description", "SELECT photo_id, d.description FROM photos LEFT JOIN descriptions d USING (photo_id)", ("photos", "descriptions"))
def _(lib):
    return M.update_columns(lib.photos.withColumn("description", F.lit(None).cast("string")), lib.descriptions, "photo_id", ["description"]).select("photo_id", "description")


@query("set_location", "SELECT photo_id, CASE WHEN photo_id % 6 = 1 AND gps_lat IS NULL THEN 'Somewhere' END AS estimated_location FROM photos", ("photos",))
def _(lib):
    p = lib.photos.withColumn("estimated_lat", F.lit(None).cast("double")).withColumn("estimated_lon", F.lit(None).cast("double")).withColumn("estimated_location", F.lit(None).cast("string"))
    c = p.filter("photo_id % 6 = 1").select("photo_id", F.lit(1.5).alias("estimated_lat"), F.lit(2.5).alias("estimated_lon"), F.lit("Somewhere").alias("estimated_location"))
    return M.set_location(p, c, keep_real_gps=True).select("photo_id", "estimated_location")


@query("reset_errors", "SELECT photo_id, CASE status WHEN 'error' THEN 'pending' ELSE status END AS status FROM photos", ("photos",))
def _(lib):
    return M.reset_errors(lib.photos).select("photo_id", "status")


@query("retag_photos", "SELECT photo_id, CASE WHEN photo_id % 8 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN photo_id % 8 = 0 THEN NULL ELSE description END AS description FROM photos LEFT JOIN descriptions USING (photo_id)", ("photos", "descriptions"))
def _(lib):
    p = lib.photos.join(lib.descriptions, "photo_id", "left")
    return M.retag(p, lib.tags, lib.photos.filter("photo_id % 8 = 0"))[0].select("photo_id", "status", "description")


@query("retag_tags", "SELECT photo_id, tag FROM tags WHERE photo_id % 8 <> 0", ("tags",))
def _(lib):
    return M.retag(lib.photos, lib.tags, lib.photos.filter("photo_id % 8 = 0"))[1].select("photo_id", "tag")


@query("record_usage", "SELECT provider, photo_id FROM provider_usage UNION ALL SELECT 'p9', photo_id FROM photos WHERE status = 'pending'", ("photos", "provider_usage"))
def _(lib):
    u = lib.provider_usage
    new = lib.photos.filter("status = 'pending'").select(F.lit("p9").alias("provider"), "photo_id", F.lit(True).alias("success"), F.lit(0.001).alias("cost_usd"), F.lit("2024-02-01").cast("timestamp_ntz").alias("created_at"))
    return M.record_usage(u, new).select("provider", "photo_id")


@query("add_members", "SELECT collection_id, photo_id FROM collection_photos UNION SELECT CAST(3 AS BIGINT), photo_id FROM photos WHERE photo_id % 16 = 0", ("photos", "collection_photos"))
def _(lib):
    return M.add_members(lib.collection_photos, lib.photos.filter("photo_id % 16 = 0").select(F.lit(3).cast("long").alias("collection_id"), "photo_id"))


@query("remove_members", "SELECT collection_id, photo_id FROM collection_photos WHERE NOT (collection_id = 3 AND photo_id % 16 = 0)", ("collection_photos",))
def _(lib):
    return M.remove_members(lib.collection_photos, lib.photos.filter("photo_id % 16 = 0").select(F.lit(3).cast("long").alias("collection_id"), "photo_id"))


@query("delete_collections", "SELECT collection_id, photo_id FROM collection_photos WHERE collection_id NOT IN (1, 4)", ("collection_photos",))
def _(lib):
    c = lib.collection_photos.select("collection_id").distinct()
    return M.delete_collections(c, lib.collection_photos, c.filter("collection_id in (1, 4)"))[1]


@query("collections_from_folders", "SELECT CASE WHEN folder = '/lib/2-HIGH' THEN NULL ELSE 'lib / ' || split_part(folder, '/', 3) END AS name, photo_id FROM photos WHERE folder <> '/lib/2-HIGH'", ("photos",))
def _(lib):
    return M.collections_from_folders(lib.photos, lib.spark.createDataFrame([("lib / 2-HIGH",)], "name string")).select("name", "photo_id")


@query("delete_photos", "SELECT 'photos' AS tab, count(*) n FROM photos WHERE photo_id % 6 <> 2 UNION ALL SELECT 'tags', count(*) FROM tags WHERE photo_id % 6 <> 2 UNION ALL SELECT 'faces', count(*) FROM faces WHERE NOT (photo_id % 6 = 2 AND photo_id IN (SELECT photo_id FROM photos)) UNION ALL SELECT 'usage', count(*) FROM provider_usage WHERE photo_id % 6 <> 2 OR photo_id NOT IN (SELECT photo_id FROM photos)", ("photos", "tags", "faces", "provider_usage"))
def _(lib):
    out = M.delete_photos(lib.photos.filter("photo_id % 6 = 2"), lib.photos, {"tags": lib.tags, "faces": lib.faces}, lib.provider_usage)
    n = lambda name, df: df.agg(F.count("photo_id").alias("n")).select(F.lit(name).alias("tab"), "n")
    return n("photos", out["photos"]).unionByName(n("tags", out["tags"])).unionByName(n("faces", out["faces"])).unionByName(n("usage", out["usage"]))


PLAN = "p AS (SELECT first_value(photo_id) OVER w AS keeper_id, photo_id AS dupe_id, row_number() OVER w AS ord FROM photos WHERE phash IN (SELECT phash FROM photos GROUP BY 1 HAVING count(*) > 1) WINDOW w AS (PARTITION BY phash ORDER BY photo_id)), plan AS (SELECT * FROM p WHERE keeper_id <> dupe_id)"


def plan(lib):
    from pyspark.sql import Window

    w = Window.partitionBy("phash").orderBy("photo_id")
    p = lib.photos.filter("phash is not null").select(F.first("photo_id").over(w).alias("keeper_id"), F.col("photo_id").alias("dupe_id"), F.row_number().over(w).alias("ord"))
    return p.filter("keeper_id <> dupe_id")


@query("merge_duplicates_photos", f""", {PLAN}, ph AS (SELECT * FROM photos LEFT JOIN descriptions USING (photo_id)) SELECT k.photo_id, greatest(k.rating, max(d.rating)) AS rating, k.favorite OR coalesce(bool_or(d.favorite), false) AS favorite, coalesce(CASE WHEN trim(coalesce(k.description, '')) <> '' THEN k.description END, arg_min(d.description, plan.ord) FILTER (trim(d.description) <> ''), k.description) AS description
FROM ph k LEFT JOIN plan ON plan.keeper_id = k.photo_id LEFT JOIN ph d ON d.photo_id = plan.dupe_id WHERE k.photo_id NOT IN (SELECT dupe_id FROM plan) GROUP BY k.photo_id, k.rating, k.favorite, k.description""", ("photos", "descriptions"))
def _(lib):
    p = lib.photos.join(lib.descriptions, "photo_id", "left")
    return M.merge_duplicates(plan(lib), p, lib.tags)[0].select("photo_id", "rating", "favorite", "description")


@query("merge_duplicates_tags", f""", {PLAN} SELECT DISTINCT coalesce(keeper_id, photo_id) AS photo_id, tag FROM tags LEFT JOIN plan ON dupe_id = photo_id""", ("photos", "tags"))
def _(lib):
    p = lib.photos.withColumn("description", F.lit(None).cast("string"))
    return M.merge_duplicates(plan(lib), p, lib.tags)[1].select("photo_id", "tag")


@query("migrate_hashes", "SELECT photo_id, CAST(NULL AS DOUBLE) blur_score, CASE WHEN media_type <> 'video' THEN phash END AS phash FROM photos", ("photos",))
def _(lib):
    return M.migrate_hashes(lib.photos).select("photo_id", "blur_score", "phash")


@query("edit_watch_folders", "SELECT * FROM (SELECT DISTINCT folder AS path, folder <> '/lib/5-LOW' AS enabled, folder = '/lib/5-LOW' AS auto_tag FROM photos WHERE folder <> '/lib/1-URGENT') UNION ALL SELECT '/new', true, false", ("photos",))
def _(lib):
    watch = lib.photos.select(F.col("folder").alias("path")).distinct().withColumn("enabled", F.lit(True)).withColumn("auto_tag", F.lit(False))
    changes = lib.spark.createDataFrame([("/new", "add", None, None), ("/lib/5-LOW", "add", False, None), ("/lib/1-URGENT", "remove", None, None), ("/lib/5-LOW", "set", False, True)], "path string, action string, enabled boolean, auto_tag boolean")
    return M.edit_watch_folders(watch, changes)


@query("assign_faces", "SELECT face_id, CASE WHEN face_id % 7 = 0 THEN NULL WHEN face_id % 7 = 1 THEN CAST(4 AS BIGINT) ELSE person_id END AS person_id, CASE WHEN face_id % 7 = 0 THEN 'unassigned' WHEN face_id % 7 = 1 THEN 'named' ELSE assignment END AS assignment FROM faces", ("faces",))
def _(lib):
    c = lib.faces.filter("face_id % 7 < 2").select("face_id", F.expr("CASE WHEN face_id % 7 = 1 THEN CAST(4 AS BIGINT) END").alias("person_id"))
    return M.assign_faces(lib.faces, c).select("face_id", "person_id", "assignment")


@query("merge_persons_faces", "SELECT face_id, CASE WHEN person_id IN (2, 3, 5) THEN 7 ELSE person_id END AS person_id FROM faces", ("faces",))
def _(lib):
    m = lib.spark.createDataFrame([(2, 3), (3, 7), (5, 7)], "source long, target long")
    return M.merge_persons(lib.faces, lib.persons, m)[0].select("face_id", "person_id")


@query("merge_persons_left", "SELECT person_id, name FROM persons WHERE person_id NOT IN (2, 3, 5)", ("persons",))
def _(lib):
    m = lib.spark.createDataFrame([(2, 3), (3, 7), (5, 7)], "source long, target long")
    return M.merge_persons(lib.faces, lib.persons, m)[1].select("person_id", "name")


@query("undo_skip", "SELECT face_id, CASE WHEN assignment = 'skipped' AND face_id % 2 = 0 THEN 'unassigned' ELSE assignment END AS assignment FROM faces", ("faces",))
def _(lib):
    return M.set_assignment(lib.faces, "unassigned", lib.faces.filter("face_id % 2 = 0"), only="skipped").select("face_id", "assignment")


@query("reset_all_skipped", "SELECT face_id, CASE assignment WHEN 'skipped' THEN 'unassigned' ELSE assignment END AS assignment FROM faces", ("faces",))
def _(lib):
    return M.set_assignment(lib.faces, "unassigned", only="skipped").select("face_id", "assignment")


@query("skip_all_unassigned", "SELECT face_id, CASE assignment WHEN 'unassigned' THEN 'skipped' ELSE assignment END AS assignment FROM faces", ("faces",))
def _(lib):
    return M.set_assignment(lib.faces, "skipped", only="unassigned").select("face_id", "assignment")


@query("clear_all_faces", "SELECT face_id, CAST(NULL AS BIGINT) person_id, 'unassigned' AS assignment FROM faces", ("faces",))
def _(lib):
    return M.set_assignment(lib.faces, "unassigned").select("face_id", "person_id", "assignment")


@query("undo_name", "SELECT face_id, CASE WHEN person_id = 4 THEN NULL ELSE person_id END AS person_id, CASE WHEN person_id = 4 THEN 'unassigned' ELSE assignment END AS assignment FROM faces", ("faces",))
def _(lib):
    return M.undo_name(lib.faces, lib.tags, lib.persons, lib.persons.filter("person_id = 4"), True)[0].select("face_id", "person_id", "assignment")


@query("rename_persons", "SELECT person_id, CASE WHEN person_id <= 3 THEN 'X ' || name ELSE name END AS name FROM persons", ("persons",))
def _(lib):
    return M.rename_persons(lib.persons, lib.persons.filter("person_id <= 3").select("person_id", F.concat(F.lit("X "), "name").alias("name")))


@query("assign_person_to_photos", """, big AS (SELECT photo_id, face_id FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY (x2 - x1) * (y2 - y1) DESC, face_id) r FROM faces WHERE assignment <> 'named') WHERE r = 1)
SELECT f.face_id, CASE WHEN b.face_id IS NOT NULL THEN CAST(5 AS BIGINT) ELSE f.person_id END AS person_id FROM faces f LEFT JOIN big b ON b.face_id = f.face_id AND b.photo_id % 5 = 0""", ("faces",))
def _(lib):
    req = lib.faces.filter("photo_id % 5 = 0").select("photo_id", F.lit("Person 4").alias("name")).distinct()
    return M.assign_person_to_photos(lib.faces, lib.tags, lib.persons, req)[0].select("face_id", "person_id")


@query("replace_unassigned", "SELECT face_id, assignment FROM faces WHERE NOT (photo_id % 2 = 0 AND assignment = 'unassigned') UNION ALL SELECT face_id + 1000000, 'unassigned' FROM faces WHERE photo_id % 2 = 0 AND face_id % 5 = 0", ("faces",))
def _(lib):
    f = lib.faces
    new = f.filter("photo_id % 2 = 0 and face_id % 5 = 0").withColumn("face_id", F.col("face_id") + 1000000).withColumn("assignment", F.lit("unassigned")).withColumn("person_id", F.lit(None).cast("long"))
    return M.replace_unassigned(f, new, f.filter("photo_id % 2 = 0")).select("face_id", "assignment")


@query("drop_overlapping_boxes", """SELECT n.face_id FROM (SELECT face_id + 1000000 AS face_id, photo_id, x1 + face_id % 9 AS x1, y1, x2 + face_id % 9 AS x2, y2 FROM faces) n WHERE NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = n.photo_id AND f.assignment = 'named'
 AND greatest(0, least(n.x2, f.x2) - greatest(n.x1, f.x1)) * greatest(0, least(n.y2, f.y2) - greatest(n.y1, f.y1)) / ((n.x2 - n.x1) * (n.y2 - n.y1) + (f.x2 - f.x1) * (f.y2 - f.y1) - greatest(0, least(n.x2, f.x2) - greatest(n.x1, f.x1)) * greatest(0, least(n.y2, f.y2) - greatest(n.y1, f.y1))) > 0.7)""", ("faces",))
def _(lib):
    f = lib.faces
    move = (F.col("face_id") % 9).cast("int")
    new = f.select((F.col("face_id") + 1000000).alias("face_id"), "photo_id", (F.col("x1") + move).alias("x1"), "y1", (F.col("x2") + move).alias("x2"), "y2")
    return M.drop_overlapping_boxes(new, f, 0.7).select("face_id")


@query("append_faces", "SELECT face_id, assignment FROM faces UNION ALL SELECT face_id + 1000000, 'unassigned' FROM faces WHERE face_id % 3 = 1", ("faces",))
def _(lib):
    f = lib.faces
    new = f.filter("face_id % 3 = 1").withColumn("face_id", F.col("face_id") + 1000000).withColumn("assignment", F.lit("unassigned")).withColumn("person_id", F.lit(None).cast("long"))
    return M.append_faces(f, new).select("face_id", "assignment")


@query("set_provider", "SELECT photo_id, coalesce(u.provider, 'none') AS provider FROM photos LEFT JOIN (SELECT photo_id, max(provider) provider FROM provider_usage GROUP BY 1) u USING (photo_id)", ("photos", "provider_usage"))
def _(lib):
    p = lib.photos.withColumn("provider", F.lit("none"))
    return M.update_columns(p, lib.provider_usage.groupBy("photo_id").agg(F.max("provider").alias("provider")), "photo_id", ["provider"]).select("photo_id", "provider")


@query("person_representatives", "SELECT person_id, max(face_id) AS face_id FROM faces WHERE assignment = 'named' GROUP BY 1", ("faces",))
def _(lib):
    return M.representatives(lib.faces)
