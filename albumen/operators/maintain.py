"""Set-based changes: a table and a table of changes give a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _capital(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    return first != F.lower(first)


def upsert_tags(tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """tags with incoming(photo_id, tag, confidence, source, ord) put in where no tag alike but for case is there.

    Where the incoming form starts with a capital and the stored one does not, the form and source are taken over and the
    confidence is the greater. Of forms alike in one batch the first by ord counts.
    """
    key = ["photo_id", "_k"]
    new = incoming.withColumn("_k", F.lower("tag")).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("ord", "tag"))).filter("_r = 1")
    new = new.select(*key, F.col("tag").alias("_tag"), F.col("confidence").alias("_confidence"), F.col("source").alias("_source"))
    old = tags.withColumn("_k", F.lower("tag"))
    both = old.join(new, key, "full_outer")
    take = F.col("_tag").isNotNull() & (F.col("tag").isNull() | (_capital(F.col("_tag")) & ~_capital(F.col("tag"))))
    return both.select(
        "photo_id",
        F.when(take, F.col("_tag")).otherwise(F.col("tag")).alias("tag"),
        F.when(take, F.greatest("_confidence", "confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(take, F.col("_source")).otherwise(F.col("source")).alias("source"),
    )


def add_manual_tags(tags: DataFrame, photos: DataFrame, new_tags: list[str], any_case: bool = False) -> DataFrame:
    """tags with the new ones on every photo of photos(photo_id), source manual, where not there yet."""
    fold = F.lower if any_case else F.col
    wanted = photos.select("photo_id").distinct().withColumn("tag", F.explode(F.array(*[F.lit(t) for t in new_tags]))).withColumn("_k", fold("tag")).dropDuplicates(["photo_id", "_k"])
    lack = wanted.join(tags.select("photo_id", fold("tag").alias("_k")), ["photo_id", "_k"], "left_anti")
    return tags.unionByName(lack.select("photo_id", "tag", F.lit(1.0).alias("confidence"), F.lit("manual").alias("source")))


def remove_tags(tags: DataFrame, gone: DataFrame, any_case: bool = False) -> DataFrame:
    """tags without the pairs gone(photo_id, tag)."""
    fold = F.lower if any_case else F.col
    g = gone.select("photo_id", fold("tag").alias("_k")).distinct()
    return tags.withColumn("_k", fold("tag")).join(g, ["photo_id", "_k"], "left_anti").drop("_k").select(*tags.columns)


def merge_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """tags with mapping(source, target) applied; of equal pairs an existing target row stays, else the greatest confidence."""
    m = mapping.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    moved = tags.join(m, tags["tag"] == m["_from"], "left").withColumn("_moved", F.col("_to").isNotNull()).withColumn("tag", F.coalesce("_to", "tag"))
    order = Window.partitionBy("photo_id", "tag").orderBy("_moved", F.desc("confidence"), "_from")
    return moved.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*tags.columns)


def delete_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    return tags.join(names.select("tag").distinct(), "tag", "left_anti").select(*tags.columns)


def update_columns(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with the non-null values of changes(key, columns) taken over."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    out = table.join(c, key, "left")
    for x in columns:
        out = out.withColumn(x, F.coalesce(f"_{x}", x))
    return out.select(*table.columns)


def set_location(photos: DataFrame, changes: DataFrame, keep_real_gps: bool = False) -> DataFrame:
    """photos with estimated places taken over; with keep_real_gps not where there are coordinates."""
    if keep_real_gps:
        changes = changes.join(photos.filter("gps_lat is null").select("photo_id"), "photo_id", "left_semi")
    return update_columns(photos, changes, "photo_id", ["estimated_lat", "estimated_lon", "estimated_location"])


def reset_errors(photos: DataFrame) -> DataFrame:
    return photos.withColumn("status", F.when(F.col("status") == "error", "pending").otherwise(F.col("status")))


def retag(photos: DataFrame, tags: DataFrame, ids: DataFrame | None = None, clear: tuple[str, ...] = ("description", "estimated_location")) -> tuple[DataFrame, DataFrame]:
    """(photos, tags) with the ids' tags dropped, status pending and texts cleared; all rows where ids is None."""
    hit = photos.select("photo_id") if ids is None else ids.select("photo_id").distinct()
    marked = photos.join(hit.withColumn("_hit", F.lit(True)), "photo_id", "left")
    out = marked.withColumn("status", F.when(F.col("_hit"), "pending").otherwise(F.col("status")))
    for c in clear:
        if c in photos.columns:
            out = out.withColumn(c, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)))
    return out.select(*photos.columns), tags.join(hit, "photo_id", "left_anti").select(*tags.columns)


def record_usage(usage: DataFrame, rows: DataFrame) -> DataFrame:
    return usage.unionByName(rows)


def add_members(members: DataFrame, rows: DataFrame) -> DataFrame:
    return members.unionByName(rows.select(*members.columns)).distinct()


def remove_members(members: DataFrame, rows: DataFrame) -> DataFrame:
    return members.join(rows, members.columns, "left_anti")


def delete_collections(collections: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    i = ids.select("collection_id")
    return collections.join(i, "collection_id", "left_anti"), members.join(i, "collection_id", "left_anti")


def collections_from_folders(photos: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, folder, photo_id): each non-blank folder as a collection named by its last two parts, by three where that is taken, else left out.

    existing: names in use. Among folders of one name the first by path gets it.
    """
    parts = F.filter(F.split("folder", r"[/\\]"), lambda x: F.trim(x) != "")
    named = photos.filter(F.trim("folder") != "").select("folder").distinct().withColumn("_p", parts)
    of = lambda n: F.array_join(F.slice("_p", F.greatest(F.lit(1), F.size("_p") - n + 1), n), " / ")
    named = named.withColumn("two", of(2)).withColumn("three", of(3))

    def claim(rows: DataFrame, name: str, used: DataFrame) -> DataFrame:
        free = rows.withColumn("name", F.col(name)).join(used.select("name"), "name", "left_anti")
        return free.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("folder"))).filter("_r = 1").select("name", "folder")

    first = claim(named, "two", existing)
    second = claim(named.join(first.select("folder"), "folder", "left_anti"), "three", existing.select("name").unionByName(first.select("name")))
    return photos.join(first.unionByName(second), "folder").select("name", "folder", "photo_id")


def delete_photos(ids: DataFrame, photos: DataFrame, children: dict[str, DataFrame], usage: DataFrame) -> dict[str, DataFrame]:
    """All tables without the photos: children lose their rows, usage keeps its rows without the photo."""
    gone = ids.select("photo_id").distinct()
    out = {name: t.join(gone, "photo_id", "left_anti").select(*t.columns) for name, t in {"photos": photos, **children}.items()}
    marked = usage.join(gone.withColumn("_gone", F.lit(True)), "photo_id", "left")
    out["usage"] = marked.withColumn("photo_id", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("photo_id"))).select(*usage.columns)
    return out


def merge_duplicates(plan: DataFrame, photos: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos, tags) after plan(keeper_id, dupe_id, ord): keepers gain missing tags, the best rating, favorite and, where their own is empty, the first non-empty description; duplicates go."""
    d = plan.join(photos.select(F.col("photo_id").alias("dupe_id"), "rating", "favorite", "description"), "dupe_id")
    text = F.when(F.trim("description") != "", F.col("description"))
    gain = d.groupBy(F.col("keeper_id").alias("photo_id")).agg(F.max("rating").alias("_r"), F.bool_or("favorite").alias("_f"), F.min_by(text, F.when(text.isNotNull(), F.col("ord"))).alias("_d"))
    kept = photos.join(plan.select(F.col("dupe_id").alias("photo_id")).distinct(), "photo_id", "left_anti").join(gain, "photo_id", "left")
    kept = kept.withColumn("rating", F.greatest("rating", "_r")).withColumn("favorite", F.col("favorite") | F.coalesce("_f", F.lit(False)))
    kept = kept.withColumn("description", F.when(F.trim(F.coalesce("description", F.lit(""))) == "", F.coalesce("_d", "description")).otherwise(F.col("description"))).select(*photos.columns)
    inherited = tags.join(plan.select(F.col("dupe_id").alias("photo_id"), "keeper_id", "ord"), "photo_id")
    inherited = inherited.withColumn("_k", F.lower("tag")).withColumn("_n", F.row_number().over(Window.partitionBy("keeper_id", "_k").orderBy("ord", "tag"))).filter("_n = 1")
    inherited = inherited.drop("photo_id").withColumnRenamed("keeper_id", "photo_id")
    own = tags.join(plan.select(F.col("dupe_id").alias("photo_id")).distinct(), "photo_id", "left_anti")
    extra = inherited.join(own.select("photo_id", F.lower("tag").alias("_k")), ["photo_id", "_k"], "left_anti").select(*tags.columns)
    return kept, own.select(*tags.columns).unionByName(extra)


def migrate_hashes(photos: DataFrame) -> DataFrame:
    """Drops features that have to be made anew: all blur scores, and hashes of videos."""
    return photos.withColumn("blur_score", F.lit(None).cast("double")).withColumn("phash", F.when(F.col("media_type") != "video", F.col("phash")))


def edit_watch_folders(watch: DataFrame, changes: DataFrame) -> DataFrame:
    """watch after changes(path, action, enabled, auto_tag): add (ignored where there), remove, set."""
    gone = changes.filter("action = 'remove'").select("path")
    sets = changes.filter("action = 'set'").select("path", "enabled", "auto_tag")
    adds = changes.filter("action = 'add'").join(watch.select("path"), "path", "left_anti").dropDuplicates(["path"])
    new = adds.select("path", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("auto_tag", F.lit(False)).alias("auto_tag"))
    return update_columns(watch.select("path", "enabled", "auto_tag").unionByName(new).join(gone, "path", "left_anti"), sets, "path", ["enabled", "auto_tag"])


# --- faces and persons


def assign_faces(faces: DataFrame, changes: DataFrame) -> DataFrame:
    """faces after changes(face_id, person_id): a person names the face, null frees it."""
    c = changes.select("face_id", F.col("person_id").alias("_p"), F.lit(True).alias("_hit"))
    out = faces.join(c, "face_id", "left")
    state = F.when(F.col("_hit"), F.when(F.col("_p").isNull(), "unassigned").otherwise("named")).otherwise(F.col("assignment"))
    return out.withColumn("assignment", state).withColumn("person_id", F.when(F.col("_hit"), F.col("_p")).otherwise(F.col("person_id"))).select(*faces.columns)


def append_faces(faces: DataFrame, new: DataFrame) -> DataFrame:
    return faces.unionByName(new)


def resolve_chains(mapping: DataFrame, rounds: int = 20) -> DataFrame:
    """mapping(source, target) with every target followed to its end; a cycle ends at its least member."""
    m = mapping.select("source", "target")
    for _ in range(rounds):
        nxt = m.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        step = m.join(nxt, "target", "left").select("source", F.col("target").alias("_was"), F.coalesce("_next", "target").alias("target"))
        if not step.filter("_was <> target").limit(1).count():
            return m
        m = step.select("source", "target").checkpoint() if m.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else step.select("source", "target")
    raise ValueError("the mapping has a cycle")


def merge_persons(faces: DataFrame, persons: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, persons) with mapping(source, target) of person ids applied and the sources gone."""
    m = resolve_chains(mapping)
    moved = faces.join(m.withColumnRenamed("source", "person_id"), "person_id", "left").withColumn("person_id", F.coalesce("target", "person_id")).select(*faces.columns)
    return moved, persons.join(m.select(F.col("source").alias("person_id")), "person_id", "left_anti")


def set_assignment(faces: DataFrame, state: str, ids: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """faces with assignment state (skipped or unassigned) for ids, or for all in the state `only`; named ones never become skipped."""
    hit = F.lit(True) if only is None else F.col("assignment") == only
    out = faces if ids is None else faces.join(ids.select("face_id").distinct().withColumn("_id", F.lit(True)), "face_id", "left")
    hit = hit if ids is None else hit & F.coalesce("_id", F.lit(False))
    hit = hit & (F.col("assignment") != "named") if state == "skipped" else hit
    return out.withColumn("person_id", F.when(hit, F.lit(None)).otherwise(F.col("person_id"))).withColumn("assignment", F.when(hit, state).otherwise(F.col("assignment"))).select(*faces.columns)


def undo_name(faces: DataFrame, tags: DataFrame, persons: DataFrame, ids: DataFrame, drop_person: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, tags, persons) with the persons' faces free and their face tags gone, and themselves too on demand."""
    who = persons.join(ids.select("person_id").distinct(), "person_id", "left_semi")
    freed = faces.join(who.select("person_id", F.lit(True).alias("_hit")), "person_id", "left")
    freed = freed.withColumn("assignment", F.when(F.col("_hit"), "unassigned").otherwise(F.col("assignment"))).withColumn("person_id", F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("person_id")))
    names = who.select(F.col("name").alias("tag"), F.lit("face").alias("source"))
    left = persons.join(who.select("person_id"), "person_id", "left_anti") if drop_person else persons
    return freed.select(*faces.columns), tags.join(names, ["tag", "source"], "left_anti").select(*tags.columns), left


def rename_persons(persons: DataFrame, changes: DataFrame) -> DataFrame:
    return update_columns(persons, changes, "person_id", ["name"])


def assign_person_to_photos(faces: DataFrame, tags: DataFrame, persons: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, tags) after requests(photo_id, name): the largest free face of each photo is named, and the photo tagged."""
    from .ranking import largest_unassigned_face

    named = requests.join(persons, "name").groupBy("photo_id").agg(F.min("person_id").alias("person_id"))
    bound = largest_unassigned_face(faces).join(named, "photo_id").select("face_id", "person_id")
    wanted = requests.select("photo_id", F.col("name").alias("tag"), F.lit(1.0).alias("confidence"), F.lit("face").alias("source"), F.lit(0).alias("ord"))
    return assign_faces(faces, bound), upsert_tags(tags, wanted)


def replace_unassigned(faces: DataFrame, new: DataFrame, photos: DataFrame, force: bool = False) -> DataFrame:
    """faces with the photos' free boxes (with force also skipped ones) replaced by new detections."""
    keep = ("named",) if force else ("named", "skipped")
    hit = photos.select("photo_id").distinct()
    other = faces.join(hit, "photo_id", "left_anti")
    mine = faces.join(hit, "photo_id", "left_semi").filter(F.col("assignment").isin(*keep))
    return other.select(*faces.columns).unionByName(mine.select(*faces.columns)).unionByName(new.select(*faces.columns))


def iou() -> Column:
    """Of box x1..y2 with box _x1.._y2."""
    w = F.greatest(F.lit(0), F.least("x2", "_x2") - F.greatest("x1", "_x1"))
    h = F.greatest(F.lit(0), F.least("y2", "_y2") - F.greatest("y1", "_y1"))
    inter = (w * h).cast("double")
    union = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) + (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1")) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def drop_overlapping_boxes(new: DataFrame, faces: DataFrame, limit: float = 0.4) -> DataFrame:
    """new boxes without those that overlap a named box of their photo."""
    named = faces.filter("assignment = 'named'").select("photo_id", *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    bad = new.join(named, "photo_id").filter(iou() > limit).select("face_id").distinct()
    return new.join(bad, "face_id", "left_anti").select(*new.columns)


def representatives(faces: DataFrame, order: str = "face_id") -> DataFrame:
    """(person_id, face_id): the last face assigned to each person."""
    return faces.filter("assignment = 'named'").groupBy("person_id").agg(F.max_by("face_id", order).alias("face_id"))
