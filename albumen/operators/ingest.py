"""Ingest of new files, plans for copies and clean-up, and use of a model's responses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.media import classify_media, content_hash, extension, filename
from .maintain import upsert_tags
from .ranking import collision_free_names, largest_unassigned_face


def reuse_hashes(files: DataFrame, cache: DataFrame, hashed: Column | None = None) -> DataFrame:
    """files(path, length, modificationTime, ..) with hash: the cached one where path, size and time agree, else a new one."""
    c = cache.select("path", F.col("size").alias("length"), F.col("mtime").alias("modificationTime"), F.col("hash").alias("_cached"))
    out = files.join(c, ["path", "length", "modificationTime"], "left")
    return out.withColumn("hash", F.coalesce("_cached", content_hash() if hashed is None else hashed)).withColumn("reused", F.col("_cached").isNotNull()).drop("_cached")


def updated_hash_cache(cache: DataFrame, hashed: DataFrame) -> DataFrame:
    """The cache after a scan: a path's newest entry."""
    new = hashed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "hash")
    both = cache.select("path", "size", "mtime", "hash", F.lit(0).alias("_g")).unionByName(new.withColumn("_g", F.lit(1)))
    return both.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "hash"), F.struct("_g", "mtime")).alias("x")).select("path", "x.*")


def ingest_new_files(files: DataFrame, library: DataFrame, dedupe_within_batch: bool = False) -> DataFrame:
    """files(path, hash, ..) that are new by content, with path_conflict where the path is in the library already."""
    new = files.join(library.select("hash").distinct(), "hash", "left_anti")
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("hash"))).filter("_r = 1").drop("_r")
    if dedupe_within_batch:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy("hash").orderBy("path"))).filter("_r = 1").drop("_r")
    known = library.select("path", F.lit(True).alias("path_conflict")).distinct()
    return new.join(known, "path", "left").withColumn("path_conflict", F.coalesce("path_conflict", F.lit(False)))


def resume_scan(files: DataFrame, done: DataFrame) -> DataFrame:
    """files(path, length, modificationTime, ..) that a broken-off scan has yet to take: those not in done as they are now."""
    return files.join(done.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")


def scan_checkpoint(files: DataFrame, done: DataFrame) -> DataFrame:
    """(folder, last_path, processed, total) of each folder's scan; last_path is null where nothing is done."""
    ok = done.select("path", "length", "modificationTime", F.lit(True).alias("_done")).distinct()
    rows = files.join(ok, ["path", "length", "modificationTime"], "left").withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    return rows.groupBy("folder").agg(F.max(F.when(F.col("_done"), F.col("path"))).alias("last_path"), F.count("_done").alias("processed"), F.count(F.lit(1)).alias("total"))


def scan_log(ingested: DataFrame, found: DataFrame, folder: str, started: dt.datetime, ended: dt.datetime) -> DataFrame:
    """One row on a scan: new, skipped and total files."""
    new = ingested.agg(F.count_if(~F.col("path_conflict")).alias("new_files"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return new.crossJoin(total).select(F.lit(folder).alias("folder"), F.lit(started).alias("started"), F.lit(ended).alias("ended"), "new_files", (F.col("total") - F.col("new_files")).alias("skipped"), "total")


def recent_scans(history: DataFrame, n: int) -> DataFrame:
    return history.orderBy(F.desc("started"), F.desc("scan_id")).limit(n)


EXIF_FORMATS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy:MM:dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd", "yyyy-MM-dd", "yyyy/MM/dd")


def parse_date(text: Column, formats: tuple[str, ...] = EXIF_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def dates_in_path(path: Column) -> Column:
    """Noon of every valid YYYYMMDD and YYYY-MM-DD (also with _ : .) of 1990 to 2099 in a path."""
    found = F.regexp_extract_all(path, F.lit(r"(?<![0-9])((?:199[0-9]|20[0-9]{2})(?:[-_:.](?:0[1-9]|1[0-2])[-_:.](?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])))(?![0-9])"), 1)
    noon = lambda d: F.try_to_timestamp(F.concat(F.regexp_replace(d, "[-_:.]", ""), F.lit(" 12")), F.lit("yyyyMMdd HH")).cast("timestamp_ntz")
    return F.transform(found, noon)


def oldest_plausible_date(rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    """rows(path, exif_original, exif_digitized, exif_datetime, gps_date, mtime, birthtime) with date_taken: the earliest candidate from 1990 to as_of."""
    noon = F.try_to_timestamp(F.concat(F.regexp_replace("gps_date", ":", "-"), F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    one = F.array(*[parse_date(F.col(f"exif_{c}")) for c in ("original", "digitized", "datetime")], noon, F.col("mtime").cast("timestamp_ntz"), F.col("birthtime").cast("timestamp_ntz"))
    every = F.concat(one, dates_in_path(F.col("path")))
    low, high = F.lit("1990-01-01").cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")
    return rows.withColumn("date_taken", F.array_min(F.filter(every, lambda d: d.isNotNull() & (d >= low) & (d <= high))))


def normalise_manual_date(rows: DataFrame, col: str = "date") -> DataFrame:
    """rows with date_taken from a typed date; a year or month stands for its first day, a day for noon; rejected: what can't be read."""
    d = F.trim(col)
    padded = F.when(d.rlike(r"^\d{4}$"), F.concat(d, F.lit("-01-01 12:00:00"))).when(d.rlike(r"^\d{4}-\d{2}$"), F.concat(d, F.lit("-01 12:00:00"))).when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(d, F.lit(" 12:00:00"))).otherwise(d)
    got = parse_date(padded, ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy:MM:dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"))
    return rows.withColumn("date_taken", got).withColumn("rejected", F.col(col).isNotNull() & got.isNull())


def backfill_dates(photos: DataFrame, found: DataFrame) -> DataFrame:
    """photos with null dates filled from found(photo_id, metadata_date, file_date)."""
    return photos.join(found, "photo_id", "left").withColumn("date_taken", F.coalesce("date_taken", "metadata_date", "file_date")).select(*photos.columns)


def degrees(parts: Column, ref: Column) -> Column:
    """Degrees of three rationals (num, den); null with a zero denominator or fewer parts; south and west are negative."""
    v = lambda i: F.get(parts, i)["num"] / F.nullif(F.get(parts, i)["den"], F.lit(0))
    return (v(0) + v(1) / 60 + v(2) / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)


def gps_from_dms(rows: DataFrame) -> DataFrame:
    """rows(lat, lat_ref, lon, lon_ref, alt) with gps_lat, gps_lon (both or neither) and gps_alt."""
    lat, lon = degrees(F.col("lat"), F.col("lat_ref")), degrees(F.col("lon"), F.col("lon_ref"))
    both = lat.isNotNull() & lon.isNotNull()
    return rows.withColumn("gps_lat", F.when(both, lat)).withColumn("gps_lon", F.when(both, lon)).withColumn("gps_alt", F.col("alt")["num"] / F.nullif(F.col("alt")["den"], F.lit(0)))


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def month_folder(d: Column) -> Column:
    return F.concat(F.date_format(d, "yyyy"), F.lit("/"), F.date_format(d, "yyyy-MM"), F.lit(" - "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)))


def plan_device_import(files: DataFrame, library: DataFrame) -> DataFrame:
    """(path, hash, target_dir, target_name) of device files(path, hash, exif_date, mtime) that the library lacks, one of each content."""
    new = ingest_new_files(files, library, dedupe_within_batch=True)
    day = F.coalesce("exif_date", F.to_date("mtime"), F.lit("1970-01-01").cast("date"))
    rows = new.withColumn("target_dir", month_folder(day)).withColumn("_name", filename())
    return collision_free_names(rows, "target_dir", "_name", "path", sep="_").select("path", "hash", "target_dir", F.col("new_name").alias("target_name"))


def record_device_imports(imports: DataFrame, objects: DataFrame, library: DataFrame) -> DataFrame:
    """imports(photo_id, device_id, object_id) after objects(device_id, object_id, hash): each content's lowest photo; the latest object of a photo stays."""
    ids = library.groupBy("hash").agg(F.min("photo_id").alias("photo_id"))
    new = objects.join(ids, "hash").groupBy("photo_id").agg(F.max(F.struct("device_id", "object_id")).alias("x")).select("photo_id", "x.*")
    return imports.join(new.select("photo_id"), "photo_id", "left_anti").unionByName(new)


def plan_device_cleanup(objects: DataFrame, imports: DataFrame, photos: DataFrame) -> DataFrame:
    """objects(device_id, object_id) with action: delete, keep (its photo is a favorite), not_imported."""
    known = imports.join(photos.select("photo_id", "favorite"), "photo_id", "left").groupBy("device_id", "object_id").agg(F.bool_or(F.coalesce("favorite", F.lit(False))).alias("_fav"))
    action = F.when(F.col("_fav").isNull(), "not_imported").when(F.col("_fav"), "keep").otherwise("delete")
    return objects.join(known, ["device_id", "object_id"], "left").withColumn("action", action).drop("_fav")


def plan_collection_export(photos: DataFrame, members: DataFrame) -> DataFrame:
    """(collection_id, photo_id, path, target_name): unique file names within each collection."""
    rows = members.join(photos.select("photo_id", "path"), "photo_id").withColumn("_name", filename())
    return collision_free_names(rows, "collection_id", "_name", "photo_id").select("collection_id", "photo_id", "path", F.col("new_name").alias("target_name"))


def missing_files(photos: DataFrame, listing: DataFrame) -> DataFrame:
    return photos.join(listing.select("path").distinct(), "path", "left_anti")


def thumbnail_name(hashed: str = "hash") -> Column:
    return F.concat(F.substring(F.regexp_replace(hashed, "^[a-z0-9]+:", ""), 1, 24), F.lit(".jpg"))


def orphan_thumbnails(files: DataFrame, photos: DataFrame) -> DataFrame:
    """files(name, size) that belong to no photo."""
    return files.join(photos.select(thumbnail_name().alias("name")).distinct(), "name", "left_anti")


def health_report(photos: DataFrame, listing: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """One row: rows without a file, thumbnails short, total."""
    lost = missing_files(photos, listing).agg(F.count(F.lit(1)).alias("orphaned"))
    total = photos.agg(F.count(F.lit(1)).alias("total"))
    have = thumbnails.agg(F.count(F.lit(1)).alias("_t"))
    return lost.crossJoin(total).crossJoin(have).select("orphaned", F.greatest(F.lit(0), F.col("total") - F.col("_t")).alias("missing_thumbnails"), "total")


def relink(photos: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos with accepted new paths, rejected proposals): proposals(photo_id, new_path, new_hash) hold where the hash agrees."""
    judged = proposals.join(photos.select("photo_id", "hash"), "photo_id", "left").withColumn("ok", F.coalesce(F.col("hash") == F.col("new_hash"), F.lit(False)))
    good = judged.filter("ok").groupBy("photo_id").agg(F.min("new_path").alias("_path"))
    out = photos.join(good, "photo_id", "left").withColumn("path", F.coalesce("_path", "path")).withColumn("folder", F.when(F.col("_path").isNotNull(), F.regexp_replace("_path", r"/[^/]*$", "")).otherwise(F.col("folder")))
    return out.select(*photos.columns), judged.filter(~F.col("ok")).select(*proposals.columns)


# --- model responses


def parse_tag_responses(rows: DataFrame, text: str = "response") -> DataFrame:
    """rows with tags, description, lat, lon and location read from a response.

    In order: without a code fence; an object with tags; a bare array; the first brace to the last; the first bracket to
    the last; three bullet lines or more. Tags are trimmed, in lower case, of 1 to 59 bytes.
    """
    body = F.trim(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    thing = "tags array<string>, description string, location struct<name:string,lat:double,lon:double>"
    between = lambda a, b: F.regexp_extract(body, f"(?s)({a}.*{b})", 1)
    as_object = lambda c: F.when(c.startswith("{"), F.from_json(c, thing))
    as_array = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>"))
    obj = F.coalesce(*[F.when(o["tags"].isNotNull(), o) for o in (as_object(body), as_object(between(r"\{", r"\}")))])
    bullets = F.transform(F.filter(F.split(body, r"\n"), lambda x: x.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+\S")), lambda x: F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s+", ""))
    listed = F.coalesce(F.col("_o")["tags"], as_array(body), as_array(between(r"\[", r"\]")), F.when(F.size(bullets) >= 3, bullets), F.array().cast("array<string>"))
    clean = F.array_distinct(F.filter(F.transform(listed, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & F.octet_length(t).between(1, 59)))
    lat, lon = F.col("_o")["location"]["lat"], F.col("_o")["location"]["lon"]
    placed = lat.between(-90, 90) & lon.between(-180, 180)
    out = rows.withColumn("_o", obj).withColumn("tags", clean).withColumn("description", F.nullif(F.trim(F.col("_o")["description"]), F.lit("")))
    return out.withColumn("lat", F.when(placed, lat)).withColumn("lon", F.when(placed, lon)).withColumn("location", F.when(placed, F.col("_o")["location"]["name"])).drop("_o")


def apply_tag_results(photos: DataFrame, tags: DataFrame, usage: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(photos, tags, usage) after results(photo_id, provider, ok, tags, description, cost_usd, at)."""
    good = results.filter("ok")
    new = good.select("photo_id", F.posexplode("tags").alias("ord", "tag"), F.lit(1.0).alias("confidence"), F.col("provider").alias("source"))
    seen = results.groupBy("photo_id").agg(F.max_by(F.struct("ok", "description"), "at").alias("_x"))
    out = photos.join(seen, "photo_id", "left").withColumn("status", F.when(F.col("_x.ok"), "tagged").when(~F.col("_x.ok"), "error").otherwise(F.col("status")))
    out = out.withColumn("description", F.coalesce(F.when(F.col("_x.ok"), F.col("_x.description")), "description")).select(*photos.columns)
    rows = results.select("provider", "photo_id", F.col("ok").alias("success"), F.when(F.col("ok"), F.col("cost_usd")).otherwise(0.0).alias("cost_usd"), F.col("at").alias("created_at"))
    return out, upsert_tags(tags, new.select("photo_id", "tag", "confidence", "source", "ord")), usage.unionByName(rows)


def allocate_providers(items: DataFrame, providers: DataFrame, slack: float = 1.5) -> DataFrame:
    """items(photo_id) with provider: the tier within slack times the cheapest cost of providers(name, cost), in turn by position."""
    from ..functions.order import dense_positions

    cheapest = providers.agg(F.min("cost").alias("_low"))
    tier = providers.crossJoin(cheapest).filter(F.col("cost") <= F.col("_low") * slack)
    ranked = tier.withColumn("_i", F.row_number().over(Window.orderBy("cost", "name")) - 1)  # a handful of providers
    size = tier.agg(F.count(F.lit(1)).alias("_n"))
    placed = dense_positions(items.select("photo_id"), "photo_id", name="_pos").crossJoin(F.broadcast(size)).withColumn("_i", ((F.col("_pos") - 1) % F.col("_n")).cast("int"))
    return placed.join(F.broadcast(ranked.select("_i", F.col("name").alias("provider"))), "_i").select("photo_id", "provider")


def cached_lookup(rows: DataFrame, cache: DataFrame, key: str, value: str, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with the cached value, distinct keys that the cache lacks); keys are trimmed and in lower case with fold."""
    k = F.lower(F.trim(key)) if fold else F.col(key)
    latest = cache.groupBy(k.alias("_k")).agg(F.max_by(value, "created_at").alias(value))
    out = rows.withColumn("_k", k).join(latest, "_k", "left")
    return out.drop("_k"), out.filter(F.col(value).isNull()).select(F.col("_k").alias(key)).distinct()


# --- exports


def export_table(photos: DataFrame, tags: DataFrame, strip_gps: bool = False) -> DataFrame:
    """photos with their tags joined by `; `, for a CSV."""
    joined = tags.groupBy("photo_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), "; ").alias("tags"))
    out = photos.join(joined, "photo_id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))
    if strip_gps:
        out = out.withColumn("gps_lat", F.lit(None).cast("double")).withColumn("gps_lon", F.lit(None).cast("double"))
    return out


def export_csv(photos: DataFrame, tags: DataFrame, path: str, strip_gps: bool = False) -> None:
    export_table(photos, tags, strip_gps).withColumn("_f", filename()).repartitionByRange("folder", "_f").sortWithinPartitions("folder", "_f").drop("_f").write.option("header", True).csv(path)


def export_documents(photos: DataFrame, tags: DataFrame, strip_gps: bool = False) -> DataFrame:
    """photos as nested documents: tags of (tag, confidence, source), gps or null."""
    t = tags.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("tag", "confidence", "source"))).alias("tags"))
    gps = F.lit(None).cast("struct<lat:double,lon:double>") if strip_gps else F.when(F.col("gps_lat").isNotNull(), F.struct(F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon")))
    return photos.join(t, "photo_id", "left").withColumn("gps", gps).drop("gps_lat", "gps_lon")


def markdown_lines(photos: DataFrame, tags: DataFrame, top: int = 50) -> DataFrame:
    """(folder, line_no, line): the most used tags, then a section for each photo, in the order of folder and file name."""
    from .stats import tag_counts

    head = tag_counts(tags, limit=top).select(F.lit("").alias("folder"), F.lit("").alias("name"), (-F.col("n")).alias("o"), F.concat(F.lit("- "), "tag", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    body = export_table(photos, tags).select("folder", filename().alias("name"), F.col("photo_id").alias("o"), F.concat(F.lit("### "), filename(), F.lit("\n\n"), F.when(F.col("tags") != "", F.concat(F.lit("Tags: "), "tags")).otherwise("")).alias("line"))
    return head.unionByName(body)


def export_markdown(photos: DataFrame, tags: DataFrame, path: str) -> None:
    markdown_lines(photos, tags).repartitionByRange("folder", "name", "o").sortWithinPartitions("folder", "name", "o").select("line").write.text(path)


def snapshot_metadata(photos: DataFrame, tags: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """(hash, description, rating, favorite, tags, persons) of photos that carry anything of the user's."""
    t = tags.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("tag", "confidence", "source"))).alias("tags"))
    who = faces.join(persons, "person_id").groupBy("photo_id").agg(F.sort_array(F.collect_set("name")).alias("persons"))
    out = photos.join(t, "photo_id", "left").join(who, "photo_id", "left")
    some = F.col("tags").isNotNull() | F.col("persons").isNotNull() | (F.coalesce("description", F.lit("")) != "") | (F.coalesce("rating", F.lit(0)) != 0) | F.col("favorite")
    return out.filter(some).select("hash", "description", "rating", "favorite", "tags", "persons")


def restore_metadata(snapshot: DataFrame, photos: DataFrame, tags: DataFrame, faces: DataFrame, persons: DataFrame) -> dict[str, DataFrame]:
    """All tables with a snapshot put back by hash; only values that are not defaults overwrite; missing persons are made."""
    hit = snapshot.join(photos.select("hash", "photo_id"), "hash")
    vals = hit.groupBy("photo_id").agg(F.max(F.nullif("description", F.lit(""))).alias("_d"), F.max(F.nullif("rating", F.lit(0))).alias("_r"), F.bool_or("favorite").alias("_f"))
    new_photos = photos.join(vals, "photo_id", "left").withColumn("description", F.coalesce("_d", "description")).withColumn("rating", F.coalesce("_r", "rating")).withColumn("favorite", F.col("favorite") | F.coalesce("_f", F.lit(False))).select(*photos.columns)
    t = hit.select("photo_id", F.posexplode("tags").alias("ord", "t")).select("photo_id", "t.tag", "t.confidence", F.lit("restore").alias("source"), "ord")
    names = hit.select("photo_id", F.explode("persons").alias("name"))
    top = persons.agg(F.coalesce(F.max("person_id"), F.lit(0)).alias("_top"))
    lack = names.select("name").distinct().join(persons.select("name"), "name", "left_anti")
    made = lack.crossJoin(F.broadcast(top)).select((F.col("_top") + F.row_number().over(Window.orderBy("name"))).cast("long").alias("person_id"), "name")  # names of persons, not of photos
    everyone = persons.select("person_id", "name").unionByName(made)
    from .maintain import assign_faces

    free = names.join(faces.filter("assignment = 'named'").join(everyone, "person_id").select("photo_id", "name"), ["photo_id", "name"], "left_anti")
    one = free.groupBy("photo_id").agg(F.min("name").alias("name")).join(everyone, "name")
    bound = largest_unassigned_face(faces).join(one, "photo_id").select("face_id", "person_id")
    return {"photos": new_photos, "tags": upsert_tags(tags, t), "faces": assign_faces(faces, bound), "persons": everyone}


def restore_counts(snapshot: DataFrame, photos: DataFrame, persons: DataFrame) -> DataFrame:
    """What a restore would touch: photos, tags, and persons to be made."""
    hit = snapshot.join(photos.select("hash", "photo_id"), "hash")
    n = hit.agg(F.countDistinct("photo_id").alias("photos"), F.coalesce(F.sum(F.size(F.coalesce("tags", F.array().cast("array<struct<tag:string,confidence:double,source:string>>")))), F.lit(0)).alias("tags"))
    new = hit.select(F.explode("persons").alias("name")).distinct().join(persons.select("name"), "name", "left_anti").agg(F.count(F.lit(1)).alias("new_persons"))
    return n.crossJoin(new)


def metadata_sidecars(photos: DataFrame, tags: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """photos with subjects (tags and further person names), sidecar rating, label, and face boxes as centre and size shares."""
    boxes = faces.join(persons, "person_id", "left").join(photos.select("photo_id", "width", "height"), "photo_id")
    box = F.struct(F.col("name"), ((F.col("x1") + F.col("x2")) / 2 / F.col("width")).alias("x"), ((F.col("y1") + F.col("y2")) / 2 / F.col("height")).alias("y"), ((F.col("x2") - F.col("x1")) / F.col("width")).alias("w"), ((F.col("y2") - F.col("y1")) / F.col("height")).alias("h"))
    regions = boxes.filter("name is not null").groupBy("photo_id").agg(F.sort_array(F.collect_list(box)).alias("regions"))
    t = tags.groupBy("photo_id").agg(F.sort_array(F.collect_list("tag")).alias("_t"))
    out = photos.join(t, "photo_id", "left").join(regions, "photo_id", "left")
    own = F.coalesce("_t", F.array().cast("array<string>"))
    names = F.array_distinct(F.transform(F.coalesce("regions", F.array().cast(out.schema["regions"].dataType)), lambda r: r["name"]))
    lower = F.transform(own, lambda x: F.lower(x))
    subjects = F.concat(own, F.filter(names, lambda n: ~F.array_contains(lower, F.lower(n))))
    rating = F.when(F.col("rating") < 0, -1).otherwise(F.least("rating", F.lit(5)))
    return out.withColumn("subjects", subjects).withColumn("xmp_rating", rating).withColumn("label", F.when(F.col("favorite"), "Red")).drop("_t")


def sidecar_xml(sidecars: DataFrame) -> DataFrame:
    """(photo_id, xml) of sidecar rows."""
    return sidecars.select("photo_id", F.to_xml(F.struct("subjects", F.col("xmp_rating").alias("rating"), "label", "regions")).alias("xml"))


_ = (classify_media, extension)


def fix_health(photos: DataFrame, listing: DataFrame, children: dict[str, DataFrame], usage: DataFrame) -> dict[str, DataFrame]:
    """All tables without the photos that have no file."""
    from .maintain import delete_photos

    return delete_photos(missing_files(photos, listing), photos, children, usage)


def tag_and_export(tags: DataFrame, photos: DataFrame, ids: DataFrame, new_tags: list[str], faces: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags with the new ones on ids(photo_id), the sidecars of those photos)."""
    from .maintain import add_manual_tags

    after = add_manual_tags(tags, ids, new_tags)
    return after, metadata_sidecars(photos.join(ids.select("photo_id").distinct(), "photo_id", "left_semi"), after, faces, persons)
