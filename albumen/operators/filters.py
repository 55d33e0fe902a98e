"""Projections, filters and predicates over photos."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import extension
from .stats import taken, visible


def photo_summary(photos: DataFrame, tags: DataFrame, top: int = 10) -> DataFrame:
    """photos with tag_count and their first tags in order."""
    t = tags.groupBy("photo_id").agg(F.count(F.lit(1)).alias("tag_count"), F.slice(F.sort_array(F.collect_list("tag")), 1, top).alias("tags"))
    return photos.join(t, "photo_id", "left").withColumn("tag_count", F.coalesce("tag_count", F.lit(0))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def list_photos(photos: DataFrame, tags: DataFrame, folder: str | None = None, status: str | None = None, tag: str | None = None) -> DataFrame:
    """Visible photos under all the given equality filters."""
    out = visible(photos)
    out = out if folder is None else out.filter(F.col("folder") == folder)
    out = out if status is None else out.filter(F.col("status") == status)
    return out if tag is None else out.join(tags.filter(F.col("tag") == tag).select("photo_id"), "photo_id", "left_semi")


def page(df: DataFrame, offset: int, limit: int, newest: str = "created_at", key: str = "photo_id") -> DataFrame:
    return df.orderBy(F.desc(newest), key).offset(offset).limit(limit)


def vault_list(photos: DataFrame) -> DataFrame:
    return photos.filter("private").withColumn("day", taken())


def contains(col: str, text: str) -> Column:
    return F.lower(F.col(col)).contains(text.lower())


def smart_collection(photos: DataFrame, tags: DataFrame, rules: list[dict], strict_ops: bool = False, limit: int | None = None) -> DataFrame:
    """Photos under all rules (field, operator, value); unknown fields are left out; no usable rule gives nothing.

    Operators count with strict_ops only; else each field has its own comparison.
    """

    def has(rule: dict) -> tuple[str, object] | None:
        field, value, op = rule["field"], rule["value"], rule.get("operator", "") if strict_ops else ""
        text = {"folder": "folder", "provider": "provider", "status": "status"}
        if field == "tag":
            hit = F.col("tag") == value if op == "equals" else contains("tag", value)
            return "left_anti" if op == "not_equals" else "left_semi", tags.filter(F.col("tag") == value if op == "not_equals" else hit).select("photo_id")
        if field in text:
            c = contains("folder", value) if field == "folder" and op != "equals" else F.col(text[field]) == value
            return "where", ~(F.col(text[field]) == value) if op == "not_equals" else c
        if field == "date_from":
            return "where", F.col("created_at") >= F.lit(value).cast("date")
        if field == "date_to":
            return "where", F.col("created_at") <= F.lit(value).cast("date")
        return None

    found = [x for x in map(has, rules) if x is not None]
    out = visible(photos) if found else photos.filter(F.lit(False))
    for how, what in found:
        out = out.filter(what) if how == "where" else out.join(what, "photo_id", how)
    return out if limit is None else page(out, 0, limit)


FIELDS = {"tag": "tag", "folder": "folder", "in": "folder", "path": "folder", "year": "year", "before": "before", "to": "before", "after": "after", "from": "after", "rating": "rating", "stars": "rating", "fav": "fav", "favorite": "fav", "media": "media", "type": "media", "ext": "ext", "person": "person"}
# fixed values: fields that a query may name but that no photo row answers
OTHER_FIELDS = ("date", "camera", "lens", "location", "place", "city", "country", "iso", "aperture", "focal", "color")


def _met(kind: str, value: Column) -> Column:
    """Whether a photo row meets a field of this kind; reads only the columns that the kind needs."""
    low = F.lower(value)
    if kind == "tag":
        return F.exists("tags", lambda t: F.lower(t).contains(low))
    if kind == "folder":
        return F.lower("path").contains(low)
    if kind == "rating":
        sign, number = F.regexp_extract(low, "^(>=|<=|>|<)?", 1), F.regexp_extract(low, r"^(?:>=|<=|>|<)?([+-]?\d+)$", 1).try_cast("int")
        stars = F.coalesce("rating", F.lit(0))
        return F.when(sign == ">=", stars >= number).when(sign == "<=", stars <= number).when(sign == ">", stars > number).when(sign == "<", stars < number).otherwise(stars == number)
    if kind == "fav":
        return F.col("favorite") == low.isin("1", "true", "yes", "y", "on")
    if kind == "media":
        return F.lower("media_type") == low
    if kind == "ext":
        return F.lower("path").endswith(F.concat(F.lit("."), low))
    day = F.coalesce(F.col("date_taken").cast("date").cast("string"), F.lit(""))
    if kind == "year":
        year, span = F.substring(day, 1, 4), low.rlike("^[0-9]{4}-[0-9]{4}$")
        return F.when(span, year.between(F.substring(low, 1, 4), F.substring(low, 6, 4))).otherwise((F.length(low) == 4) & (year == low))
    bound = F.substring(F.regexp_replace(F.trim(low), "[:/]", "-"), 1, 10)
    return (day <= bound) | (day < low) if kind == "before" else (day >= bound) | (day > low)


def field_met(name: Column, value: Column) -> Column:
    """Whether a photo row (with `tags`) meets a search field, without its `!`; true for fields that no row answers.

    Dates are compared as text, so `before:2020` leaves out 2020; undated rows pass `before`.
    """
    met = F.when(F.lit(False), F.lit(False))
    for kind in dict.fromkeys(FIELDS.values()):
        if kind != "person":
            met = met.when(name.isin(*[k for k, v in FIELDS.items() if v == kind]), _met(kind, value))
    return F.coalesce(met.otherwise(True), F.lit(False))


def field_filter(photos: DataFrame, filters: list[tuple[str, str]], persons: DataFrame | None = None) -> DataFrame:
    """photos (with `tags`) under all (field, value) filters; a field that starts with `!` is negated.

    persons (photo_id, name) serves `person`; unknown fields have no effect, and negated ones let nothing pass.
    """
    for field, value in filters:
        no, field = field.startswith("!"), field.lstrip("!")
        if FIELDS.get(field) == "person" and persons is not None:
            ids = persons.filter(contains("name", value)).select("photo_id").distinct()
            photos = photos.join(ids, "photo_id", "left_anti" if no else "left_semi")
            continue
        kind = FIELDS.get(field)
        met = F.lit(True) if kind in (None, "person") else F.coalesce(_met(kind, F.lit(value)), F.lit(False))
        photos = photos.filter(~met if no else met)
    return photos


def work_queue(photos: DataFrame, kind: str, tier: str | None = None) -> DataFrame:
    """Rows that a job has yet to do."""
    image = F.col("media_type") == "image"
    todo = {
        "pending": lambda: F.col("status") == "pending",
        "phash": lambda: F.col("phash").isNull() & image,
        "blur": lambda: F.col("blur_score").isNull() & image,
        "colours": lambda: F.col("dominant_colors").isNull(),
        "clip": lambda: F.col("clip_emb").isNull() | ~F.col("clip_tier").eqNullSafe(tier),
        "gps": lambda: F.col("gps_lat").isNull(),
    }
    return photos.filter(todo[kind]())


def photos_by_ids(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """Visible photos of ids(photo_id, rank), with their rank."""
    return visible(photos).join(ids, "photo_id")


def photo_detail(photos: DataFrame, tags: DataFrame, ids: DataFrame) -> DataFrame:
    t = tags.join(ids.select("photo_id"), "photo_id", "left_semi").groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("tag", "confidence", "source"))).alias("tags"))
    return photos.join(ids.select("photo_id"), "photo_id", "left_semi").join(t, "photo_id", "left")


def folder_scope(photos: DataFrame, folder: str, mode: str = "exact", strict_separator: bool = False) -> DataFrame:
    """Rows of a folder, or of those below it; without strict_separator also of siblings with the same start."""
    if mode == "exact":
        return photos.filter(F.col("folder") == folder)
    return photos.filter((F.col("folder") == folder) | F.col("folder").startswith(folder + "/" if strict_separator else folder))


def _channel(hexed: Column, at: int) -> Column:
    return F.conv(F.substring(F.regexp_replace(hexed, "^#", ""), at, 2), 16, 10).cast("int")


def search_by_color(photos: DataFrame, colour: str, tolerance: float) -> DataFrame:
    """Photos with a palette colour within the RGB distance (10 at least) of the target."""
    if not re.fullmatch(r"#?[0-9a-fA-F]{6}", colour):
        raise ValueError(f"not a colour: {colour}")
    r, g, b = (int(colour.lstrip("#")[i : i + 2], 16) for i in (0, 2, 4))
    near = lambda c: F.sqrt(F.pow(_channel(c, 1) - r, 2) + F.pow(_channel(c, 3) - g, 2) + F.pow(_channel(c, 5) - b, 2)) <= max(float(tolerance), 10.0)
    return visible(photos).filter(F.exists("dominant_colors", near))


def rename_preview(photos: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """photos(photo_id, ord, path, location, description, date) -> new_name: location, four words, date, number, extension."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    place = clean(F.coalesce("location", F.lit("")))
    words = clean(F.array_join(F.slice(F.split(F.trim(F.coalesce("description", F.lit(""))), r"\s+"), 1, 4), "_"))
    day = F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit(""))
    parts = F.filter(F.array(place, words, day, F.lpad(F.col("ord").cast("string"), 3, "0")), lambda x: x != "")
    return photos.withColumn("new_name", F.concat(F.array_join(parts, "_"), F.lit("."), extension()))


def effective_sharpness(overall: str, center: str, patch_max: str) -> Column:
    return F.greatest(overall, center, patch_max)


def is_bokeh(overall: str, center: str) -> Column:
    return (F.col(center) >= 150) & (F.col(overall) > 0) & (F.col(center) / F.when(F.col(overall) > 0, F.col(overall)) >= 1.5)


# --- joins


def search_person(photos: DataFrame, faces: DataFrame, persons: DataFrame, text: str) -> DataFrame:
    ids = faces.join(persons.filter(contains("name", text)).select("person_id"), "person_id", "left_semi").select("photo_id")
    return visible(photos).join(ids, "photo_id", "left_semi")


def related_tags(tags: DataFrame, tag: str, n: int) -> DataFrame:
    """Tags on the photos that have the tag, in any case, most often first; the tag itself is left out."""
    mine = tags.filter(F.lower("tag") == tag.lower()).select("photo_id").distinct()
    return tags.filter(F.lower("tag") != tag.lower()).join(mine, "photo_id", "left_semi").groupBy(F.lower("tag").alias("_k")).agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("n")).drop("_k").orderBy(F.desc("n"), "tag").limit(n)


def tag_cooccurrence(tags: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n): photos that two tags share, a < b. A photo's tags are paired within the photo."""
    t = tags.select("photo_id", F.lower("tag").alias("tag")).distinct()
    return t.withColumnRenamed("tag", "a").join(t.withColumnRenamed("tag", "b"), "photo_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


# fixed values
ART_TAGS = (
    "painting", "drawing", "cartoon", "illustration", "anime", "manga", "comic", "comic book", "sculpture", "statue", "artwork", "digital art",
    "concept art", "pencil drawing", "ink drawing", "oil painting", "watercolor", "sketch", "poster", "graffiti",
    "resim", "çizim", "karikatür", "illüstrasyon", "heykel", "tablo", "sanat eseri", "çizgi film", "çizgi roman", "suluboya", "yağlı boya", "eskiz",
)


def faces_to_scan(photos: DataFrame, faces: DataFrame, tags: DataFrame, folder: str | None = None, art_tags: tuple[str, ...] = ART_TAGS) -> DataFrame:
    """Visible photos without faces and without an art-like tag; first: 0 for jpg and png, which come first."""
    p = visible(photos)
    p = p if folder is None else p.filter(F.col("folder") == folder)
    p = p.join(faces.select("photo_id"), "photo_id", "left_anti").join(tags.filter(F.lower("tag").isin(*art_tags)).select("photo_id"), "photo_id", "left_anti")
    return p.withColumn("first", F.when(extension().isin("jpg", "jpeg", "png"), 0).otherwise(1))


def blurry_photos(photos: DataFrame, tags: DataFrame, faces: DataFrame, members: DataFrame, threshold: float, include_protected: bool = False) -> DataFrame:
    from .stats import protected

    soft = visible(photos).filter(F.col("blur_score") < threshold)
    return soft if include_protected else protected(soft, tags, faces, members)


def faces_with_person(faces: DataFrame, persons: DataFrame) -> DataFrame:
    return faces.join(persons, "person_id", "left")


def known_faces(faces: DataFrame) -> DataFrame:
    return faces.filter("assignment = 'named' and embedding is not null")


def unassigned_faces(faces: DataFrame, photos: DataFrame, folder: str | None = None, with_skipped: bool = False) -> DataFrame:
    """Faces that can still be named, with vectors, on visible photos (of a folder)."""
    states = ("unassigned", "skipped") if with_skipped else ("unassigned",)
    p = visible(photos) if folder is None else visible(photos).filter(F.col("folder") == folder)
    return faces.filter(F.col("assignment").isin(*states) & F.col("embedding").isNotNull()).join(p.select("photo_id"), "photo_id", "left_semi")


def prefix_match(rows: DataFrame, prefixes: DataFrame, path: str, prefix: str) -> DataFrame:
    """rows joined with the prefixes that their path starts with, as literal text.

    Both sides meet on the ancestors of the path, so it is an equi-join whatever the number of prefixes. Prefixes end at
    separators.
    """
    parts = F.split(F.regexp_replace(path, r"/+$", ""), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return rows.withColumn("_up", F.explode(ups)).join(prefixes.withColumn("_up", F.regexp_replace(prefix, r"/+$", "")), "_up").drop("_up")


def watch_folder_counts(watch: DataFrame, photos: DataFrame) -> DataFrame:
    """watch with n, the photos at or below each path. Folders are counted first, so paths meet each folder once."""
    folders = photos.groupBy("folder").agg(F.count(F.lit(1)).alias("_c"))
    n = prefix_match(folders, watch.select("path"), "folder", "path").groupBy("path").agg(F.sum("_c").alias("n"))
    return watch.join(n, "path", "left").na.fill(0, ["n"])


def touch_watch_folders(watch: DataFrame, events: DataFrame) -> DataFrame:
    """watch with last_checked moved to the latest event(folder, ts) at or below each path, whatever case and separators."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    seen = prefix_match(events.withColumn("folder", norm("folder")), watch.select(norm("path").alias("wp")).distinct(), "folder", "wp").groupBy("wp").agg(F.max("ts").alias("_ts"))
    return watch.join(seen, norm("path") == F.col("wp"), "left").withColumn("last_checked", F.coalesce(F.greatest("_ts", "last_checked"), "_ts", "last_checked")).drop("_ts", "wp")


def person_tags(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """(photo_id, tag, confidence, source) of the named faces."""
    return faces.join(persons, "person_id").select("photo_id", F.col("name").alias("tag"), F.lit(1.0).alias("confidence"), F.lit("face").alias("source")).distinct()


def person_timeline(photos: DataFrame, faces: DataFrame, person_id: int) -> DataFrame:
    ids = faces.filter(F.col("person_id") == person_id).select("photo_id")
    return visible(photos).join(ids, "photo_id", "left_semi").select("photo_id", taken().alias("day"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
