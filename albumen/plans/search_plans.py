"""Search, geography, pixels and change feeds."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import geo as G
from ..operators import pixels as P
from ..operators import search as H
from ..operators.filters import photo_summary
from ..operators.iterate import cut, shared_folder
from ..operators.postings import Postings
from ..streaming import watch as W
from .registry import query

Q = "q(query_id, text) AS (VALUES (CAST(1 AS BIGINT), 'red plate'), (CAST(2 AS BIGINT), 'plate hot'), (CAST(3 AS BIGINT), 'zebra rod'), (CAST(4 AS BIGINT), 'Small Widget'))"
TEXTS = [(1, "red plate"), (2, "plate hot"), (3, "zebra rod"), (4, "Small Widget")]
SYNONYMS = [(1, "plate"), (1, "dish"), (2, "rod"), (2, "pole")]


def asked(lib, texts=None):
    return lib.spark.createDataFrame(texts or TEXTS, "query_id long, text string")


@query("token_table", "SELECT photo_id, pos - 1 AS pos, token FROM (SELECT photo_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT photo_id, regexp_extract_all(lower(path), '[a-z0-9]+') AS t FROM photos))", ("photos",))
def _(lib):
    return H.token_table(lib.photos, "photo_id", "path", "path").select(F.col("doc").alias("photo_id"), F.col("pos").cast("long").alias("pos"), "token")


@query("search_tags", f", {Q} SELECT DISTINCT query_id, photo_id FROM q, tags WHERE list_sort(string_split(lower(text), ' ')) = list_sort(string_split(tag, ' '))", ("tags",))
def _(lib):
    return H.search_tags(lib.tags, asked(lib))


@query("search_tags_prefix", "SELECT CAST(1 AS BIGINT) AS query_id, photo_id FROM tags WHERE (tag LIKE 'sm%' OR tag LIKE '% sm%') AND (tag LIKE 'w%' OR tag LIKE '% w%') GROUP BY 2", ("tags",))
def _(lib):
    return H.search_tags(lib.tags, asked(lib, [(1, "sm W")]), prefix=True)


@query("search_tags_phrase", f", {Q} SELECT DISTINCT query_id, photo_id FROM q, tags WHERE lower(text) = tag", ("tags",))
def _(lib):
    return H.search_tags_phrase(lib.tags, asked(lib))


@query("search_tags_multi", f", {Q} SELECT DISTINCT query_id, photo_id FROM q, tags WHERE list_sort(string_split(lower(text), ' ')) = list_sort(string_split(tag, ' ')) OR (query_id = 3 AND tag LIKE '%rod%')", ("tags",))
def _(lib):
    return H.search_tags_multi(lib.tags, asked(lib))


@query("search_tag_exact", f", {Q} SELECT DISTINCT query_id, photo_id FROM q, tags WHERE lower(text) = lower(tag)", ("tags",))
def _(lib):
    return H.search_tag_exact(lib.tags, asked(lib))


@query("search_path", "SELECT CAST(1 AS BIGINT) AS query_id, photo_id FROM photos WHERE folder = '/lib/1-URGENT' OR path LIKE '%.heic'", ("photos",))
def _(lib):
    return H.search_path(lib.photos.withColumn("description", F.lit(None).cast("string")), asked(lib, [(1, "urg a heic")]))


@query("search_kept", """, texts AS (SELECT p.photo_id, regexp_split_to_array(lower(p.path || ' ' || coalesce(d.description, '')), '[^a-z0-9äöüßéèêçàñóíúáâîôûëï]+') AS w FROM photos p LEFT JOIN descriptions d USING (photo_id) WHERE NOT p.private)
SELECT CAST(1 AS BIGINT) AS query_id, photo_id FROM texts WHERE len(list_filter(w, lambda x: starts_with(x, 'urg') OR starts_with(x, 'heic'))) > 0
UNION ALL SELECT 2, photo_id FROM texts WHERE len(list_filter(w, lambda x: starts_with(x, 'thonou') OR starts_with(x, 'schber'))) > 0""", ("photos", "descriptions"))
def _(lib):
    """Paths are indexed first; described photos are then indexed anew with their descriptions, private ones go."""
    kept = Postings(lib.spark, f"{shared_folder(lib.spark)}/postings-{uuid.uuid4().hex}")
    kept.add(0, H.token_table(lib.photos, "photo_id", "path", "text"))
    said = lib.photos.filter("not private").join(lib.descriptions, "photo_id").select("photo_id", F.concat_ws(" ", "path", "description").alias("text"))
    kept.add(1, H.token_table(said, "photo_id", "text", "text"), said.select(F.col("photo_id").alias("doc")).union(lib.photos.filter("private").select("photo_id")))
    kept.compact()
    words = asked(lib, [(1, "urg heic"), (2, "thonou schber")])
    return H.search_any_word(kept.read(words, prefix=True), words, ["doc"], prefix=True).withColumnRenamed("doc", "photo_id")


@query("search_description", "SELECT CAST(1 AS BIGINT) AS query_id, photo_id FROM descriptions WHERE len(list_intersect(regexp_split_to_array(lower(description), '[^a-z0-9äöüßéèêçàñóíúáâîôûëï]+'), ['thonou', 'schber'])) > 0", ("descriptions",))
def _(lib):
    return H.search_description(lib.descriptions, asked(lib, [(1, "thonou schber x")]))


@query("parse_searches", """SELECT photo_id, tag, w[1] || ' & ' || w[2] || '|dishes & zoom:3' AS words, w[1] || ' & ' || w[2] || '|dishes|dish & zoom:3' AS must, tag AS phrases, 'old;not so' AS must_not, 'before=2020;!fav=1;after=2024-02-01;before=2024-02-29;before=2023-12-15;after=2024-03-11;lens=50mm;!date=today' AS fields, 'pla' AS wildcards FROM (SELECT *, string_split(tag, ' ') AS w FROM tags)""", ("tags",))
def _(lib):
    said = F.concat(F.col("tag"), F.lit(' Or Dishes "'), F.col("tag"), F.lit('"-OLD before:2020 AND -Fav:1 date:last-month to:3months from:this_week lens:50mm -date:today zoom:3 Pla** - "" -"not so" or'))
    keyed = lib.tags.select("photo_id", "tag", F.xxhash64("photo_id", "tag").alias("query_id"), said.alias("text"))
    lists = lambda c: F.array_join(F.transform(c, lambda g: F.array_join(g, "|")), " & ")
    out = H.parse_repeated(keyed, F.lit("2024-03-15"))
    return out.select("photo_id", "tag", lists("words").alias("words"), lists("must").alias("must"), *[F.array_join(c, ";").alias(c) for c in ("phrases", "must_not", "wildcards")], F.array_join(F.transform("fields", lambda f: F.concat(f["field"], F.lit("="), f["value"])), ";").alias("fields"))


# the tags of visible photos with their words; a group's photos: all its words in one tag, or any where no photo has such a tag
VT = "vt AS (SELECT t.photo_id, string_split(replace(t.tag, 'ı', 'i'), ' ') AS w FROM {tags} t JOIN photos USING (photo_id) WHERE NOT private)"


def _multi(words):
    every, some = (f" {op} ".join(f"list_contains(w, '{x}')" for x in words) for op in ("AND", "OR"))
    return f"SELECT photo_id FROM vt WHERE ({some}) AND (({every}) OR NOT EXISTS (SELECT 1 FROM vt WHERE {every}))"


def _start(word):
    return f"SELECT photo_id FROM vt WHERE len(list_filter(w, lambda x: starts_with(x, '{word}'))) > 0"


def _text(words):
    return f"SELECT photo_id FROM seen WHERE len(list_filter(toks, lambda t: regexp_matches(t, '^({'|'.join(words)})'))) > 0"


def _named(name):
    return f"SELECT photo_id FROM faces JOIN persons USING (person_id) WHERE contains(lower(name), '{name}')"


def _best(words):
    one = lambda w: f"CASE WHEN list_contains(tags[1:3], '{w}') THEN 8 WHEN list_contains(tags, '{w}') THEN 6 WHEN len(list_filter(tags, lambda t: starts_with(t, '{w}'))) > 0 THEN 5 WHEN len(list_filter(tags, lambda t: contains(t, '{w}'))) > 0 THEN 4 WHEN contains(lower(path), '{w}') THEN 1 ELSE 0 END"
    return f"greatest({', '.join(map(one, words))})"


SEEN = "seen AS (SELECT photo_id, path, favorite, least(greatest(coalesce(rating, 0), 0), 5) + CASE WHEN favorite THEN 1 ELSE 0 END + least(coalesce(n, 0), 20) // 5 AS extra, coalesce(tags, []) AS tags, regexp_extract_all(strip_accents(lower(path || ' ' || coalesce(description, ''))), '[\\p{L}\\p{N}]+') AS toks FROM photos LEFT JOIN (SELECT photo_id, count(*) n, list_sort(list(tag))[1:10] AS tags FROM tags GROUP BY 1) USING (photo_id) LEFT JOIN descriptions USING (photo_id) WHERE NOT private)"


RANKED = "SELECT query_id, photo_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c DESC, photo_id) AS rank FROM hit QUALIFY rank <= 500"


def _hit(number, score, found, where="TRUE", context="0"):
    return f"SELECT CAST({number} AS BIGINT) AS query_id, photo_id, {score} + extra AS score, {context} AS c FROM seen WHERE photo_id IN ({found}) AND {where}"


NEAR = "near AS (SELECT list(DISTINCT x) AS n FROM (SELECT unnest(string_split(tag, ' ')) AS x FROM tags WHERE levenshtein('redplate', tag) <= 2))"
CLOSE = "len(list_filter(n, lambda x: {} list_contains(w, x)))"
FUZZY = f"SELECT photo_id FROM vt, near WHERE {CLOSE.format('')} > 0 AND ({CLOSE.format('NOT')} = 0 OR NOT EXISTS (SELECT 1 FROM vt, near WHERE {CLOSE.format('NOT')} = 0))"


@query("search", f""", {SEEN}, {VT.format(tags="tags")}, {NEAR}, hit AS ({_hit(1, _best(['red']) + ' + ' + _best(['plates', 'plat']), f"({_multi(['red'])} INTERSECT {_multi(['plate', 'dish', 'plates'])}) UNION {_text(['red', 'plates'])}", "NOT contains(path, '5') AND len(list_filter(tags, lambda t: contains(t, '5'))) = 0")}
UNION ALL {_hit(2, _best(['dish', 'rod']), _multi(['plate', 'dish', 'plates', 'rod', 'pole']) + " UNION " + _text(['dish', 'rod']))}
UNION ALL {_hit(3, '0', FUZZY)})
{RANKED}""", ("photos", "tags", "descriptions"))
def _(lib):
    tags = cut(lib.tags.select("photo_id", "tag"))
    photos = photo_summary(lib.photos, tags).join(lib.descriptions, "photo_id", "left")
    texts = [(1, "red the Plates -5"), (2, "dish OR rod"), (3, "redplate")]
    out = H.search(asked(lib, texts), photos, tags, lib.spark.createDataFrame([*SYNONYMS, (1, "plates")], "group_id int, term string"))
    return out.select("query_id", "photo_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


MANY = ["small", "gizmo", "blue", "ring", "plate", "large", "bolt", "rod"]
ALL_OF = " INTERSECT ".join(f"({_multi([w])})" for w in MANY)
CONTEXT = "len(list_filter(tags, lambda t: contains(t, 'hot') OR contains(t, 'small')))"
SEEN2 = SEEN.replace("FROM tags GROUP", "FROM said GROUP")


@query("search_routes", f""", said AS (SELECT photo_id, CASE WHEN tag = 'red plate' THEN 'kırmızı tabak' ELSE tag END AS tag FROM tags), {SEEN2}, {VT.format(tags="said")}, f5 AS (SELECT photo_id, {CONTEXT} AS c FROM seen WHERE photo_id IN ({_start('plate')} UNION {_text(['plate'])})), f7 AS (SELECT photo_id, {CONTEXT} AS c FROM seen WHERE photo_id IN ({ALL_OF} UNION (SELECT photo_id FROM ({_multi(MANY)}) WHERE NOT EXISTS ({ALL_OF})) UNION {_text(MANY)})), hit AS (
{_hit(1, _best(['red']) + ' + ' + _best(['xyzzyqq']), _multi(['red']) + " UNION " + _text(['red', 'xyzzyqq']))}
UNION ALL {_hit(2, _best(['person']) + ' + ' + _best(['3']), _named('person 3') + " UNION " + _text(['person']))}
UNION ALL {_hit(3, _best(['kırmızı', 'kirmizi']) + ' + ' + _best(['anvil']), _multi(['red', 'kirmizi', 'anvil']) + " UNION " + _text(['kirmizi', 'anvil']) + " UNION SELECT photo_id FROM descriptions WHERE len(list_intersect(regexp_extract_all(strip_accents(lower(description)), '[\\p{L}\\p{N}]+'), ['red', 'kirmizi', 'anvil'])) > 0")}
UNION ALL {_hit(5, _best(['plate', 'plat']), "SELECT photo_id FROM f5 WHERE c > 0 OR (SELECT count(*) FROM f5 WHERE c > 0) < 2", context=CONTEXT)}
UNION ALL {_hit(6, '0', _named('3'), "NOT contains(path, 'hot') AND len(list_filter(tags, lambda t: contains(t, 'hot'))) = 0")}
UNION ALL {_hit(7, ' + '.join(_best([w]) for w in MANY), "SELECT photo_id FROM f7 WHERE c > 0 OR (SELECT count(*) FROM f7 WHERE c > 0) < 2", context=CONTEXT)})
{RANKED} UNION ALL SELECT 4, photo_id, 0.0, rank FROM (SELECT photo_id, row_number() OVER (ORDER BY regexp_extract(path, '[^/]*$'), photo_id) AS rank FROM photos WHERE NOT private AND photo_id IN (SELECT photo_id FROM said WHERE tag = 'kırmızı tabak')) WHERE rank <= 500""", ("photos", "tags", "descriptions", "faces", "persons"))
def _(lib):
    tags = cut(lib.tags.select("photo_id", F.when(F.col("tag") == "red plate", "kırmızı tabak").otherwise(F.col("tag")).alias("tag")))
    photos = photo_summary(lib.photos, tags).join(lib.descriptions, "photo_id", "left")
    texts = [(1, "red xyzzyqq"), (2, "Person 3"), (3, "kırmızı anvil"), (4, " Kırmızı Tabak "), (5, "plate"), (6, "person:3 -hot"), (7, " ".join(MANY)), (8, "the qqzzy"), (9, None)]
    make = lib.spark.createDataFrame
    out = H.search(
        asked(lib, texts), photos, tags, make([], "group_id int, term string"), lib.faces.join(lib.persons, "person_id").select("photo_id", "name"),
        dictionary=make([("kırmızı", "red", None)], "source string, target string, context array<string>"), contexts=make([("plate", ["hot", "Small"])], "word string, tags array<string>"),
    )
    return out.select("query_id", "photo_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


FOUND = "SELECT CAST({} AS BIGINT) query_id, photo_id FROM photos WHERE NOT private AND photo_id IN (SELECT photo_id FROM tags WHERE {}) AND {}"


@query("search_fields", f"""{FOUND.format(1, "tag LIKE 'plate%' OR tag LIKE '% plate%'", "year(date_taken) = 1995 AND coalesce(rating, 0) >= 3")} UNION ALL {FOUND.format(2, "tag LIKE 'wid%' OR tag LIKE '% wid%'", "NOT favorite AND media_type = 'image' AND photo_id NOT IN (SELECT photo_id FROM tags WHERE tag LIKE '%hot%')")} UNION ALL SELECT 3, photo_id FROM photos WHERE NOT private AND path LIKE '%.png' AND folder = '/lib/5-LOW'""", ("photos", "tags"))
def _(lib):
    tags = cut(lib.tags.select("photo_id", "tag"))
    photos = photo_summary(lib.photos, tags, 1_000_000).withColumn("description", F.lit(None).cast("string"))
    texts = [(1, "plate year:1995 rating:>=3"), (2, "wid* -fav:1 type:IMAGE -hot"), (3, "ext:png in:5-low")]
    none = lib.spark.createDataFrame([], "group_id int, term string")
    return H.search(asked(lib, texts), photos, tags, none, limit=1_000_000_000).select("query_id", "photo_id")


@query("term_variants", "SELECT tag, list_distinct([tag, CASE WHEN tag LIKE '%ing' THEN substr(tag, 1, length(tag) - 3) WHEN tag LIKE '%ed' OR tag LIKE '%es' THEN substr(tag, 1, length(tag) - 2) WHEN tag LIKE '%s' AND tag NOT LIKE '%ss' THEN substr(tag, 1, length(tag) - 1) ELSE tag END]) AS n FROM (SELECT DISTINCT tag FROM tags)", ("tags",))
def _(lib):
    return lib.tags.select("tag").distinct().select("tag", F.array_sort(X.term_variants(F.col("tag"))).alias("n"))


@query("expand_synonyms", "SELECT tag, e AS expansion FROM (SELECT DISTINCT tag FROM tags), (VALUES ('plate'), ('dish')) v(e) WHERE tag = 'red plate' UNION ALL SELECT DISTINCT tag, tag FROM tags WHERE tag <> 'red plate'", ("tags",))
def _(lib):
    syn = lib.spark.createDataFrame([(1, "red plate"), (1, "plate"), (1, "dish")], "group_id int, term string")
    return H.expand_synonyms(lib.tags.select(F.col("tag").alias("term")).distinct(), syn).filter("expansion <> 'red plate'").select(F.col("term").alias("tag"), "expansion")


@query("fuzzy_tags", "SELECT CAST(1 AS BIGINT) query_id, 'smal widgett' AS term, tag, CAST(levenshtein('smal widgett', tag) AS INT) AS distance, count(*) uses FROM tags WHERE levenshtein('smal widgett', tag) <= 2 GROUP BY 3", ("tags",))
def _(lib):
    return H.fuzzy_tags(lib.tags, lib.spark.createDataFrame([(1, "smal widgett"), (1, "xq")], "query_id long, term string"))


@query("relevance", """SELECT photo_id, round(CASE WHEN list_contains(tags[1:3], 'red plate') THEN 8 WHEN list_contains(tags, 'red plate') THEN 6 WHEN path LIKE '%red plate%' THEN 1 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: t LIKE '%hot%')) > 0 THEN CASE WHEN list_contains(tags, 'hot') THEN 6 WHEN len(list_filter(tags, lambda t: starts_with(t, 'hot'))) > 0 THEN 5 ELSE 4 END ELSE 0 END
 + least(n, 20) // 5 + CASE WHEN favorite THEN 1 ELSE 0 END + greatest(0, least(coalesce(rating, 0), 5)), 4) AS score FROM photos JOIN (SELECT photo_id, count(*) n, list_sort(list(tag))[1:10] AS tags FROM tags GROUP BY 1) USING (photo_id)""", ("photos", "tags"))
def _(lib):
    rows = photo_summary(lib.photos, lib.tags).filter("tag_count > 0").withColumn("must", F.array(F.array(F.lit("red plate")), F.array(F.lit("hot")))).withColumn("phrases", F.array().cast("array<string>"))
    return rows.select("photo_id", F.round(H.relevance(), 4).alias("score"))


@query("exclude_terms", "SELECT photo_id FROM photos WHERE path NOT LIKE '%.heic' AND photo_id NOT IN (SELECT photo_id FROM tags WHERE tag LIKE '%ring%')", ("photos", "tags"))
def _(lib):
    return H.exclude_terms(photo_summary(lib.photos, lib.tags, 1_000_000).withColumn("must_not", F.array(F.lit("heic"), F.lit("ring")))).select("photo_id")


@query("context_rerank", "SELECT CAST(1 AS BIGINT) query_id, photo_id, count(*) AS context_score FROM tags WHERE tag LIKE '%hot%' OR tag LIKE '%small%' GROUP BY 2", ("tags",))
def _(lib):
    rows = photo_summary(lib.photos, lib.tags, 1_000_000).withColumn("query_id", F.lit(1).cast("long")).withColumn("context", F.array(F.lit("HOT"), F.lit("small")))
    return H.context_rerank(rows).select("query_id", "photo_id", F.col("context_score").cast("long").alias("context_score"))


@query("translate_terms", "SELECT photo_id || '|' || tag AS query_id, CASE WHEN tag = 'red plate' THEN ['kırmızı'] WHEN tag = 'hot ring' THEN ['sıcak', 'yüzük'] WHEN tag LIKE '% ring' THEN ['halka'] ELSE ['sıcak'] END AS terms FROM tags WHERE tag = 'red plate' OR tag LIKE '% ring' OR tag LIKE 'hot %'", ("tags",))
def _(lib):
    d = lib.spark.createDataFrame([("red plate", "kırmızı", None), ("hot", "sıcak", None), ("ring", "yüzük", ["hot"]), ("ring", "halka", None)], "source string, target string, context array<string>")
    return H.translate_terms(lib.tags.select(F.concat_ws("|", "photo_id", "tag").alias("query_id"), F.col("tag").alias("text")), d)


DAYS = ["yesterday", "Last-Week", "bu_ay", "2weeks", "whenever", "6aylar", "1-year", "this-year", "today", "geçen-ay", "last month"]


@query("date_keyword_range", f"""SELECT photo_id, CASE k WHEN 0 THEN d - 1 WHEN 1 THEN CAST(date_trunc('week', d) AS DATE) - 7 WHEN 2 THEN CAST(date_trunc('month', d) AS DATE) WHEN 3 THEN d - 14 WHEN 5 THEN c - INTERVAL 6 MONTH WHEN 6 THEN c - INTERVAL 1 YEAR WHEN 7 THEN CAST(date_trunc('year', d) AS DATE) WHEN 8 THEN d WHEN 9 THEN CAST(date_trunc('month', d) AS DATE) - INTERVAL 1 MONTH END::DATE AS s,
CASE k WHEN 0 THEN d - 1 WHEN 1 THEN CAST(date_trunc('week', d) AS DATE) - 1 WHEN 2 THEN d WHEN 3 THEN d - 14 WHEN 5 THEN c - INTERVAL 6 MONTH WHEN 6 THEN c - INTERVAL 1 YEAR WHEN 7 THEN d WHEN 8 THEN d WHEN 9 THEN CAST(date_trunc('month', d) AS DATE) - 1 END::DATE AS e
FROM (SELECT photo_id, photo_id % {len(DAYS)} AS k, created_at AS d, least(created_at, CAST(date_trunc('month', created_at) AS DATE) + 27) AS c FROM photos)""", ("photos",))
def _(lib):
    k = F.element_at(F.array(*map(F.lit, DAYS)), (F.col("photo_id") % len(DAYS) + 1).cast("int"))
    return lib.photos.select("photo_id", H.date_keyword_range(k, F.col("created_at")).alias("r")).select("photo_id", F.col("r.start").alias("s"), F.col("r.end").alias("e"))


SAID = "The a an in on at of by to for with is are was were be been from and or but this that these those into over after under about between through up out its it as all both than too also some any my your our his her their I we you he she they show find photo photos picture near no not me has have there cat"


@query("stop_words", f"SELECT tag, CASE WHEN tag LIKE 'red %' THEN list_concat(string_split(tag, ' '), ['show', 'find', 'photo', 'photos', 'picture', 'near', 'no', 'not', 'me', 'has', 'have', 'there', 'cat']) ELSE ['the', 'OF', 'the'] END AS w FROM (SELECT DISTINCT tag FROM tags)", ("tags",))
def _(lib):
    words = F.when(F.col("tag").startswith("red "), F.concat(F.split("tag", " "), F.split(F.lit(SAID), " "))).otherwise(F.array(F.lit("the"), F.lit("OF"), F.lit("the")))
    return lib.tags.select("tag").distinct().select("tag", H.remove_stop_words(words).alias("w"))


@query("haversine_km", "SELECT photo_id, round(2 * 6371 * asin(sqrt(pow(sin(radians(gps_lat - 37) / 2), 2) + cos(radians(37)) * cos(radians(gps_lat)) * pow(sin(radians(gps_lon - 27) / 2), 2))), 4) AS km FROM photos WHERE gps_lat IS NOT NULL", ("photos",))
def _(lib):
    return lib.photos.filter("gps_lat is not null").select("photo_id", F.round(G.haversine_km(F.lit(37.0), F.lit(27.0), F.col("gps_lat"), F.col("gps_lon")), 4).alias("km"))


@query("gps_clusters")
def _(lib):
    return G.gps_clusters(lib.photos)


@query("list_clusters", "SELECT 10 + photo_id % 40 AS cluster_id, count(*) n, round(avg(gps_lat), 6) AS lat, min(coalesce(date_taken, created_at)) AS first_day FROM photos WHERE gps_lat IS NOT NULL GROUP BY 1", ("photos",))
def _(lib):
    c = lib.photos.filter("gps_lat is not null").select("photo_id", (F.col("photo_id") % 40 + 10).alias("cluster_id"))
    return G.list_clusters(lib.photos, c).select("cluster_id", "n", F.round("lat", 6).alias("lat"), "first_day")


@query("clusters_to_collections", "SELECT collection_id, photo_id FROM collection_photos UNION ALL SELECT 5 + photo_id % 3, photo_id FROM photos WHERE favorite", ("photos", "collection_photos"))
def _(lib):
    return G.clusters_to_collections(lib.photos.filter("favorite").select("photo_id", (F.col("photo_id") % 3).alias("cluster_id")), lib.collection_photos)


#: Tasks for each core that make pixels.
PIXEL_TASKS = 4


def pixels(lib, side):
    """A row for every photo, whose image is drawn from hashes of its id where it is looked at."""
    # the photos' table is small beside their pixels, so its few partitions are dealt out first
    photos = lib.photos.select("photo_id").repartition(PIXEL_TASKS * lib.spark.sparkContext.defaultParallelism)
    return photos.select("photo_id", F.lit(side).alias("width"), F.lit(side).alias("height"), F.concat(F.col("photo_id").cast("string"), F.lit("-")).cast("binary").alias("pixels"))


def drawn(size):
    """From a name, that many bytes: the SHA-256 of the name and 0, of the name and 1, and so on."""
    tails = [b"%d" % i for i in range(-(-size // 32))]

    def decode(name):
        begun, out = hashlib.sha256(name), []
        for tail in tails:
            one = begun.copy()
            one.update(tail)
            out.append(one.digest())
        return b"".join(out)[:size]

    return decode


@query("perceptual_hash")
def _(lib):
    return P.perceptual_hash(pixels(lib, 32), drawn(32 * 32))


@query("blur_metrics")
def _(lib):
    return P.blur_metrics(pixels(lib, 256), drawn(256 * 256))


@query("dominant_colours")
def _(lib):
    return P.dominant_colours(pixels(lib, 48), decode=drawn(48 * 48 * 3))


CHANGE = "SELECT 'tag' AS kind, hash AS photo_hash, tag, source AS value, CAST(photo_id % {m} AS BIGINT) AS updated_at, 'd{d}' AS by_device, photo_id % 7 = {d} AS deleted FROM tags JOIN (SELECT photo_id, hash FROM photos) USING (photo_id)"


@query("merge_changes", f", c AS ({CHANGE.format(m=5, d=1)} UNION ALL {CHANGE.format(m=3, d=2)}) SELECT photo_hash, tag, by_device, deleted FROM (SELECT *, row_number() OVER (PARTITION BY kind, photo_hash, tag ORDER BY updated_at DESC, by_device DESC, value DESC) r FROM c) WHERE r = 1", ("photos", "tags"))
def _(lib):
    rows = lib.tags.join(lib.photos.select("photo_id", "hash"), "photo_id")

    def feed(m, d):
        return rows.select(F.lit("tag").alias("kind"), F.col("hash").alias("photo_hash"), "tag", F.col("source").alias("value"), (F.col("photo_id") % m).alias("updated_at"), F.lit(f"d{d}").alias("by_device"), (F.col("photo_id") % 7 == d).alias("deleted"))

    return W.merge_changes(feed(5, 1), feed(3, 2)).select("photo_hash", "tag", "by_device", "deleted")


@query("auto_tag_queue", "SELECT photo_id FROM photos WHERE folder IN ('/lib/1-URGENT', '/lib/5-LOW')", ("photos",))
def _(lib):
    watch = lib.spark.createDataFrame([("/lib/1-URGENT", True), ("/lib/5-LOW/", True), ("/lib/2-HIGH", False)], "path string, auto_tag boolean")
    return W.auto_tag_queue(lib.photos.select("photo_id", "path"), watch).select("photo_id")


_ = dt
