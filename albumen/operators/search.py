"""Text search: many queries at once, each with its query_id, as joins on token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, fold, lower, strip_accents, term_variants, tokens
from .filters import FIELDS, OTHER_FIELDS, field_met
from .iterate import cut

# fixed values
STOP_WORDS = (
    "the", "a", "an", "in", "on", "at", "of", "by", "to", "for", "with", "is", "are", "was", "were", "be", "been", "from", "and", "or", "but",
    "this", "that", "these", "those", "into", "over", "after", "under", "about", "between", "through", "up", "out", "its", "it", "as", "all",
    "both", "than", "too", "also", "some", "any", "my", "your", "our", "his", "her", "their", "i", "we", "you", "he", "she", "they",
)

#: Letters of a word's start that meet in a prefix search; longer words are compared in whole after that.
LONGEST_START = 24
#: Query words up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_WORDS = 1 << 16

#: Query words up to this many are looked for in whole texts before these are taken apart.
FEW_WORDS = 64

#: Pieces of a tag, one more than the largest edit budget.
PIECES = 3


def token_table(rows: DataFrame, id_col: str, text_col: str, field: str) -> DataFrame:
    """(doc, field, pos, token) of each row's text."""
    return rows.select(F.col(id_col).alias("doc"), F.lit(field).alias("field"), F.posexplode(tokens(F.col(text_col))).alias("pos", "token"))


def tag_tokens(tags: DataFrame) -> DataFrame:
    """(photo_id, tag, pos, token): each tag is a document of its own."""
    return tags.select("photo_id", "tag", F.posexplode(tokens(F.col("tag"))).alias("pos", "token"))


def search_all_words(index: DataFrame, queries: DataFrame, doc: list[str], prefix: bool = False) -> DataFrame:
    """(query_id, doc..): documents with all words of queries(query_id, text); with prefix a word is a token's start."""
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    need = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    return _hits(index, words, doc, prefix).groupBy("query_id", *doc).agg(F.countDistinct("word").alias("have")).join(need, "query_id").filter("have = need").select("query_id", *doc)


def _hits(index: DataFrame, words: DataFrame, doc: list[str], prefix: bool) -> DataFrame:
    if not prefix:
        return index.join(words, index["token"] == words["word"]).select("query_id", "word", *doc)
    # words meet the starts of tokens, of the lengths that words have, so a prefix search is an equi-join too
    short = words.withColumn("start", F.substring("word", 1, LONGEST_START))
    sizes = {r.n: r.c for r in short.groupBy(F.length("start").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}  # LONGEST_START rows at most
    lengths = F.filter(F.array(*map(F.lit, sorted(sizes))).cast("array<int>"), lambda n: n <= F.length("token"))
    starts = index.select(*doc, "token", F.explode(lengths).alias("n")).withColumn("start", F.substring(F.col("token"), F.lit(1), F.col("n")))
    few = sum(sizes.values()) <= BROADCAST_WORDS
    return starts.join(F.broadcast(short) if few else short, "start").filter(F.col("token").startswith(F.col("word"))).select("query_id", "word", *doc)


def search_any_word(index: DataFrame, queries: DataFrame, doc: list[str], least: int = 2, prefix: bool = False) -> DataFrame:
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).filter(F.octet_length("word") >= least)
    return _hits(index, words, doc, prefix).select("query_id", *doc).distinct()


def search_phrase(index: DataFrame, queries: DataFrame, doc: list[str]) -> DataFrame:
    """Documents where the words of the query stand in a row."""
    words = queries.select("query_id", tokens(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    each = words.select("query_id", F.size("ws").alias("n"), F.posexplode("ws").alias("at", "token"))
    found = index.join(each, "token").withColumn("start", F.col("pos") - F.col("at"))
    return found.groupBy("query_id", *doc, "start", "n").agg(F.countDistinct("at").alias("c")).filter("c = n").select("query_id", *doc).distinct()


def search_tags_phrase(tags: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, photo_id): the words of the query in a row in one tag. Words meet each distinct tag once."""
    vocabulary = tags.select("tag").distinct().select("tag", F.posexplode(tokens(F.col("tag"))).alias("pos", "token"))
    return tags.select("photo_id", "tag").join(search_phrase(vocabulary, queries, ["tag"]), "tag").select("query_id", "photo_id").distinct()


def matching_tags(tags: DataFrame, queries: DataFrame, prefix: bool = False) -> DataFrame:
    """(query_id, tag): the distinct tags that have all words of a query."""
    vocabulary = tags.select("tag").distinct().select("tag", F.explode(F.array_distinct(tokens(F.col("tag")))).alias("token"))
    return search_all_words(vocabulary, queries, ["tag"], prefix)


def search_tags(tags: DataFrame, queries: DataFrame, prefix: bool = False) -> DataFrame:
    """(query_id, photo_id): all the words in one tag. Words meet each distinct tag once."""
    return tags.select("photo_id", "tag").join(matching_tags(tags, queries, prefix), "tag").select("query_id", "photo_id").distinct()


def search_tags_multi(tags: DataFrame, queries: DataFrame) -> DataFrame:
    """All words in one tag; for a query without such hits, any word."""
    strict = search_tags(tags, queries)
    loose = search_any_word(tag_tokens(tags), queries, ["photo_id"], least=1)
    return strict.unionByName(loose.join(strict.select("query_id").distinct(), "query_id", "left_anti"))


def search_tag_exact(tags: DataFrame, queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", lower(F.trim("text")).alias("_t"))
    return tags.join(q, lower(F.col("tag")) == q["_t"]).select("query_id", "photo_id").distinct()


def search_path(photos: DataFrame, queries: DataFrame) -> DataFrame:
    """Any word of two bytes or more as a start of a word of file name, folder or description. photos: photo_id, path, description."""
    text = F.concat_ws(" ", "path", F.coalesce("description", F.lit("")))
    return search_any_word(photos.select("photo_id", F.explode(F.array_distinct(tokens(text))).alias("token")), queries, ["photo_id"], prefix=True)


def search_description(descriptions: DataFrame, queries: DataFrame) -> DataFrame:
    return search_any_word(token_table(descriptions, "photo_id", "description", "description"), queries, ["doc"]).withColumnRenamed("doc", "photo_id")


# --- query texts

PARSED = "query_id long, words array<array<string>>, must array<array<string>>, phrases array<string>, must_not array<string>, fields array<struct<field:string,value:string>>, wildcards array<string>"


def _parts(text: Column) -> Column:
    """The parts of a query text in order: struct(kind, body, field, value)."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'(-?"[^"]*"?|-?[^\s"]+)'), 1)

    def part(t: Column) -> Column:
        no = t.startswith("-")
        return bound(F.when(no, F.substring(t, F.lit(2), F.length(t))).otherwise(t), lambda body: read(no, body))

    def read(no: Column, body: Column) -> Column:
        said = F.lower(F.when(body.startswith('"'), F.trim(F.regexp_replace(body, '"', ""))).otherwise(body))
        field, value = F.lower(F.regexp_extract(body, r"^([^:]+):", 1)), F.trim(F.regexp_extract(body, r"^[^:]+:(.+)$", 1))
        return bound(F.struct(no.alias("no"), body.startswith('"').alias("quoted"), said.alias("said"), field.alias("field"), value.alias("value")), told)

    def told(p: Column) -> Column:
        no, quoted, said, field, value = (p[x] for x in ("no", "quoted", "said", "field", "value"))
        kind = (
            F.when(said == "", "nothing")
            .when(~quoted & field.isin(*FIELDS, *OTHER_FIELDS) & (value != ""), "field")
            .when(no, "not")
            .when(quoted, "phrase")
            .when(said == "or", "or")
            .when(said == "and", "nothing")
            .when(said.endswith("*") & (F.length(said) > 1), "start")
            .otherwise("word")
        )
        return F.struct(kind.alias("kind"), said.alias("body"), F.concat(F.when(no, "!").otherwise(""), field).alias("field"), value.alias("value"))

    return F.transform(raw, part)


def parse_searches(queries: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The parts of queries(query_id, text), in lower case; other columns of queries stay, but for those named as a part.

    words: groups of alternatives (`a or b`); must: the same with the words' forms; phrases: `"a b"`; must_not: `-a`,
    `-"a b"`; fields: `key:value`, negated with `!` before the key, date words turned into days before or after, as of
    today or `as_of`; wildcards: starts of words, from `a*`. Null text has no parts.
    """
    of = lambda kind: F.filter("parts", lambda p: p["kind"] == kind)
    bodies = lambda kind: F.transform(of(kind), lambda p: p["body"])
    none = F.array().cast("array<array<string>>")

    def grouped(state: Column, p: Column) -> Column:
        groups, word = state["groups"], F.array(p["body"])
        head = lambda n: F.slice(groups, F.lit(1), F.greatest(n, F.lit(0)))
        joined = F.concat(head(F.size(groups) - 1), F.array(F.concat(F.element_at(groups, -1), word)))
        after = F.when(p["kind"] != "word", groups).when(state["or"] & (F.size(groups) > 0), joined).otherwise(F.concat(groups, F.array(word)))
        return F.struct(after.alias("groups"), (p["kind"] == "or").alias("or"))

    today = F.current_date() if as_of is None else as_of

    def resolved(f: Column) -> Column:
        same = F.array(F.struct(f["field"].alias("field"), f["value"].alias("value")))
        dated = f["field"].isin("before", "to", "after", "from", "date", "year")
        return F.when(dated, bound(date_keyword_range(f["value"], today), lambda span: ends(f, span, same))).otherwise(same)

    def ends(f: Column, span: Column, same: Column) -> Column:
        end = lambda name, at: F.struct(F.lit(name).alias("field"), span[at].cast("string").alias("value"))
        return (
            F.when(span.isNull(), same)
            .when(f["field"].isin("before", "to"), F.array(end("before", "end")))
            .when(f["field"].isin("after", "from"), F.array(end("after", "start")))
            .otherwise(F.array(end("after", "start"), end("before", "end")))
        )

    named = {"query_id", "text", "parts", "words", "must", "phrases", "must_not", "fields", "wildcards"}
    others = [F.col(f"`{c}`") for c in queries.columns if c not in named]
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), *others, _parts(F.col("text")).alias("parts"))
    words = F.aggregate("parts", F.struct(none.alias("groups"), F.lit(False).alias("or")), grouped)["groups"]
    rows = rows.withColumn("words", words)
    return rows.select(
        "query_id", "words",
        F.transform("words", lambda g: F.array_distinct(F.flatten(F.transform(g, term_variants)))).alias("must"),
        bodies("phrase").alias("phrases"), bodies("not").alias("must_not"),
        F.flatten(F.transform(of("field"), resolved)).alias("fields"),
        F.transform(bodies("start"), lambda w: F.regexp_replace(w, r"\*+$", "")).alias("wildcards"), *others,
    )


def parse_repeated(queries: DataFrame, as_of: Column | None = None) -> DataFrame:
    """`parse_searches` of many queries whose texts repeat: each different text is parsed once, by as many tasks as these need."""
    keyed = queries.withColumn("_text", F.coalesce("text", F.lit("")))
    texts = keyed.select("_text").distinct().select(F.lit(0).alias("query_id"), "_text", F.col("_text").alias("text"))
    parsed = parse_searches(texts, as_of).drop("query_id")
    named = [c for c in queries.columns if c not in {"text", *parsed.columns}]
    return keyed.select(*[F.col(f"`{c}`") for c in named], "_text").join(parsed, "_text").drop("_text")


def remove_stop_words(words: Column) -> Column:
    """words without stop words in any case, or all of them where nothing would be left."""
    left = F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return F.when(F.size(left) == 0, words).otherwise(left)


def expand_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(.., term, expansion): the terms of the first group that has the term, as it is or without accents, else the term."""
    group = synonyms.groupBy(F.lower("term").alias("_t")).agg(F.min("group_id").alias("_g"))
    plain = strip_accents(F.lower("term"))
    out = terms.join(group, F.lower(terms["term"]) == group["_t"], "left").drop("_t").withColumnRenamed("_g", "_g1")
    out = out.withColumn("_p", plain).join(group.withColumnRenamed("_t", "_t2"), F.col("_p") == F.col("_t2"), "left").withColumn("_g", F.coalesce("_g1", "_g")).drop("_g1", "_t2", "_p")
    lists = synonyms.groupBy(F.col("group_id").alias("_g")).agg(F.collect_set(F.lower("term")).alias("_all"))
    return out.join(lists, "_g", "left").select(*terms.columns, F.explode(F.coalesce("_all", F.array(F.lower("term")))).alias("expansion"))


def fuzzy_budget(c: Column) -> Column:
    return F.when(F.length(c) <= 4, 0).when(F.length(c) <= 7, 1).otherwise(2)


def _piece(text: Column, size: Column, i: Column, moved: Column | int = 0) -> Column:
    """The letters of text where the i-th of PIECES of a text of so many letters stands, moved by some."""
    at = lambda n: F.floor(size * n / PIECES).cast("int")
    return F.substring(text, at(i) + moved + 1, at(i + 1) - at(i))


def fuzzy_tags(tags: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term, tag, distance, uses): all tags, in lower case, within the term's edit budget.

    Two edits leave one of three pieces of a tag as it is and move it by two letters at most. So each tag meets only the
    terms that have one of its pieces about there, however many tags there are, and the distance decides.
    """
    used = tags.groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("uses"))
    size = F.length("tag")
    # pieces of the shortest tags are empty; the last one is not, unless the tag is
    pieces = used.select("tag", "uses", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("i")).withColumn("piece", _piece(F.col("tag"), F.col("size"), F.col("i")))
    pieces = pieces.filter((F.col("piece") != "") | (F.col("i") == PIECES - 1))

    budget = fuzzy_budget(F.col("term"))
    asked = terms.select("term").distinct().withColumn("low", F.lower("term")).withColumn("budget", budget).withColumn("n", F.length("low"))
    asked = asked.withColumn("size", F.explode(F.sequence(F.greatest(F.col("n") - F.col("budget"), F.lit(0)), F.col("n") + F.col("budget"))))
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))).withColumn("moved", F.explode(F.sequence(-F.col("budget"), F.col("budget"))))
    fits = F.floor(F.col("size") * F.col("i") / PIECES) + F.col("moved") >= 0
    asked = asked.filter(fits).select("term", "low", "budget", "size", "i", _piece(F.col("low"), F.col("size"), F.col("i"), F.col("moved")).alias("piece")).distinct()

    near = asked.join(pieces, ["size", "i", "piece"]).withColumn("distance", F.levenshtein("low", "tag", 2)).filter((F.col("distance") >= 0) & (F.col("distance") <= F.col("budget")))
    near = near.select("term", "tag", "distance", "uses").distinct()
    return terms.select("query_id", "term").join(near, "term").select("query_id", "term", "tag", "distance", "uses")


def relevance(must: str = "must", phrases: str = "phrases") -> Column:
    """A photo row's score (with tags, path, tag_count, favorite, rating) for groups of terms and phrases."""
    low = F.transform("tags", lambda t: F.lower(t))
    head = F.slice(low, 1, 3)
    path = F.lower("path")

    def term(t: Column) -> Column:
        return (
            F.when(F.array_contains(head, t), 8.0)
            .when(F.array_contains(low, t), 6.0)
            .when(F.exists(low, lambda x: x.startswith(t)), 5.0)
            .when(F.exists(low, lambda x: x.contains(t)), 4.0)
            .when(path.contains(t), 1.0)
            .otherwise(0.0)
        )

    def phrase(t: Column) -> Column:
        return F.when(F.array_contains(low, t), 8.0).when(F.exists(low, lambda x: x.contains(t)), 5.0).when(path.contains(t), 1.0).otherwise(0.0)

    groups = F.aggregate(must, F.lit(0.0), lambda s, g: s + F.coalesce(F.array_max(F.transform(g, term)), F.lit(0.0)))
    extra = F.aggregate(phrases, F.lit(0.0), lambda s, p: s + phrase(p))
    rating = F.greatest(F.lit(0), F.least(F.coalesce("rating", F.lit(0)), F.lit(5)))
    return groups + extra + F.floor(F.least("tag_count", F.lit(20)) / 5) + F.when(F.col("favorite"), 1.0).otherwise(0.0) + rating


def exclude_terms(rows: DataFrame, must_not: str = "must_not") -> DataFrame:
    """rows without those whose tags or path hold one of their terms."""
    hit = F.exists(must_not, lambda t: F.exists("tags", lambda x: F.lower(x).contains(t)) | F.lower("path").contains(t))
    return rows.filter(~F.coalesce(hit, F.lit(False)))


def context_rerank(rows: DataFrame, words: str = "context") -> DataFrame:
    """rows(query_id, tags, context) with context_score; where two or more score, those without go."""
    score = F.size(F.filter("tags", lambda t: F.exists(words, lambda w: F.lower(t).contains(F.lower(w)))))
    out = rows.withColumn("context_score", F.when(F.col(words).isNull(), 0).otherwise(score))
    n = F.count_if(F.col("context_score") > 0).over(Window.partitionBy("query_id"))
    return out.withColumn("_n", n).filter((F.col("_n") < 2) | (F.col("context_score") > 0)).drop("_n")


def translate_terms(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, terms): the dictionary(source, target, context)'s entry for the whole text, else word by word; unknown words are left out.

    An entry with a context counts only where the text holds one of its words, and before one without.
    """
    keyed = queries.select("query_id", fold(F.trim("text")).alias("_q")).filter("_q is not null")
    texts = keyed.select("_q").distinct()  # each different text is looked up once
    d = dictionary.select(fold(F.col("source")).alias("_s"), "target", F.col("context").alias("_ctx"))
    said = tokens(F.col("_q"))
    fits = F.col("_ctx").isNull() | F.arrays_overlap(F.transform(F.coalesce("_ctx", F.array().cast("array<string>")), lambda c: fold(c)), said)
    best = F.min(F.struct(F.when(F.col("_ctx").isNull(), 1).otherwise(0).alias("o"), F.col("target").alias("t")))["t"]
    # the whole text is place -1, before its words
    words = texts.select("_q", F.posexplode(F.concat(F.array("_q"), said)).alias("_p", "_w")).withColumn("_p", F.col("_p") - 1)
    each = words.join(d, F.col("_w") == F.col("_s")).filter(fits).groupBy("_q", "_p").agg(best.alias("t"))
    lists = each.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("_p", "t"))).alias("l"))
    terms = F.when(F.get("l", F.lit(0))["_p"] == -1, F.slice("l", 1, 1)).otherwise(F.col("l"))
    return keyed.join(lists.select("_q", F.transform(terms, lambda s: s["t"]).alias("terms")), "_q").select("query_id", "terms")


# fixed values: units of `3days`, in English and Turkish
UNITS = {
    "day": ("day", "days", "gun", "günler", "gün", "günü"),
    "week": ("week", "weeks", "hafta", "haftalar"),
    "month": ("month", "months", "ay", "aylar"),
    "year": ("year", "years", "yil", "yıl", "yillar", "yıllar"),
}


def date_keyword_range(keyword: Column, as_of: Column) -> Column:
    """struct(start, end) of a date word, null for other words. Months and years back move to day 28 at most."""
    return bound(F.regexp_replace(lower(F.trim(keyword)), "_", "-"), lambda k: _date_range(k, as_of.cast("date")))


def _date_range(k: Column, d: Column) -> Column:
    monday, month, year = F.trunc(d, "week"), F.trunc(d, "month"), F.trunc(d, "year")
    counted = r"^(\d{1,6})-*([^\d-].*)$"
    capped = F.least(d, F.date_add(month, 27))
    one = lambda a, b: F.struct(a.cast("date").alias("start"), b.cast("date").alias("end"))
    back = lambda months: F.add_months(capped, -months)

    def ago(said: Column) -> Column:
        number, unit = said["number"], said["unit"]
        day = F.when(unit.isin(*UNITS["day"]), F.date_sub(d, number)).when(unit.isin(*UNITS["week"]), F.date_sub(d, number * 7)).when(unit.isin(*UNITS["month"]), back(number)).when(unit.isin(*UNITS["year"]), back(number * 12))
        return bound(day, lambda at: F.when(at.isNotNull(), one(at, at)))

    return (
        F.when(k.isin("today", "bugun", "bugün"), one(d, d))
        .when(k.isin("yesterday", "dun", "dün"), one(F.date_sub(d, 1), F.date_sub(d, 1)))
        .when(k.isin("this-week", "thisweek", "bu-hafta", "buhafta"), one(monday, d))
        .when(k.isin("last-week", "lastweek", "gecen-hafta", "geçen-hafta"), one(F.date_sub(monday, 7), F.date_sub(monday, 1)))
        .when(k.isin("this-month", "thismonth", "bu-ay", "buay"), one(month, d))
        .when(k.isin("last-month", "lastmonth", "gecen-ay", "geçen-ay"), one(F.add_months(month, -1), F.date_sub(month, 1)))
        .when(k.isin("this-year", "thisyear", "bu-yil", "bu-yıl"), one(year, d))
        .when(k.isin("last-year", "lastyear", "gecen-yil", "geçen-yıl"), one(F.add_months(year, -12), F.date_sub(year, 1)))
        .when(k.rlike(r"^\d"), bound(F.struct(F.regexp_extract(k, counted, 1).try_cast("int").alias("number"), F.regexp_extract(k, counted, 2).alias("unit")), ago))
    )


def row_condition(f: Column) -> Column:
    """Whether a photo row (with tags) meets a field of a parsed query: struct(field, value); `!` negates. Persons are joined apart."""
    name, negated = F.regexp_replace(f["field"], "^!", ""), f["field"].startswith("!")
    met = field_met(name, f["value"])
    return F.when(name == "person", True).when(negated, ~met).otherwise(met)


# fixed values: ambiguous words and the tags that tell what is meant
CONTEXTS = {
    "cup": ("drink", "beverage", "coffee", "tea", "food"),
    "glass": ("drink", "beverage", "wine", "water"),
    "bat": ("sport", "baseball", "cricket"),
    "spring": ("season", "flower", "bloom"),
    "bark": ("dog", "tree"),
    "mouse": ("computer", "animal"),
}

#: Columns of photos that a search reads.
SUMMARY = ("photo_id", "tags", "tag_count", "path", "description", "media_type", "favorite", "rating", "date_taken")

#: Numbers of the groups of a query that are not one of its words: all its words, its phrases, its starts of words.
ALL_WORDS, PHRASES, STARTS = -1, 10_000, 20_000


def _routes(queries: DataFrame, as_of: Column | None) -> DataFrame:
    """The parsed queries with what decides their way: said (the text in lower case), foreign, bare, content (groups of words)."""
    said = lower(F.trim(F.coalesce("text", F.lit(""))))
    parsed = parse_searches(queries, as_of).join(queries.select(F.col("query_id").cast("long").alias("query_id"), said.alias("said"), F.trim("text").rlike(r"[^\x00-\x7F]").alias("foreign")), "query_id").filter("said <> ''")
    left = F.transform("words", lambda g: F.filter(g, lambda w: ~w.isin(*STOP_WORDS)))
    content = F.when(F.exists(left, lambda g: F.size(g) > 0), F.filter(left, lambda g: F.size(g) > 0)).otherwise(F.col("words"))
    asks = (F.size("fields") > 0) | (F.size("must_not") > 0)
    return parsed.withColumn("content", content).withColumn("bare", asks & (F.size("words") == 0) & (F.size("phrases") == 0) & (F.size("wildcards") == 0))


def _groups(parsed: DataFrame, synonyms: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """(query_id, group_id, word, kind) of all queries. kind: `multi` (all words of the group in one tag, or if no photo has
    such a tag, any), `strict` (all words in one tag), `start` (a word's start)."""
    english, foreign = parsed.filter("not foreign"), parsed.filter("foreign")
    alts = english.select("query_id", F.posexplode("content").alias("group_id", "alts")).select("query_id", "group_id", F.explode("alts").alias("term"))
    # a query in another language is one group: the dictionary's words, the text itself, the synonyms of its words
    own = foreign.select("query_id", F.lit(0).alias("group_id"), F.explode(F.split("said", r"\s+")).alias("term"))
    wide = expand_synonyms(alts.unionByName(own), synonyms).select("query_id", "group_id", F.col("expansion").alias("text"))
    wide = wide.unionByName(foreign.select("query_id", F.lit(0).alias("group_id"), F.col("said").alias("text")))
    if dictionary is not None:
        known = translate_terms(foreign.select("query_id", F.col("said").alias("text")), dictionary)
        wide = wide.unionByName(known.select("query_id", F.lit(0).alias("group_id"), F.explode("terms").alias("text")))
    words = wide.select("query_id", "group_id", F.explode(tokens(F.col("text"))).alias("word")).distinct()
    # a query of one word without synonyms takes it as a start
    size = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    alone = english.filter((F.size("content") == 1) & (F.size("phrases") == 0) & (F.size("wildcards") == 0)).select("query_id", F.lit(True).alias("alone"))
    words = words.join(size, "query_id").join(alone, "query_id", "left").select("query_id", "group_id", "word", F.when(F.col("alone") & (F.col("n") == 1), "start").otherwise("multi").alias("kind"))
    every = english.filter(F.size("content") > 1).select("query_id", F.lit(ALL_WORDS).alias("group_id"), F.explode(tokens(F.array_join(F.flatten("content"), " "))).alias("word"), F.lit("multi").alias("kind")).distinct()
    listed = lambda c, base, kind: english.select("query_id", F.posexplode(c).alias("g", "text")).select("query_id", (F.col("g") + base).alias("group_id"), F.explode(tokens(F.col("text"))).alias("word"), F.lit(kind).alias("kind")).distinct()
    return words.unionByName(every).unionByName(listed("phrases", PHRASES, "strict")).unionByName(listed("wildcards", STARTS, "start"))


def _group_hits(groups: DataFrame, tags: DataFrame, shown: DataFrame) -> DataFrame:
    """(query_id, group_id, photo_id): the photos of every group. Words meet each distinct tag once; tags meet photos once."""
    vocabulary = tags.select("tag").distinct().select("tag", F.explode(F.array_distinct(tokens(F.col("tag")))).alias("token"))
    keyed = groups.select(F.struct("query_id", "group_id", "kind").alias("query_id"), "word")
    exact = _hits(vocabulary, keyed.filter("query_id.kind <> 'start'"), ["tag"], False)
    starts = _hits(vocabulary, keyed.filter("query_id.kind = 'start'"), ["tag"], True)
    need = keyed.groupBy("query_id").agg(F.countDistinct("word").alias("need"))
    met = exact.unionByName(starts).groupBy("query_id", "tag").agg(F.countDistinct("word").alias("have")).join(need, "query_id")
    met = met.withColumn("whole", F.col("have") == F.col("need")).filter("whole or query_id.kind = 'multi'").select("query_id.query_id", "query_id.group_id", "tag", "whole")
    hits = tags.select("photo_id", "tag").join(met, "tag").groupBy("query_id", "group_id", "photo_id").agg(F.max("whole").alias("whole"))
    hits = cut(hits.join(shown, "photo_id", "left_semi"))
    best = hits.groupBy("query_id", "group_id").agg(F.max("whole").alias("best"))
    return hits.join(best, ["query_id", "group_id"]).filter("whole = best").select("query_id", "group_id", "photo_id")


def _text_hits(parsed: DataFrame, photos: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, photo_id): a content word of two bytes or more starts a word of path or description; for a query in
    another language also, a word of its group is one of the description's words."""
    text = lambda *c: F.array_distinct(tokens(F.concat_ws(" ", *c)))
    own = F.when(F.col("foreign"), F.col("said")).otherwise(F.array_join(F.flatten("content"), " "))
    words = parsed.filter("not bare").select("query_id", F.explode(F.array_distinct(tokens(own))).alias("word")).filter(F.octet_length("word") >= 2)
    said = groups.join(parsed.filter("foreign"), "query_id", "left_semi").filter(F.octet_length("word") >= 2).select("query_id", "word").distinct()
    few = [r.word for r in words.select("word").unionByName(said.select("word")).distinct().limit(FEW_WORDS + 1).collect()]
    if len(few) <= FEW_WORDS:  # texts without any of the words, the most by far, are not taken apart
        photos = photos.filter(fold(F.concat_ws(" ", "path", "description")).rlike(rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(few)})"))
    begun = _hits(photos.select("photo_id", F.explode(text("path", "description")).alias("token")), words, ["photo_id"], True)
    if not said.isEmpty():
        begun = begun.unionByName(_hits(photos.select("photo_id", F.explode(text("description")).alias("token")), said, ["photo_id"], False))
    return begun.select("query_id", "photo_id")


def _named(persons: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked's columns, photo_id): photos with a person whose name holds asked.name. Names are met once each."""
    who = persons.select("photo_id", F.lower("name").alias("_name"))
    return asked.join(who.select("_name").distinct(), F.col("_name").contains(F.col("name")) & (F.col("name") != "")).drop("name").join(who, "_name").drop("_name").distinct()


def search(
    queries: DataFrame, photos: DataFrame, tags: DataFrame, synonyms: DataFrame, persons: DataFrame | None = None, limit: int = 500, as_of: Column | None = None,
    dictionary: DataFrame | None = None, contexts: DataFrame | None = None,
) -> DataFrame:
    """(query_id, photo_id, score, rank) of queries(query_id, text).

    photos: summaries with tags, tag_count, folder, path, description, media_type, favorite, rating, private, created_at,
    date_taken. persons(photo_id, name), dictionary(source, target, context), contexts(word, tags; default CONTEXTS).

    A query goes one of these ways. A text with other than ASCII letters that is a tag: its photos, by file name, as they
    are. Fields and excluded terms only: all photos. Other such texts: photos with the dictionary's words, the text's own
    or their synonyms. English words: each with its synonyms is a group that needs one of its words (all of them in one
    tag, if a photo has such a tag); photos must be in every group that has photos; where no photo is, one of the plain
    words is enough; stop words alone make no group; a single word without synonyms is a start. Then photos join whose
    persons' names hold the text, or whose path or description has one of the words. Two photos or more with a tag of the
    words' contexts put out those without; `person:` fields keep photos with such persons; a query of one group that finds
    nothing takes tags near in spelling. Last, fields and excluded terms drop photos, and the rest is ordered by
    relevance, then context, then id. Null and empty texts find nothing.
    """
    # read in every branch below: computed once, else each would sum up the tags of all photos anew
    shown = cut(photos.filter(~F.col("private")).select(*[c for c in photos.columns if c in SUMMARY]))
    ids = shown.select("photo_id")
    every = cut(_routes(queries, as_of))  # as many rows as queries, read in every branch
    exact = cut(search_tag_exact(tags, every.filter("foreign and not bare").select("query_id", F.col("said").alias("text"))).join(ids, "photo_id", "left_semi"))
    parsed = cut(every.join(exact.select("query_id").distinct(), "query_id", "left_anti"))
    groups = cut(_groups(parsed.filter("not bare"), synonyms, dictionary))

    hits = _group_hits(groups, tags, ids)
    counted = hits.filter(F.col("group_id") != ALL_WORDS)
    filled = counted.groupBy("query_id").agg(F.countDistinct("group_id").alias("of"))
    common = cut(counted.groupBy("query_id", "photo_id").agg(F.count(F.lit(1)).alias("c")).join(filled, "query_id").filter("c = of").select("query_id", "photo_id"))
    loose = hits.filter(F.col("group_id") == ALL_WORDS).join(filled, "query_id", "left_semi").join(common.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "photo_id")
    found = common.unionByName(loose).unionByName(_text_hits(parsed, shown, groups).join(ids, "photo_id", "left_semi"))
    if persons is not None:
        found = found.unionByName(_named(persons, parsed.filter("not bare").select("query_id", F.col("said").alias("name"))))
    found = found.distinct()

    word = F.explode(F.split("said", r"\s+")).alias("w")
    told = contexts if contexts is not None else queries.sparkSession.createDataFrame([(w, list(t)) for w, t in CONTEXTS.items()], "word string, tags array<string>")
    told = parsed.join(told.select("word", F.explode("tags").alias("t")), F.col("said").contains(F.col("word"))).select("query_id", "t")  # queries x the list of contexts
    if dictionary is not None:
        meant = dictionary.filter("context is not null").select(fold(F.col("source")).alias("w"), F.explode("context").alias("t"))
        told = told.unionByName(parsed.select("query_id", word).withColumn("w", fold(F.col("w"))).join(meant, "w").select("query_id", "t"))
    told = told.groupBy("query_id").agg(F.collect_set(F.lower("t")).alias("context"))
    overlap = F.size(F.filter("tags", lambda t: F.exists("context", lambda c: F.lower(t).contains(c))))
    rows = found.join(told, "query_id", "left").join(shown.select("photo_id", "tags"), "photo_id")
    rows = cut(rows.select("query_id", "photo_id", F.when(F.col("context").isNull(), 0).otherwise(overlap).alias("context")))
    enough = rows.groupBy("query_id").agg((F.count_if(F.col("context") > 0) >= 2).alias("enough"))
    rows = rows.join(enough, "query_id").filter(~F.col("enough") | (F.col("context") > 0)).drop("enough")

    details = parsed.select("query_id", "must", "phrases", "must_not", "fields")
    bare = parsed.filter("bare").select("query_id")
    if not bare.isEmpty():  # each of these asks every photo
        rows = rows.unionByName(shown.select("photo_id").crossJoin(F.broadcast(bare)).select("query_id", "photo_id", F.lit(0).alias("context")))
    if persons is not None:
        asked = parsed.select("query_id", F.posexplode("fields").alias("n", "f")).filter("f.field = 'person'")
        if not asked.isEmpty():
            ok = _named(persons, asked.select("query_id", "n", F.explode(F.split(F.lower("f.value"), r"\s*,\s*")).alias("name")))
            of = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("of"))
            ok = ok.groupBy("query_id", "photo_id").agg(F.countDistinct("n").alias("c")).join(of, "query_id").filter("c = of")
            rows = rows.join(of, "query_id", "left_anti").unionByName(rows.join(ok, ["query_id", "photo_id"], "left_semi"))
    rows = cut(rows)
    single = parsed.filter((F.size("words") == 1) & ~F.col("bare")).join(rows.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.element_at(F.element_at("words", 1), 1).alias("term"))
    if not single.isEmpty():
        near = fuzzy_tags(tags, single).select("query_id", F.lit(0).alias("group_id"), F.explode(tokens(F.col("tag"))).alias("word"), F.lit("multi").alias("kind")).distinct()
        rows = rows.unionByName(_group_hits(near, tags, ids).select("query_id", "photo_id", F.lit(0).alias("context")))

    rows = shown.join(rows, "photo_id").join(details, "query_id").filter(F.forall("fields", row_condition))
    rows = exclude_terms(rows).withColumn("score", relevance())
    first = Window.partitionBy("query_id")
    rows = rows.withColumn("rank", F.row_number().over(first.orderBy(F.desc("score"), F.desc("context"), "photo_id"))).filter(F.col("rank") <= limit)
    name = F.regexp_extract("path", r"[^/\\]*$", 0)
    as_is = shown.join(exact, "photo_id").withColumn("rank", F.row_number().over(first.orderBy(name, "photo_id"))).filter(F.col("rank") <= limit)
    return rows.select("query_id", "photo_id", "score", "rank").unionByName(as_is.select("query_id", "photo_id", F.lit(0.0).cast(rows.schema["score"].dataType).alias("score"), "rank"))
