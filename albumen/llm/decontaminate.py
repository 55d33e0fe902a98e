"""Benchmark decontamination on templates: DataFrame functions only.

Words become templates: numbers, units and names are typed placeholders, other words are stripped of marks and put in
lower case. Words of marks alone are no words. Windows of template words of a document are hash-joined with those of the
benchmark, and so are windows of the same words without placeholders, which meet copies in another letter case (names
are told by their capitals). A window with few plain words is only joined as it stands: a table of numbers is like every
other one. Hits are summed by offset diagonal, split into runs at gaps, and a long enough run is checked for slot
consistency: each value in a slot of the item must always stand for one value in the document, and the other way round; a
run with slots that clash is cut down to its longest stretch without them. So a question with other numbers or names is
caught, and a chance likeness of placeholders is not. Words that agree as they stand, but for case and outer marks, need
no such check. A document's window is only made where all its pairs of neighbouring words are pairs of the benchmark, by
a table of hash slots; this skips windows that could not be joined. Items too short for a run are looked for word by word, by one hash of the whole item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import spare, store

#: Template words in a window.
WINDOW = 8
#: Words that a run must cover, or the whole item where it is shorter.
LEAST_WORDS = 12
#: Plain words that a window of templates must hold to be joined with its placeholders. Half of an accepted run's words
#: are plain, and every 12 words of which 6 are plain hold a window of 8 with 3 plain ones.
LEAST_PLAIN = 3
#: Rows of benchmark windows (a hash and two numbers each) and ids of candidates up to which that side is broadcast.
BROADCAST_ROWS = 1 << 18
#: Hash slots of pairs of neighbouring words that the benchmark has; where all are taken, nothing is skipped.
PAIR_SLOTS = 1 << 16
#: Bytes of benchmark words up to which they are broadcast.
BROADCAST_BYTES = 16 << 20

# fixed values
UNITS = ("%", "mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "mile", "miles", "inch", "inches", "feet", "foot", "pound", "pounds", "dollar", "dollars", "euro", "euros", "cent", "cents", "$", "€", "£", "°c", "°f", "mph", "kmh", "watts", "volts")

#: What stands for a number, a unit or a name in a template.
PLACEHOLDERS = ("<num>", "<unit>", "<name>")


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def bare(word: Column) -> Column:
    """The word in lower case without outer marks."""
    return F.lower(F.regexp_replace(word, "^[^\\p{L}\\p{N}%$€£°]+|[^\\p{L}\\p{N}%$€£°]+$", ""))


def _pairs(raw: Column) -> Column:
    """(low, t) of each of an array of words: in lower case without marks, and as template."""

    def one(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(raw, i - 1)).otherwise(F.lit("."))
        low = bare(w)
        other = (
            F.when(w.rlike("[0-9]"), "<num>")
            .when(low.isin(*UNITS), "<unit>")
            .when(w.rlike("^\\P{L}*\\p{Lu}\\p{Ll}+\\P{L}*$") & ~before.rlike("[.!?:]\\P{L}*$"), "<name>")
            .otherwise(low)
        )
        pair = lambda low, t: F.struct(low.alias("low"), t.alias("t"))
        return F.when(w.rlike(r"^\p{Ll}+$"), pair(w, F.when(w.isin(*UNITS), "<unit>").otherwise(w))).otherwise(pair(low, other))  # most words: nothing to strip

    return F.transform(raw, one)


def _tokens(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, and tokens, an array of (low, t) of a text's words: in lower case without marks, and as templates; words of marks alone go."""
    raw = df.select(*keys, words(F.col(text)).alias("w"))
    return raw.select(*keys, F.filter(_pairs(F.col("w")), lambda x: x["low"] != "").alias("tokens"))


def _starts(n: Column, k: int) -> Column:
    return F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))


def _hashed(df: DataFrame, *keys: str) -> DataFrame:
    """keys, and for each word of `tokens` its hashes as word and as template, and 1 where it is plain."""
    hashes = F.transform("tokens", lambda x: F.struct(F.xxhash64(x["low"]).alias("low"), F.xxhash64(x["t"]).alias("t"), x["t"].isin(*PLACEHOLDERS).alias("held")))
    return df.select(*keys, hashes.alias("h")).select(*keys, F.col("h.low").alias("low"), F.col("h.t").alias("t"), F.col("h.held").alias("held"))


def _pair_slots(hashes: str, of=lambda slot: slot) -> Column:
    """of(hash slot) of each word and the next one; the last has no next one."""
    after = F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.zip_with(hashes, after, lambda x, y: of(F.xxhash64(x, y).bitwiseAND(F.lit(PAIR_SLOTS - 1)).cast("int")))


def _seen_pairs(items: DataFrame) -> bytearray:
    """A byte for each slot, 1 where a pair of the items, as words or as templates, falls in it. items: of _hashed."""
    pairs = F.concat(*[F.slice(_pair_slots(c), F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))) for c in ("low", "t")])
    seen = bytearray(PAIR_SLOTS)
    for row in items.select(F.explode(pairs).alias("slot")).distinct().toLocalIterator():  # PAIR_SLOTS rows at most
        seen[row.slot] = 1
    return seen


def _with_met(h: DataFrame, seen: bytearray) -> DataFrame:
    """h of _hashed with low_met and t_met: whether a word and the next one may be a pair of the benchmark."""
    met = lambda c: _pair_slots(c, lambda slot: F.substring(F.lit(seen), slot + 1, F.lit(1)) == F.lit(bytearray(b"\1"))).alias(f"{c}_met")
    return h.select("*", met("low"), met("t"))


def _all_met(c: str, i: Column, k: int) -> Column:
    """Whether the k words from the i-th on may stand in the benchmark, by their pairs."""
    every = F.lit(True)
    for j in (*range(0, k - 1, 2), *range(1, k - 1, 2)):
        pair = F.get(f"{c}_met", i + (j - 1))
        every = every & pair if j else pair
    return every


def _windows(met: bool = False) -> Column:
    """An array of (pos, win) of the columns of _hashed: each window's words, and its templates if enough are plain. met:
    without those that stand nowhere in the benchmark, by the columns of _with_met."""

    every = _starts(F.size("low"), WINDOW)
    pick = lambda c: F.filter(every, lambda i: _all_met(c, i, WINDOW)) if met else every
    starts = pick("low")
    free = lambda i: F.size(F.array_remove(F.slice("held", i, F.lit(WINDOW)), True))
    mixed = F.filter(pick("t"), lambda i: free(i).between(LEAST_PLAIN, WINDOW - 1))
    prints = lambda words, at: F.transform(at, lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.slice(words, i, F.lit(WINDOW))).alias("win")))
    return F.concat(prints("low", starts), prints("t", mixed))


def _whole(k: int, i: Column) -> Column:
    """The hash of the k words from the i-th on, as a short item's."""
    return F.xxhash64(F.slice("low", i, F.lit(k)), F.lit(k))


_SHORT = -1  # the position of a short item's hash


def _short(k: int) -> Column:
    """An array of (pos, win) of the runs of k words whose pairs may be of the benchmark, to meet items of k words."""
    starts = F.filter(_starts(F.size("low"), k), lambda i: _all_met("low", i, k))
    return F.transform(starts, lambda i: F.struct(F.lit(_SHORT).alias("pos"), _whole(k, i).alias("win")))


def _marks(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(item_id, ipos, win) of the items' windows, and of whole items of the sizes given."""
    h = _hashed(items, "item_id")
    marks = h.select("item_id", F.explode(_windows()).alias("x")).select("item_id", F.col("x.pos").alias("ipos"), "x.win")
    for k in sizes:
        marks = marks.unionByName(h.filter(F.size("low") == k).select("item_id", F.lit(_SHORT).alias("ipos"), _whole(k, F.lit(1)).alias("win")))
    return marks


_DIAGONAL = ["doc_id", "tk", "item_id", "diag"]


def _runs(hits: DataFrame) -> DataFrame:
    """(doc_id, tk, item_id, diag, first, last) of hits (doc_id, tk, item_id, ipos, diag): each run of windows whose
    words leave no gap, and the whole span of a diagonal of several runs that cover 75 % of its words."""
    line = Window.partitionBy(*_DIAGONAL).orderBy("ipos")
    apart = (F.col("ipos") - F.lag("ipos").over(line) > WINDOW).cast("int")
    rows = hits.distinct().withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("run", F.sum("apart").over(line))
    runs = rows.groupBy(*_DIAGONAL, "run").agg(F.min("ipos").alias("first"), F.max("ipos").alias("last"))
    whole = runs.groupBy(*_DIAGONAL).agg(F.collect_list(F.struct("first", "last")).alias("parts"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.col("last") - F.col("first") + WINDOW).alias("n"))
    bridged = (F.size("parts") > 1) & (F.col("n") * 4 >= (F.col("last") - F.col("first") + WINDOW) * 3)
    parts = F.when(bridged, F.concat("parts", F.array(F.struct("first", "last")))).otherwise(F.col("parts"))
    return whole.select(*_DIAGONAL, F.explode(parts).alias("p")).select(*_DIAGONAL, "p.first", "p.last")


def _spoken(docs: DataFrame, runs: DataFrame, few: bool) -> DataFrame:
    """The runs with doc_words, the (low, t) of the document's words along each. docs: doc_id, tk, text.

    A document gives the places that its runs need once each, however many runs there are, and they meet the runs by place.
    """
    span = F.col("last") - F.col("first") + WINDOW
    places = F.sequence(F.col("first") + F.col("diag"), F.col("first") + F.col("diag") + span - 1)
    need = store(runs.groupBy(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).agg(F.array_distinct(F.flatten(F.collect_set(places))).alias("need")), "places")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))
    ids = need.select("_id", "_tk")
    there = docs.join(F.broadcast(ids) if few else ids, same, "left_semi").join(need, same)
    there = _tokens(there, "text", "_id", "_tk", "need")
    there = there.select("_id", "_tk", F.explode(F.transform("need", lambda p: F.struct(p.alias("at"), F.get("tokens", p).alias("word")))).alias("x")).select("_id", "_tk", "x.at", "x.word")
    steps = runs.withColumn("ipos", F.explode(F.sequence("first", F.col("first") + span - 1)))
    said = steps.join(there, same & (F.col("ipos") + F.col("diag") == F.col("at")))
    said = said.groupBy(*_DIAGONAL, "first", "last", "size").agg(F.sort_array(F.collect_set(F.struct("ipos", "word"))).alias("said"))
    return said.withColumn("doc_words", F.col("said.word")).drop("said")


def _longest(flags: Column, counts: Column) -> Column:
    """struct(n, plain) of the longest stretch of true flags, and how many of its counts are true."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("plain"), F.lit(0).alias("best"), F.lit(0).alias("best_plain"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(x["flag"], s["n"] + 1).otherwise(0)
        plain = F.when(x["flag"], s["plain"] + x["count"].cast("int")).otherwise(0)
        more = n > s["best"]
        return F.struct(n.alias("n"), plain.alias("plain"), F.when(more, n).otherwise(s["best"]).alias("best"), F.when(more, plain).otherwise(s["best_plain"]).alias("best_plain"))

    both = F.zip_with(flags, counts, lambda f, c: F.struct(F.coalesce(f, F.lit(False)).alias("flag"), F.coalesce(c, F.lit(False)).alias("count")))
    end = F.aggregate(both, zero, step)
    return F.struct(end["best"].alias("n"), end["best_plain"].alias("plain"))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(doc_id, tk, item_id, n_words, size, kind, first) of every accepted run; tk, the text's hash, tells texts under one id apart."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    b = store(_tokens(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")), "text", "item_id").filter(F.size("tokens") > 0), "items")
    sizes = sorted(r.n for r in b.select(F.size("tokens").alias("n")).filter(F.col("n") <= LEAST_WORDS).distinct().collect())  # LEAST_WORDS rows at most
    marks = store(_marks(b, sizes), "item-windows")
    small = marks.count() <= BROADCAST_ROWS
    h = _with_met(_hashed(_tokens(d, "text", "doc_id", "tk"), "doc_id", "tk"), _seen_pairs(_hashed(b, "item_id")))
    short = [_short(k) for k in sizes]
    prints = F.concat(_windows(True), F.array_distinct(F.concat(*short))) if short else _windows(True)
    windows = h.select("doc_id", "tk", F.explode(prints).alias("x")).select("doc_id", "tk", "x.pos", "x.win")
    hits = windows.join(F.broadcast(marks) if small else marks, "win").select("doc_id", "tk", "item_id", "ipos", (F.col("pos") - F.col("ipos")).alias("diag"))
    hits = store(hits, "hits")
    lengths = b.select("item_id", F.size("tokens").alias("size"))
    lengths = F.broadcast(lengths) if small else lengths
    whole = hits.filter(F.col("ipos") == _SHORT).select("doc_id", "tk", "item_id").distinct().join(lengths, "item_id")
    whole = whole.select("doc_id", "tk", "item_id", F.col("size").alias("n_words"), "size", F.lit("verbatim").alias("kind"), F.lit(0).alias("first"))

    span = F.col("last") - F.col("first") + WINDOW
    enough = F.least(F.lit(LEAST_WORDS), F.col("size"))
    runs = store(_runs(hits.filter(F.col("ipos") >= 0)).join(lengths, "item_id").filter(span >= enough).distinct(), "runs")
    few = runs.select("doc_id", "tk").distinct().count() <= BROADCAST_ROWS
    bytes_ = b.agg(F.coalesce(F.sum(F.aggregate("tokens", F.lit(0), lambda n, x: n + F.octet_length(x["low"]) + F.octet_length(x["t"]) + 32)), F.lit(0)).alias("n")).first().n
    items = b.select("item_id", "tokens")
    held = _spoken(d, runs, few).join(F.broadcast(items) if bytes_ <= BROADCAST_BYTES else items, "item_id")
    along = F.slice("tokens", F.col("first") + 1, span)
    held = held.select("doc_id", "tk", "item_id", "size", "first", span.alias("n_words"), "doc_words", along.alias("item_words"))
    held = held.select("doc_id", "tk", "item_id", "size", "first", "n_words", F.col("doc_words.low").alias("dw"), F.col("doc_words.t").alias("dt"), F.col("item_words.low").alias("iw"), F.col("item_words.t").alias("it"))
    typed = F.transform(F.arrays_zip("dw", "iw", "dt", "it"), lambda p: F.when((p["it"] == p["dt"]) & p["it"].isin(*PLACEHOLDERS), F.struct(p["it"].alias("kind"), p["iw"].alias("i"), p["dw"].alias("d"))))
    held = held.withColumn("typed", typed).withColumn("slots", F.array_distinct(F.array_compact("typed")))
    rival = lambda s: F.exists("slots", lambda o: (o["kind"] == s["kind"]) & ((o["i"] == s["i"]) != (o["d"] == s["d"])))
    held = held.withColumn("clash", F.filter("slots", rival))
    agree = F.transform("typed", lambda s: s.isNull() | ~F.array_contains("clash", s))
    plain = F.transform("it", lambda t: ~t.isin(*PLACEHOLDERS))
    equal = F.zip_with("dw", "iw", lambda x, y: x == y)
    held = held.withColumn("steady", _longest(agree, plain)).withColumn("stretch", _longest(equal, plain)["n"])
    held = held.withColumn("whole", (F.col("steady.n") >= enough) & (F.col("steady.plain") * 2 >= F.col("steady.n"))).filter(F.col("whole") | (F.col("stretch") >= enough))
    held = held.withColumn("kind", F.when(~F.col("whole") | F.forall("slots", lambda s: s["i"] == s["d"]), "verbatim").otherwise("reparameterised"))
    held = held.select("doc_id", "tk", "item_id", F.when(F.col("whole"), F.greatest("steady.n", "stretch")).otherwise(F.col("stretch")).alias("n_words"), "size", "kind", "first")
    return held.unionByName(whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, coverage, kind) of each document and item that it contains.

    n_words: words of the longest accepted run, at least LEAST_WORDS or the item's length; coverage: their share of
    the item; kind: `verbatim` where all slots' values agree but for case and outer marks, else `reparameterised`. A run
    is accepted for its longest stretch without clashing slots, half of its words being no number, unit or name, or for
    its longest stretch of words that agree. Words of marks alone count nowhere. More than ten placeholders in a row part
    a run unless they agree word by word. Items shorter than a window match verbatim only; null or empty texts match
    nothing. Null ids are ids like others. Repeated documents give one row, and so do texts under one id; equal runs
    count by the earliest place. Texts of any length are taken whole. Empty tables give no rows; further columns are
    ignored, whatever their names.
    """
    held = _found(docs, benchmark, id_col, text_col, item_col, item_text)
    best = F.max_by(F.struct("n_words", "size", "kind"), F.struct("n_words", -F.col("first"), "kind")).alias("x")
    return held.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("x.n_words").cast("long").alias("n_words"), (F.col("x.n_words") / F.col("x.size")).alias("coverage"), "x.kind")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item, with the columns of docs, whatever their names.

    Rows are judged by their own text: of two texts under one id only the one that contains an item goes. Null and empty
    texts stay; repeated rows stay or go together; an empty table stays empty.
    """
    i, k = spare(docs, "_gone"), spare(docs, "_gone_text")
    gone = store(_found(docs, benchmark, "doc_id", "text", "item_id", "text").select(F.col("doc_id").alias(i), F.col("tk").alias(k)).distinct(), "leaks")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[i]) & (F.xxhash64(docs["text"]) == gone[k]), "left_anti")
