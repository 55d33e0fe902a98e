"""Phrase collocations of each language: best-first branch-and-bound growth of phrases.

Phrases grow to the right: words to pairs, pairs to triples. What a prefix is counted to bounds every score that can grow
from it: with a <= f(prefix), and the last part at least as frequent as the phrase, no triple that starts with the pair
`x y` scores above f(x y) / f(x). So triples are grown from the pairs of the best bounds first. A language is settled when
its list is full of phrases that score at least as high as every bound that is left; until then the frontier is lowered
and grown again. A pair is only known to survive when the triples on both of its sides have been counted, so the pairs
that may enter the list are grown to the left as well.

Words and grams are hashed over Arrow batches in numpy and summed up within a slice; Spark sums them by their text, so
counts are exact. What the tasks are sent is a bitmap of a fixed size, whatever the number of words or prefixes: strangers
that it lets pass are counted too, and nothing that is needed is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import short_batches, store
from .textops import gram_hashes, mix, slices, word_hashes, words_of

#: Bits of the filters that tasks are sent: 2^25 bits are 4 MB.
FILTER_BITS = 1 << 25
#: Bytes of text whose phrases are summed up together before any shuffle.
SUMMED_BYTES = 1 << 19
#: Texts that a worker is sent at once.
TEXTS = 500
#: Ranks below `top` that the first frontier takes in, as a share of `top`; each further one takes in twice as many.
MARGIN = 0.25

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_SUM = mix(np.arange(301, 557, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _joined(data: np.ndarray, starts: list[np.ndarray], ends: list[np.ndarray]) -> pa.Array:
    """The words from starts to ends with one space between, as strings."""
    n, k = len(starts[0]), len(starts)
    size = np.stack([e - s + (j < k - 1) for j, (s, e) in enumerate(zip(starts, ends, strict=True))], 1).reshape(-1)
    at = np.zeros(n * k + 1, np.int64)
    np.cumsum(size, out=at[1:])
    source = np.repeat(np.stack(starts, 1).reshape(-1) - at[:-1], size) + np.arange(at[-1])
    out = data[np.minimum(source, len(data) - 1)]
    if k > 1:
        out[at[1:].reshape(n, k)[:, :-1].reshape(-1) - 1] = 0x20
    return pa.StringArray.from_buffers(n, pa.py_buffer(at[::k].astype(np.int32)), pa.py_buffer(out))


def _tongues(names: list[str]) -> np.ndarray:
    """A random number for each language name."""
    raw = [n.encode() for n in names]
    w = words_of(np.frombuffer(b"".join(raw) or b"\0", np.uint8), np.cumsum([0, *map(len, raw)]), np.ones(256, bool))
    out = np.zeros(len(raw), np.uint64)
    out[w.row] = word_hashes(w)
    return out


def _inside(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & np.uint64(64 * len(bits) - 1)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def _count(docs: DataFrame, k: int, words: np.ndarray | None = None, heads: np.ndarray | None = None, tails: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f): how often each phrase of k words stands within the pieces of the texts; for k = 1 also, under a
    null phrase, the number of words.

    words: of pairs, only those whose words are in this filter; heads, tails: of triples, only those whose first pair is
    in the one or whose last pair is in the other.
    """
    sc = docs.sparkSession.sparkContext
    held = [None if x is None else sc.broadcast(x) for x in (words, heads, tails)]

    def run(batches):
        allowed, first, last = (x and x.value for x in held)
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            salt = _tongues(names.dictionary.to_pylist())
            codes = names.indices.to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in slices(batch.column(1), SUMMED_BYTES):
                w = words_of(data, offs, _WORD, lower=True)
                code = codes[lo:hi]
                breaks = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_BREAK[data], out=breaks[1:])
                piece = breaks[w.starts] + w.row
                h = word_hashes(w) + salt[code[w.row]]
                at, grams = gram_hashes(h, piece, k) if k > 1 else (np.arange(len(h)), mix(h))
                if allowed is not None:
                    known = _inside(allowed, mix(h))
                    keep = known[at] & known[at + 1]
                    at, grams = at[keep], grams[keep]
                if first is not None and len(at):
                    two = np.zeros(len(h), np.uint64)
                    head, pairs = gram_hashes(h, piece, 2)
                    two[head] = pairs
                    keep = _inside(first, two[at]) | _inside(last, two[at + 1])
                    at, grams = at[keep], grams[keep]
                if k == 1 and len(h):
                    total = np.bincount(code[w.row], minlength=len(salt))
                    some = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(some)), pa.nulls(len(some), pa.string()), pa.array(total[some])], ["lang", "phrase", "f"])
                if not len(at):
                    continue
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(_SUM[w.data], out=sums[1:])
                own = sums[w.ends] - sums[w.starts]  # a second, plain hash, so that one alone decides nothing
                second = sum(own[at + j] * np.uint64(2 * j + 1) for j in range(k))
                order = np.argsort(grams, kind="stable")
                g, s = grams[order], second[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
                head = np.flatnonzero(new)
                count, place = np.diff(np.append(head, len(g))), at[order[head]]
                phrase = _joined(w.data, [w.starts[place + j] for j in range(k)], [w.ends[place + j] for j in range(k)])
                lang = names.dictionary.take(pa.array(code[w.row[place]]))
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(count.astype(np.int64))], ["lang", "phrase", "f"])

    counted = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _filter(phrases: DataFrame, k: int) -> np.ndarray:
    """A bitmap of phrases(lang, phrase) of k words: FILTER_BITS bits, however many they are."""
    size = FILTER_BITS

    def run(batches):
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            salt = _tongues(names.dictionary.to_pylist())
            codes = names.indices.to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in slices(batch.column(1)):
                w = words_of(data, offs, _WORD)
                h = word_hashes(w) + salt[codes[lo:hi][w.row]]
                g = mix(h) if k == 1 else gram_hashes(h, w.row, k)[1]
                g &= np.uint64(size - 1)
                yield pa.RecordBatch.from_arrays([pa.array((g >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (g & np.uint64(63))).view(np.int64))], ["at", "bit"])

    bits = np.zeros(size // 64, np.uint64)
    cells = phrases.select("lang", "phrase").mapInArrow(run, "at int, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    bits[cells["at"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return bits


def _score(a: str, part: str, rest: str) -> Column:
    """floor(1000000 * a * a / (part * rest)), in decimals of 38 digits: exact for counts below 10^15."""
    wide = "CAST({} AS DECIMAL(15,0))".format
    return F.expr(f"(1000000 * {wide(a)} * {wide(a)}) div ({wide(part)} * {wide(rest)})")


def _triples(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, phrase, x, y, z, a, l, r, score of counts(lang, phrase, f) of three words, at the cut that scores lowest."""
    word = lambda i: F.split_part("phrase", F.lit(" "), F.lit(i))
    rows = counts.select("lang", "phrase", F.col("f").alias("a"), word(1).alias("x"), word(2).alias("y"), word(3).alias("z"))
    rows = rows.join(pairs.select("lang", "x", "y", F.col("l").alias("f1"), F.col("a").alias("f12")), ["lang", "x", "y"])
    rows = rows.join(pairs.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("f23"), F.col("r").alias("f3")), ["lang", "y", "z"])
    rows = rows.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    low = lambda one, two: F.when(F.col("s2") < F.col("s1"), F.col(two)).otherwise(F.col(one))
    return rows.select("lang", "phrase", "x", "y", "z", "a", low("f1", "f12").alias("l"), low("f23", "f3").alias("r"), low("s1", "s2").alias("score"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, covers: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first `top` phrases of two or three words, of
    docs(text, lang).

    a, l, r: occurrences of the phrase and of its two parts at the cut that scores lowest (equal scores: the first cut);
    n: of all words. score: floor(1000000 a a / (l r)). Candidates stand `least` times or more; one whose words lie in a
    longer candidate with `covers` % of its occurrences or more is left out. Order: score and a falling, phrase rising in
    UTF-8 byte order. Letters A-Z are lowered; pieces end at `.,;:!?` and at line ends, words at blanks and tabs.

    Null text is empty and gives no phrase; a null language is `und`. Repeated rows count each. A text of any length is
    counted whole, in a slice of its own. An empty table, or one without candidates, gives no rows; a language without
    candidates has none. Further columns are ignored, whatever their names.
    """
    with short_batches(docs.sparkSession, TEXTS):
        return _listed(docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")), top, least, covers)


def _listed(docs: DataFrame, top: int, least: int, covers: int) -> DataFrame:
    single = store(_count(docs, 1).filter(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    total = single.filter("phrase is null").select("lang", F.col("f").alias("n"))
    of = lambda word, name: single.filter("phrase is not null").select("lang", F.col("phrase").alias(word), F.col("f").alias(name))
    pairs = _count(docs, 2, words=_filter(of("phrase", "f"), 1)).filter(F.col("f") >= least)
    pairs = pairs.select("lang", "phrase", F.col("f").alias("a"), F.split_part("phrase", F.lit(" "), F.lit(1)).alias("x"), F.split_part("phrase", F.lit(" "), F.lit(2)).alias("y"))
    pairs = pairs.join(of("x", "l"), ["lang", "x"]).join(of("y", "r"), ["lang", "y"])
    pairs = store(pairs.withColumn("score", _score("a", "l", "r")).withColumn("bound", F.expr("(a * 1000000) div l")), "pairs")

    open_, reach, grown, lists = total.select("lang", F.lit(None).cast("long").alias("was")), int(top * (1 + MARGIN)), None, []
    while True:
        # the score down to which all phrases are to be known: that of the `reach`-th pair, or 0 where there are fewer
        best = pairs.join(open_, "lang").withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"))))
        floor = best.filter(F.col("at") <= reach).groupBy("lang").agg(F.when(F.max("at") == reach, F.min("score")).otherwise(0).alias("floor"), F.first("was").alias("was"))
        floor = store(floor, "floor")
        front = pairs.join(floor, "lang")
        fresh = lambda c: (F.col(c) >= F.col("floor")) & (F.col("was").isNull() | (F.col(c) < F.col("was")))
        heads, tails = _filter(front.filter(fresh("bound")), 2), _filter(front.filter(fresh("score")), 2)
        counts = _count(docs.join(floor.select("lang"), "lang", "left_semi"), 3, heads=heads, tails=tails).filter(F.col("f") >= least)
        triples = _triples(counts, pairs)
        grown = store(triples if grown is None else triples.unionByName(grown).distinct(), "triples")

        # a pair that is good enough for the list has had its triples on both sides counted
        ends = grown.select("lang", "x", "y", "a").unionByName(grown.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "a")).groupBy("lang", "x", "y").agg(F.max("a").alias("most"))
        alive = front.filter("score >= floor").join(ends, ["lang", "x", "y"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < covers * F.col("a")))
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        known = alive.select(*columns, "floor").unionByName(grown.join(floor, "lang").filter("score >= floor").select(*columns, "floor"))
        known = store(known, "known")
        full = known.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
        state = store(floor.join(full, "lang", "left").select("lang", "floor", ((F.coalesce("c", F.lit(0)) >= top) | (F.col("floor") == 0)).alias("settled")), "state")
        lists.append(known.join(state.filter("settled"), "lang", "left_semi").select(*columns))
        open_ = state.filter("not settled").select("lang", F.col("floor").alias("was"))
        if open_.isEmpty():
            break
        reach *= 2
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
