"""Similarity join on word shingles by rare-first prefix filtering.

Texts with the same shingle set are one class. Each class orders its shingles from rare to frequent and posts only the
prefix that any partner must hit. Classes meet on prefix shingles, pass length, positional and suffix filters, and each
pair is verified once on the whole sets.

A shingle that one class alone posts is dead: no partner that the class meets on a later shingle can hold it. What is
left of a class after its dead shingles bounds every overlap, so outliers of a group of near copies, which are full of
words of their own, drop out before any pair is made.

A shingle that many classes post is never paired all with all: first each class meets the leaders of its shingles (a
shingle has one leader at a time, the class with the fewest dead shingles; a class has a few), and only classes that are
still in different components meet directly. Pairs inside one component could not change it, so components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, short_batches, spare, store
from .textops import mix, shingle_sets, slices, words_of

#: Counters of shingle frequency, over all documents; only the order of work depends on them.
BUCKETS = 1 << 18
#: Least rows of a shingle that are salted over several tasks.
SALT_ROWS = 1 << 14
#: Ids up to this many are broadcast to pick their texts from the table; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Leaders that a class meets in a round, those it shares most shingles with.
LEADERS = 2
#: Most rounds in which a shingle's classes meet one leader only.
LEADER_ROUNDS = 6
#: Pairs of classes on shared shingles, for each post, that are few enough to meet directly.
PAIRS_PER_POST = 4
#: Times that dead shingles are counted; shingles of classes that have dropped out could die the next time, but few do.
PRUNINGS = 1
#: Least share of a round's pairs that must link for another round with leaders.
FRUITFUL = 0.05
#: Longs of a class's bitmap, 64 buckets each.
LONGS = 32
#: Parts of the hash range whose counts bound the overlap (the suffix filter).
PARTS = 16
#: Texts that a Python worker is sent at once, and bytes of them that are hashed at once: both are held several times over.
TEXTS, HASHED_BYTES = 512, 1 << 18


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """Rows (kind 0: a=doc_id, b=set size, c=class, d=text's hash, s0..: the buckets of the hash range that its shingles
    fall in) and (kind 1: a=frequency bucket, b=count)."""
    names = ["kind", "a", "b", "c", "d", *_BITMAP]

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1), HASHED_BYTES):
                rows, grams = shingle_sets(words_of(data, offs, lower=True), k)
                n = np.bincount(rows, minlength=hi - lo)
                counts += np.bincount((grams & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                classes = _class_of(rows, grams, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(classes), batch.column(2).slice(lo, hi - lo), *_bitmaps(rows, grams, hi - lo)], names)
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(counts[at]), *[none] * (2 + LONGS)], names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("d")).mapInArrow(run, "kind int, " + ", ".join(f"{c} long" for c in names[1:]))


_BITMAP = [f"s{i}" for i in range(LONGS)]


def _bitmaps(rows: np.ndarray, grams: np.ndarray, n: int) -> list[pa.Array]:
    bits = np.zeros((n, LONGS * 64), np.uint8)
    bits[rows, ((grams >> np.uint64(20)) % np.uint64(LONGS * 64)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return [pa.array(packed[:, i].copy()) for i in range(LONGS)]


def _class_of(rows: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each row's shingle set; 0 for an empty set."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.concatenate([[0], np.cumsum(n[full])[:-1]])) + n[full].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def _prefixes(docs: DataFrame, k: int, percent: int, counts) -> DataFrame:
    """(gram, salt, class, n, pos) of each text's prefix."""

    def run(batches):
        freq = counts.value
        salt_from = 16 * int(freq.mean()) + SALT_ROWS
        for batch in batches:
            for _lo, hi, data, offs in slices(batch.column(0), HASHED_BYTES):
                rows, grams = shingle_sets(words_of(data, offs, lower=True), k)
                n = np.bincount(rows, minlength=len(offs) - 1)
                classes = _class_of(rows, grams, n)
                often = freq[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.lexsort((grams, often, rows))
                grams, often = grams[order], often[order]
                pos = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(n)])[rows]
                size = n[rows]
                keep = pos < size - (percent * size + 99) // 100 + 1
                cls, salts = classes[rows][keep], 1 + often[keep] // salt_from
                salt = np.where(salts > 1, 1 + cls.view(np.uint64) % salts.astype(np.uint64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(cls), pa.array(size[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], ["gram", "salt", "class", "n", "pos"])

    return docs.mapInArrow(run, "gram long, salt int, class long, n int, pos int")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity."""

    def run(batches):
        for batch in batches:
            a_rows, b_rows, at = batch.column(2), batch.column(3), 0
            while at < len(batch):  # as many pairs at once as fit in half a MB of text
                to, total = at, 0
                while to < len(batch) and (to == at or total < 2 * HASHED_BYTES):
                    total += len(a_rows[to].as_buffer()) + len(b_rows[to].as_buffer())
                    to += 1
                sets = []
                for column in (a_rows, b_rows):
                    part, base = column.slice(at, to - at), []
                    for lo, _hi, data, offs in slices(part, HASHED_BYTES):
                        rows, grams = shingle_sets(words_of(data, offs, lower=True), k)
                        base.append((rows + lo, grams))
                    sets.append((np.concatenate([r for r, _ in base]), np.concatenate([g for _, g in base])))
                (ra, ga), (rb, gb) = sets
                m = to - at
                na, nb = np.bincount(ra, minlength=m), np.bincount(rb, minlength=m)
                parts = [np.bincount(r * PARTS + (g >> np.uint64(60)).astype(np.int64), minlength=m * PARTS).reshape(m, PARTS) for r, g in sets]
                bound = np.minimum(*parts).sum(axis=1)  # the suffix filter: no overlap can be larger
                may = 100 * bound >= percent * (na + nb - bound)
                pick_a, pick_b = may[ra], may[rb]
                rows = np.concatenate([ra[pick_a], rb[pick_b]])
                grams = np.concatenate([ga[pick_a], gb[pick_b]])
                order = np.lexsort((grams, rows))
                rows, grams = rows[order], grams[order]
                same = (rows[1:] == rows[:-1]) & (grams[1:] == grams[:-1])
                inter = np.bincount(rows[1:][same], minlength=m)
                ok = np.flatnonzero(may & (100 * inter >= percent * (na + nb - inter)) & (inter > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, m).take(pa.array(ok)), batch.column(1).slice(at, m).take(pa.array(ok))], ["a", "b"])
                at = to

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.coalesce("text_a", F.lit("")).alias("text_a"), F.coalesce("text_b", F.lit("")).alias("text_b")).mapInArrow(run, "a long, b long")


def _live(posts: DataFrame, percent: int) -> DataFrame:
    """posts (gram, class, n, pos) that can be part of a link, with dead: the class's dead shingles before it.

    A class of n shingles, d of them dead before a shingle, overlaps a partner that it meets there in n - d at most, so
    the partner has at most (100 + percent) / percent * (n - d) - n shingles.
    """
    for _ in range(PRUNINGS):
        before = F.row_number().over(Window.partitionBy("class").orderBy("pos")) - 1
        counted = posts.select("gram", "class", "n", "pos").withColumn("dead", F.col("pos") - before)
        most = F.floor(F.lit(100 + percent) * (F.col("n") - F.col("dead")) / percent) - F.col("n")
        same = Window.partitionBy("gram")
        left = counted.withColumn("_least", F.min("n").over(same)).filter(most >= F.col("_least"))
        again = left.withColumn("_x", F.min("class").over(same)).withColumn("_y", F.max("class").over(same))
        posts, was = store(again.filter("_x <> _y").drop("_least", "_x", "_y"), "posts"), posts
        discard(was)
    return posts


def _without_echoes(posts: DataFrame) -> DataFrame:
    """posts of one shingle only among those that the same classes post, with how many there are (times).

    Such shingles, the runs of a shared passage, would bring the same pairs again and again; the last of them has most
    dead shingles before it.
    """
    signs = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(5))).alias("y"), F.sum("dead").alias("dead"))
    first = signs.groupBy("c", "x", "y").agg(F.max_by("gram", F.struct("dead", "gram")).alias("gram"), F.count(F.lit(1)).alias("times")).select("gram", "times")
    return posts.join(first, "gram")


def _may_link(percent: int):
    """Length, positional and dead-shingle filters on (a, n_a, pos_a, dead_a, b, n_b, pos_b, dead_b).

    Of what stands before the shingle that a and b meet on, only live shingles can be shared.
    """
    live = F.least(F.col("pos_a") - F.col("dead_a"), F.col("pos_b") - F.col("dead_b"))
    most = live + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    near = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    return near & (F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b")))


def _marked() -> list:
    """A class's bitmap as one array, and how many of its buckets are set.

    Spelled out column by column, the test of a pair would be a method too long for the JVM to compile.
    """
    bits = [F.col(c) for c in _BITMAP]
    return [F.array(*bits).alias("bits"), sum(map(F.bit_count, bits[1:]), F.bit_count(bits[0])).alias("set")]


def _may_overlap(percent: int):
    """The suffix filter on bitmaps: shingles in buckets that the other class leaves empty are not shared."""
    both = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, c: s + c)
    most = both + F.least(F.col("n_a") - F.col("set_a"), F.col("n_b") - F.col("set_b"))
    return F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(class, root) after new links (a, b): only what the links join together is worked on."""
    if roots is None:
        return store(connected_components(links).select(F.col("node").alias("class"), "root"), "roots")
    of = lambda x: roots.select(F.col("class").alias(x), F.col("root").alias(f"root_{x}"))
    known = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = store(known.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct(), "ends")
    after = connected_components(ends).select("node", F.col("root").alias("_new"))
    old = roots.join(after.withColumnRenamed("node", "root"), "root", "left").select("class", F.coalesce("_new", "root").alias("root"))
    fresh = after.join(roots.select(F.col("class").alias("node")), "node", "left_anti").select(F.col("node").alias("class"), F.col("_new").alias("root"))
    out = store(old.unionByName(fresh), "roots")
    discard(ends)
    return out


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, with_text_key: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of docs.

    Lower-cases A-Z; words are runs without ASCII white space; a text's set is its distinct k-word shingles, or the
    whole sequence where it has fewer words. Rows link when 100 * intersection >= percent * union; component_id is the
    smallest id reachable. Null, empty and blank texts have an empty set and link with nothing: component_id is their
    own id. A repeated id gives a row each time, by its own text. Null ids give a row with the class's component where
    they have one. Texts of any length are taken whole. An empty table gives no rows. Further columns are ignored,
    whatever their names. with_text_key adds tk, xxhash64 of the text.
    """
    with short_batches(docs.sparkSession, TEXTS):
        return _components_of(docs, id_col, text_col, k, percent, with_text_key)


def _components_of(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, with_text_key: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = store(_signatures(docs, k), "signatures")
    signed = first.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("class"), F.col("d").alias("tk"))
    counts = np.zeros(BUCKETS, np.int64)
    for row in first.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("b")).toLocalIterator():  # BUCKETS rows at most
        counts[row.a] = row.b
    counts = spark.sparkContext.broadcast(counts)

    posts = _prefixes(docs.select("text"), k, percent, counts).dropDuplicates(["gram", "salt", "class"])
    same = Window.partitionBy("gram", "salt")
    posts = posts.withColumn("least", F.min("class").over(same)).withColumn("most", F.max("class").over(same))
    posts = store(posts.filter("least <> most or salt > 0").select("gram", "class", "n", "pos"), "posts")
    every = _live(posts, percent)
    posts = store(_without_echoes(every), "lone-posts")
    discard(every)

    # a class's text is that of its first row: the id alone could name another text
    used = posts.select("class").distinct()
    members = store(signed.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "tk")).alias("at")), "classes")
    wanted = store(members.join(used, "class").select("class", F.col("at.doc_id").alias("_id"), F.col("at.tk").alias("_tk")), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.withColumn("tk", F.xxhash64("text")).join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")))
    texts = store(texts.select("class", "text").dropDuplicates(["class"]), "texts")

    seen, roots, turn, last, fruitful = None, None, 0, False, True
    while not last:
        here = posts.withColumn("root", F.col("class")) if roots is None else posts.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        if roots is not None:  # only shingles whose classes are still apart
            apart = here.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("gram")
            here = store(here.join(apart, "gram"), "apart")
        # all pairs once they are in proportion to the posts, or leaders bring little; else leaders first
        sizes = here.groupBy("gram").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum("c").alias("rows"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).first()
        last = turn >= LEADER_ROUNDS or not fruitful or (sizes.pairs or 0) <= PAIRS_PER_POST * (sizes.rows or 0)
        one = lambda x: [F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "pos", "dead", "root", *(("bits", "set") if last else ()))]]
        if last:
            bits = first.filter("kind = 0").join(here.select(F.col("class").alias("c")).distinct(), "c").groupBy(F.col("c").alias("class")).agg(*[F.first(s).alias(s) for s in _BITMAP]).select("class", *_marked())
            marked = store(here.join(bits, "class"), "marked")
            pairs = marked.select("gram", *one("b")).join(marked.select("gram", *one("a")), "gram").filter((F.col("root_a") != F.col("root_b")) & (F.col("a") < F.col("b")) & _may_link(percent) & _may_overlap(percent))
        else:
            chosen = F.min(F.struct(F.col("dead").alias("o"), F.xxhash64("class", "gram", F.lit(turn)).alias("h"), *one("a")))
            lead = store(here.groupBy("gram").agg(chosen.alias("l")).select("gram", "l.a", "l.n_a", "l.pos_a", "l.dead_a", "l.root_a"), "leaders")
            met = here.select("gram", "times", *one("b")).join(lead, "gram").filter((F.col("root_a") != F.col("root_b")) & _may_link(percent))
            if seen is not None:
                met = met.join(seen.unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
            # each class meets the leaders it shares most with
            best = Window.partitionBy("b").orderBy(F.desc("times"), F.xxhash64("a", F.lit(turn)))
            pairs = met.groupBy("b", "a").agg(F.sum("times").alias("times")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= LEADERS)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if seen is not None and last:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = store(pairs, "pairs")
        discard(marked if last else lead)
        if roots is not None:
            discard(here)
        turn += 1
        met_now = pairs.count()
        if not met_now:
            fruitful = False
            continue
        seen = pairs if seen is None else seen.unionByName(pairs)
        found = store(_verify(pairs, texts, k, percent), "links")
        linked = found.count()
        fruitful = linked >= FRUITFUL * met_now
        if linked:
            before, roots = roots, _joined(roots, found)
            discard(before)
        discard(found)

    named = members if roots is None else members.join(roots, "class", "left")
    named = named.withColumn("root", F.col("class") if roots is None else F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = store(named.join(least, "root").select("class", "component_id"), "components")
    discard(posts, texts, wanted, members, roots)
    return signed.join(ids, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("class").alias("class_id"), *(["tk"] if with_text_key else []))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest id stays, with the columns of docs.

    Rows with empty or null text stay, and so do rows with a null id unless their text links with one of an id. Of
    repeated rows with the kept id, all stay. Rows are judged by their own text. An empty table stays empty.
    """
    found = similarity_components(docs.select("doc_id", "text"), with_text_key=True, **options)
    i, k = spare(docs, "_gone"), spare(docs, "_gone_text")
    gone = store(found.filter("not doc_id <=> component_id").select(F.col("doc_id").alias(i), F.col("tk").alias(k)).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[i]) & (F.xxhash64(docs["text"]) == gone[k]), "left_anti")
