"""Removal of word windows that stand in an earlier document, with a log-structured index of window fingerprints.

Documents come in batches of ascending ids. A window of `window` words is fingerprinted by its winnowed print: the least
hash among its GRAM-word runs, so equal windows have equal prints and a text has about one print for five words. The
index holds immutable runs, bucketed and sorted by their key: prints, whole windows that were looked at, and texts. A new
batch's run is merge-joined with the older ones, and only windows whose print is met again are looked at whole: their
hashes over all words decide (the verification) and form runs of their own. When there are more than MAX_RUNS runs of a
kind, the oldest two are merged into one. The index can be kept in a folder and take more batches later.

Within a slice of documents equal prints and equal windows are summed up before any shuffle: a passage that a third of
all documents share costs one row a slice, and a run has one row for it.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, new_path, short_batches, spare, store
from .textops import gram_hashes, mix, slices, word_hashes, words_of

GRAM = 5
#: Runs of a kind; more are merged.
MAX_RUNS = 2
#: Batches that one table is dealt with in.
BATCHES = 3
#: Ids or keys up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Texts that a Python worker is sent at once.
TEXTS = 1024


def _windows(data: np.ndarray, offs: np.ndarray, window: int):
    """(document, first word, print, hash) of every window, and the words."""
    w = words_of(data, offs)
    h = word_hashes(w)
    at, whole = gram_hashes(h, w.row, window)
    if not len(at):
        return w, at, at, whole, whole
    n = len(h) - GRAM + 1
    grams = np.full(n, np.uint64((1 << 64) - 1))
    g_at, g = gram_hashes(h, w.row, GRAM)
    grams[g_at] = g
    span = window - GRAM + 1
    least = grams[: n - span + 1].copy()
    for j in range(1, span):
        np.minimum(least, grams[j : n - span + 1 + j], out=least)
    return w, w.row[at], at, least[at], whole


def _first_of(rows: np.ndarray, values: np.ndarray, ids: np.ndarray):
    """Distinct (value, id), by value then id: positions, and whether the value's least and greatest ids differ."""
    order = np.lexsort((ids[rows], values))
    r, v = ids[rows][order], values[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    r, v = r[keep], v[keep]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0)) if len(v) else np.zeros(0, np.int64)
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(v) else np.zeros(0, bool)
    return r, v, new, many, head


def _prints(docs: DataFrame, window: int) -> DataFrame:
    """(print, doc_id, hot, ask): for each slice and print a row of its least id, to be compared with other slices (ask);
    a print that has several documents already within the slice is hot, and has a row for each of them."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in slices(batch.column(1)):
                _w, row, _at, prints, _whole = _windows(data, offs, window)
                step = np.ones(len(row), bool)
                step[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])
                r, v, new, many, _ = _first_of(row[step], prints[step], ids[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(r.astype(np.int64)), pa.array(many), pa.array(new)], ["print", "doc_id", "hot", "ask"])

    return docs.mapInArrow(run, "print long, doc_id long, hot boolean, ask boolean")


def _candidate_windows(docs: DataFrame, window: int) -> DataFrame:
    """(win, doc_id, gone) from docs(doc_id, text, prints): windows with one of the prints; each slice asks once for a window, with its least id, and the slice's other documents lose it at once (gone)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in slices(batch.column(1)):
                lists = batch.column(2).slice(lo, hi - lo)
                wanted = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
                of = np.repeat(np.arange(hi - lo), np.asarray(pa.compute.list_value_length(lists).fill_null(0)))
                _w, row, _at, prints, whole = _windows(data, offs, window)
                pick = np.isin(_keyed(prints, row), _keyed(wanted, of))
                r, v, new, _many, _ = _first_of(row[pick], whole[pick], ids[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(r.astype(np.int64)), pa.array(~new)], ["win", "doc_id", "gone"])

    return docs.mapInArrow(run, "win long, doc_id long, gone boolean")


def _keyed(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(values ^ mix(row.astype(np.uint64) + np.uint64(1)))


def _kept(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """docs(doc_id, text, k, l, wins, copy) -> counts and the kept words' digest, or the kept text itself (null where nothing goes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                lists = batch.column(4).slice(lo, hi - lo)
                copies = batch.column(5).slice(lo, hi - lo).to_pylist()
                gone = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
                of = np.repeat(np.arange(hi - lo), np.asarray(pa.compute.list_value_length(lists).fill_null(0)))
                stay, first = None, None
                if len(gone):
                    w, row, at, _prints, whole = _windows(data, offs, window)
                    hit = at[np.isin(_keyed(whole, row), _keyed(gone, of))]
                    cover = np.zeros(len(w.starts) + 1, np.int64)
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + window, -1)
                    stay, first = (np.cumsum(cover)[:-1] == 0).tolist(), w.first
                touched = np.bincount(of, minlength=hi - lo) > 0
                raw = data.tobytes()
                n, lost, out = [], [], []
                for i in range(hi - lo):
                    words = raw[offs[i] : offs[i + 1]].split()
                    left = words
                    if copies[i] and len(words) >= window:
                        left = []
                    elif touched[i]:
                        left = list(compress(words, stay[first[i] : first[i + 1]]))
                    n.append(len(words))
                    lost.append(len(words) - len(left))
                    if with_text:
                        out.append(b" ".join(left).decode() if len(left) < len(words) else None)
                    else:
                        out.append(hashlib.sha256(b" ".join(left)).hexdigest())
                same = [batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(out, pa.string())], ["doc_id", "k", "l", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "k", "l", "wins", "copy").mapInArrow(run, f"doc_id {kind}, k long, l long, n_words long, n_removed long, kept string")


def _few(df: DataFrame) -> DataFrame:
    """df, to be sent to every task if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


class WindowIndex:
    """Runs of `texts` (k, first), `prints` (print, first, hot) and `windows` (win, first) of earlier documents.

    first: the least id that has the key. A print that is not hot stands in one document only as far as its run knows.
    Each run is a Parquet folder, bucketed and sorted by its key, under `path`; `open` takes up a kept index again.
    """

    KEYS = {"texts": "k", "prints": "print", "windows": "win"}
    COLUMNS = {"texts": "k long, l long, first long", "prints": "print long, first long, hot boolean", "windows": "win long, first long"}

    def __init__(self, spark, path: str | None = None, window: int = 13, buckets: int | None = None):
        self.spark, self.path, self.window = spark, path or new_path(spark, "index"), window
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: dict[str, list[str]] = {kind: [] for kind in self.KEYS}
        self.compactions = 0

    @classmethod
    def open(cls, spark, path: str) -> WindowIndex:
        """The index that `save` left in path."""
        rows = spark.read.schema("kind string, name string, at int, buckets int, window int").json(f"{path}/manifest").orderBy("at").collect()  # a row for each run
        index = cls(spark, path, rows[0].window, rows[0].buckets)
        for r in rows:
            if r.kind in cls.KEYS:
                key, table = cls.KEYS[r.kind], f"albumen_{r.name}"
                spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cls.COLUMNS[r.kind]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {r.buckets} BUCKETS LOCATION '{path}/{r.name}'")
                index.runs[r.kind].append(r.name)
        return index

    def save(self) -> str:
        """Writes down which runs there are; returns the folder."""
        rows = [("", "", -1, self.buckets, self.window)] + [(kind, name, i, self.buckets, self.window) for kind, names in self.runs.items() for i, name in enumerate(names)]
        self.spark.createDataFrame(rows, "kind string, name string, at int, buckets int, window int").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")
        return self.path

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"albumen_{name}")

    def _write(self, kind: str, rows: DataFrame) -> str:
        key, name = self.KEYS[kind], f"run_{uuid.uuid4().hex}"
        if kind == "texts":  # grouped by two hashes: dealt by its key here, so that a task writes one bucket and not all
            rows = rows.repartition(self.buckets, key)
        rows.write.option("path", f"{self.path}/{name}").option("parquet.writer.version", "v2").bucketBy(self.buckets, key).sortBy(key).saveAsTable(f"albumen_{name}")
        return name

    def older(self, kind: str) -> list[DataFrame]:
        return [self._table(name) for name in self.runs[kind]]

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS albumen_{name}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(conf).delete(where, True)

    def compact(self) -> None:
        """Merges the two oldest runs of each kind, bucket by bucket, until there are MAX_RUNS."""
        for kind, names in self.runs.items():
            while len(names) > MAX_RUNS:
                keys = ["k", "l"] if kind == "texts" else [self.KEYS[kind]]
                a, b = (self._table(n) for n in names[:2])
                both = a.alias("a").join(b.alias("b"), keys, "full")
                cols = [*keys, F.least("a.first", "b.first").alias("first")]
                if kind == "prints":  # two runs that have a print have two documents of it
                    cols.append((F.coalesce("a.hot", F.lit(False)) | F.coalesce("b.hot", F.lit(False)) | (F.col("a.first").isNotNull() & F.col("b.first").isNotNull())).alias("hot"))
                gone, names[:2] = names[:2], [self._write(kind, both.select(*cols))]
                self.compactions += 1
                for name in gone:
                    self._drop(name)

    def close(self) -> None:
        """Deletes all runs."""
        for names in self.runs.values():
            while names:
                self._drop(names.pop())

    def add(self, batch: DataFrame, older: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Takes in a batch(doc_id, text, k, l) whose ids are above all earlier ones; older has the documents of earlier batches.

        Returns (doc_id, win) of the batch's windows that start in a smaller id too, and (doc_id, k, l) of its rows whose
        whole text is that of a smaller id. Of the older texts, those are read whose print is met for the first time.
        """
        texts = store(batch.groupBy("k", "l").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "texts")
        known = texts
        for old in self.older("texts"):
            known = known.join(old.select("k", "l", F.col("first").alias("_old")), ["k", "l"], "left").withColumn("first", F.least("first", "_old")).drop("_old")
        known = store(known.filter("first < last"), "firsts")
        rows = store(batch.select("doc_id", "k", "l"), "keys")  # read back, so that a text with very many copies can be split
        copies = store(rows.join(known, ["k", "l"]).filter("doc_id > first").select("doc_id", "k", "l").distinct(), "copies")
        self.runs["texts"].append(self._write("texts", texts.select("k", "l", "first")))
        alone = batch.join(_few(copies), ["doc_id", "k", "l"], "left_anti").select("doc_id", "text")
        discard(texts, known, rows)

        raw = store(_prints(alone, self.window), "prints")
        every = raw.filter("ask").groupBy("print").agg(F.min("doc_id").alias("first"), (F.max("hot") | (F.min("doc_id") < F.max("doc_id"))).alias("hot"))
        name = self._write("prints", every)
        run, olds = self._table(name), self.older("prints")
        wanted = run.filter("hot").select("print")
        first_time = None
        for old in olds:  # merge joins, bucket by bucket
            met = run.filter("not hot").join(old.select("print"), "print", "left_semi").select("print")
            wanted = wanted.unionByName(met)
            back = old.filter("not hot").join(run.select("print"), "print", "left_semi").select(F.col("first").alias("doc_id"), "print")
            first_time = back if first_time is None else first_time.unionByName(back)
        self.runs["prints"].append(name)
        wanted = store(wanted.distinct(), "wanted")
        lists = raw.filter("not ask").select("doc_id", "print").unionByName(raw.filter("ask").join(_few(wanted), "print", "left_semi").select("doc_id", "print"))
        lists = store(lists.groupBy("doc_id").agg(F.collect_set("print").alias("prints")), "lists")
        posted = _candidate_windows(_picked(alone, lists).select("doc_id", "text", "prints"), self.window)
        back = None
        if first_time is not None:
            back = store(first_time.groupBy("doc_id").agg(F.collect_set("print").alias("prints")), "back")
            posted = posted.withColumn("new", F.lit(True)).unionByName(_candidate_windows(_picked(older.select("doc_id", "text"), back).select("doc_id", "text", "prints"), self.window).withColumn("new", F.lit(False)))
        else:
            posted = posted.withColumn("new", F.lit(True))
        posted = store(posted, "posted")
        discard(raw, wanted, lists, back)

        firsts = posted.groupBy("win").agg(F.min("doc_id").alias("first"))
        name = self._write("windows", firsts)
        least = self._table(name)
        for old in self.older("windows"):
            least = least.join(old.select("win", F.col("first").alias("_old")), "win", "left").withColumn("first", F.least("first", "_old")).drop("_old")
        self.runs["windows"].append(name)
        least = store(least, "least")
        # both sides are read back, so that a window of very many slices can be split
        asks = posted.filter("new and not gone").select("win", "doc_id")
        late = asks.join(least, "win").filter("first < doc_id").select("doc_id", "win")
        out = store(posted.filter("new and gone").select("doc_id", "win").unionByName(late), "gone")
        discard(posted, least)
        self.compact()
        return out, copies


def _picked(docs: DataFrame, by: DataFrame) -> DataFrame:
    """docs joined with by(doc_id, ...) of unique ids, reading texts of those ids only."""
    ids = by.select("doc_id")
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(by, "doc_id")


def _keys(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with two hashes of the text, k and l."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(7), "text").alias("l"))


def _removals(docs: DataFrame, window: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, win) of windows to remove, and (doc_id, k, l) of whole copies of a smaller id's text."""
    spark = docs.sparkSession
    some = docs.filter("doc_id is not null and text is not null")
    cuts = some.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 1000)).first()[0] or []
    cuts = sorted(set(cuts))[: batches - 1]
    index, gone, copies = WindowIndex(spark, window=window), None, None
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            batch = some if low is None else some.filter(F.col("doc_id") > low)
            batch = batch if high is None else batch.filter(F.col("doc_id") <= high)
            older = some.filter(F.lit(False) if low is None else F.col("doc_id") <= low)
            more, same = index.add(batch, older)
            gone = more if gone is None else gone.unionByName(more)
            copies = same if copies is None else copies.unionByName(same)
    finally:
        index.close()
    return gone, copies


def _marked(docs: DataFrame, window: int, batches: int, with_text: bool) -> DataFrame:
    docs = _keys(docs)
    with short_batches(docs.sparkSession, TEXTS):
        gone, copies = _removals(docs, window, batches)
    return marked(docs, gone, copies, window, with_text)


def marked(docs: DataFrame, gone: DataFrame, copies: DataFrame, window: int, with_text: bool) -> DataFrame:
    """docs(doc_id, text, k, l) after what WindowIndex.add found: (doc_id, k, l, n_words, n_removed, kept)."""
    per = store(gone.groupBy("doc_id").agg(F.collect_set("win").alias("wins")), "marks")
    ids = _few(store(per.select("doc_id").unionByName(copies.select("doc_id")).distinct(), "touched"))
    hit = docs.join(ids, "doc_id", "left_semi").join(per, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "k", "l"], "left")
    none = F.array().cast("array<bigint>")
    hit = hit.select("doc_id", "text", "k", "l", F.coalesce("wins", none).alias("wins"), F.coalesce("copy", F.lit(False)).alias("copy"))
    rest = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", "k", "l", none.alias("wins"), F.lit(False).alias("copy"))
    return _kept(hit.unionByName(rest), window, with_text)


def removal_digest(docs: DataFrame, window: int = 13, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Words are runs without ASCII white space, unchanged. A word goes when a window of `window` words that covers it also
    starts in a document with a smaller id; windows are judged on the input. Null text: no words. Fewer words than a
    window, blank text, ties and repeats under one id: nothing goes on their account; different texts under one id are
    judged each. Rows with a null id are left whole and remove nothing. Repeated rows give a row each. Texts of any
    length are handled whole. An empty table gives no rows; further columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _marked(docs, window, batches, False).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = 13, batches: int = BATCHES) -> DataFrame:
    """docs with the text of touched rows cut down to the kept words, joined by one space; other rows unchanged.

    n_chars, where there is such a column, follows the text. A row that loses all its words goes. Nulls, ties and repeats
    are as in removal_digest; an empty table stays empty; further columns are kept, whatever their names.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _marked(slim, window, batches, True).filter("n_removed > 0").dropDuplicates(["doc_id", "k", "l"])
    i, k, l, kept = (spare(docs, x) for x in ("_id", "_k", "_l", "_kept"))
    with short_batches(docs.sparkSession, TEXTS):
        cut = store(found.select(F.col("doc_id").alias(i), F.col("k").alias(k), F.col("l").alias(l), F.col("kept").alias(kept)), "cut")
    here = docs["text"]
    out = docs.join(cut, (docs["doc_id"] == cut[i]) & (F.xxhash64(here) == cut[k]) & (F.xxhash64(F.lit(7), here) == cut[l]), "left")
    touched = F.col(i).isNotNull()
    text = F.when(touched, F.col(kept)).otherwise(here)
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"]).alias("n_chars")
    return out.filter(F.col(i).isNull() | (F.col(kept) != "")).select(*[new.get(c, docs[c]) for c in docs.columns])
