"""A token table that is kept in a folder: new rows are appended, documents that went are marked, searches read a part.

Rows lie in folders by a bucket of the token's first letter and, within one, in files of token ranges; so whole words and
starts of words meet only the folders of their letters, and in these only the row groups whose tokens can match.

    <path>/base<N>/bucket=<b>   all postings as of version N
    <path>/v<N>/bucket=<b>      postings added by version N
    <path>/gone<N>              documents whose postings before version N no longer count; looked at once v<N> is whole
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens
from .iterate import cut
from .search import FEW_WORDS, token_table

BUCKETS = 64
#: Documents marked as gone up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_GONE = 1 << 16


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(word, 1, 1)), F.lit(BUCKETS)).cast("int")


class Postings:
    """Postings (doc, field, pos, token), the rows of `search.token_table`, kept under a folder that all executors share.

    A version is written as a whole or not at all: folders without Spark's success mark are not looked at, and a version
    that is written again after a failure replaces itself. Rows without a token or a doc are left out; repeated rows stay.
    """

    def __init__(self, spark: SparkSession, path: str, doc_type: str = "long"):
        self.spark, self.path, self.doc_type = spark, path.rstrip("/"), doc_type

    def add(self, version: int, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Version `version`: the documents of gone(doc) lose their earlier postings, then rows come in. A changed document
        is in both. Versions come in order; the last may come again (a run after a failure) and is then written anew, or
        left as it is where it is compacted already."""
        held = self._held()
        last = max((n for _, n in held), default=-1)
        if version < last:
            raise ValueError(f"version {version} comes after {last}")
        if ("base", version) in held:
            return
        if gone is not None:
            gone.select(F.col("doc").cast(self.doc_type)).filter("doc is not null").distinct().write.mode("overwrite").parquet(f"{self.path}/gone{version}")
        empty = self.spark.createDataFrame([], f"doc {self.doc_type}, field string, pos int, token string")
        self._write(empty if rows is None else rows, f"v{version}")

    def read(self, words: DataFrame | None = None, prefix: bool = False) -> DataFrame:
        """The postings that count (doc, field, pos, token); with words(query_id, text) those that can meet a word of
        them: those of the words (or starts) for up to `FEW_WORDS`, else all of the words' buckets."""
        if words is None:
            return self._alive(None, F.lit(True))
        asked = words.select(F.explode(tokens(F.col("text"))).alias("word")).select("word", _bucket(F.col("word")).alias("bucket")).distinct()
        some = [r.word for r in asked.select("word").limit(FEW_WORDS + 1).collect()]  # bounded
        buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # BUCKETS rows at most
        met = F.lit(True)
        if 0 < len(some) <= FEW_WORDS:
            met = reduce(Column.__or__, [F.col("token").startswith(w) for w in some]) if prefix else F.col("token").isin(some)
        return self._alive(buckets, met)

    def compact(self) -> None:
        """One base of all versions, without the postings that no longer count. Earlier folders go after it is whole."""
        held = self._held()
        last = max((n for _, n in held), default=None)
        if last is None or ("base", last) in held:
            return  # nothing has come since
        self._write(self._alive(None, F.lit(True)), f"base{last}")
        for kind, n in held:
            folder = self._folder(f"{kind}{n}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows = rows.select(F.col("doc").cast(self.doc_type), "field", F.col("pos").cast("int").alias("pos"), "token").filter("doc is not null and token <> ''")
        rows = rows.withColumn("bucket", _bucket(F.col("token")))
        # ranges by token and doc, so that a letter or a single word of a third of all rows is spread over files too
        dealt = rows.repartitionByRange("bucket", "token", "doc").sortWithinPartitions("bucket", "token", "doc", "pos")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _held(self) -> list[tuple[str, int]]:
        """(kind, version) of the folders that were written whole, from the last base on."""
        pattern = self._folder("*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        names = [f.getPath().getParent().getName() for f in found]
        held = [(kind, int(name[len(kind) :])) for name in names for kind in ("base", "gone", "v") if name.startswith(kind)]
        base = max((n for kind, n in held if kind == "base"), default=-1)
        whole = {n for kind, n in held if kind == "v"}
        return sorted((kind, n) for kind, n in held if (kind, n) == ("base", base) or (n > base and n in whole))

    def _alive(self, buckets: list[int] | None, met: Column) -> DataFrame:
        schema = f"doc {self.doc_type}, field string, pos int, token string"
        held = self._held()
        out = self.spark.createDataFrame([], schema + ", version int")
        for kind, n in held:
            if kind != "gone":
                part = self.spark.read.schema(schema + ", bucket int").parquet(f"{self.path}/{kind}{n}")
                part = part if buckets is None else part.filter(F.col("bucket").isin(buckets))
                out = out.unionByName(part.filter(met).drop("bucket").withColumn("version", F.lit(n)))
        marks = [self.spark.read.schema(f"doc {self.doc_type}").parquet(f"{self.path}/gone{n}").withColumn("since", F.lit(n)) for kind, n in held if kind == "gone"]
        if marks:
            gone = reduce(DataFrame.unionByName, marks).groupBy("doc").agg(F.max("since").alias("since"))
            few = sum(m.count() for m in marks) <= BROADCAST_GONE  # counts of the files' footers
            gone = F.broadcast(gone) if few else gone
            out = out.join(gone, (out["doc"] == gone["doc"]) & (out["version"] < gone["since"]), "left_anti")
        return out.select("doc", "field", "pos", "token")


def keep_postings(changes: DataFrame, kept: Postings, field: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the postings of a stream changes(doc, text, deleted, at). Each batch is a version: its documents lose what they
    had and get the words of their last text by `at` (ties: not deleted first, then the greatest text); batches count in
    their order. A batch that is run again after a failure writes the same version."""

    def put(batch: DataFrame, batch_id: int) -> None:
        last = batch.filter("doc is not null").groupBy("doc").agg(F.max(F.struct("at", ~F.col("deleted"), "text")).alias("s")).select("doc", "s.*")
        last = cut(last.toDF("doc", "at", "there", "text"))
        kept.add(batch_id, token_table(last.filter("there"), "doc", "text", field), last)

    writer = changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
