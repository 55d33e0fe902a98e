"""License scans by diagonal voting.

All rolling k-word hashes of a text are joined in Spark with the places of the same hashes in the license templates. A
hit votes for its diagonal (place in the text less place in the template); votes are summed by diagonal, neighbouring
diagonals are merged so that a word more or less does not break a span, and a span is verified by how much of its
template the merged places cover. A base phrase counts only where one diagonal holds it whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import ALNUM, gram_hashes, slices, word_hashes, words_of

K = 3
#: Diagonals this near one another are one span.
NEAR = 2
#: Share of a template's grams that a span must cover.
COVER = 0.75

# fixed values
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
_HEAD = np.int64(-0x6C6963656E736573)  # a gram that each text has once, so that each text has a row


def _text_grams(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    w = words_of(data, np.array([0, len(data)]), ALNUM, lower=True)
    return gram_hashes(word_hashes(w), w.row, K)[1].view(np.int64).tolist()


def _template_rows() -> list[tuple[int, int, int, int, str, bool]]:
    """(gram, template, place, grams of the template, label, base)."""
    rows = [(int(_HEAD), -1, 0, 1, "", False)]
    for i, (text, label, base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in TEMPLATES]):
        grams = _text_grams(text)
        rows += [(g, i, place, len(grams), label, base) for place, g in enumerate(grams)]
    return rows


def _grams(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n_words, grams): tk tells texts under one id apart; the first gram is the head."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                w = words_of(data, offs, ALNUM, lower=True)
                h = word_hashes(w)
                at, grams = gram_hashes(h, w.row, K)
                per = np.bincount(w.row[at], minlength=hi - lo)
                ends = np.concatenate([[0], np.cumsum(per + 1)]).astype(np.int32)
                flat = np.empty(int(ends[-1]), np.int64)
                heads = np.zeros(len(flat), bool)
                heads[ends[:-1]] = True
                flat[heads], flat[~heads] = _HEAD, grams.view(np.int64)
                tk = np.zeros(hi - lo, np.uint64)
                np.bitwise_xor.at(tk, w.row, h * (np.arange(len(h)) - w.first[w.row] + 1).astype(np.uint64))
                n = np.diff(w.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(tk.view(np.int64)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "tk", "n_words", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, tk long, n_words long, grams array<long>")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, n_words, copies, template, label, base, first, last, cover) of verified spans, and for each text one row of template -1.

    copies: rows with this id and the same words. first, last: the words at which the span's diagonals start.
    """
    spark = docs.sparkSession
    rows = spark.createDataFrame(_template_rows(), "gram long, template int, place int, of int, label string, base boolean")
    mapped = _grams(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    hits = mapped.select("doc_id", "tk", "n_words", F.posexplode("grams").alias("at", "gram")).join(F.broadcast(rows), "gram")
    votes = hits.withColumn("diag", F.when(F.col("template") < 0, 0).otherwise(F.col("at") - 1 - F.col("place")))
    by = ["doc_id", "tk", "n_words", "template", "label", "base", "of"]
    diagonals = votes.groupBy(*by, "diag").agg(F.collect_set("place").alias("places"), F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("doc_id", "tk", "n_words", "template").orderBy("diag")
    gap = F.coalesce(F.col("diag") - F.lag("diag").over(order), F.lit(NEAR + 1))
    # a base phrase is not merged: each of its places is a diagonal of its own
    marked = diagonals.withColumn("new", F.when(F.col("base") | (gap > NEAR), 1).otherwise(0)).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*by, "span").agg(F.min("diag").alias("first"), F.max("diag").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("seen"), F.max("rows").alias("copies"))
    cover = F.col("seen") / F.col("of")
    return merged.withColumn("cover", cover).filter(F.when(F.col("base"), F.col("seen") == F.col("of")).otherwise(cover >= COVER))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Text is lower-cased in A-Z; words are runs of digits, ASCII letters and non-ASCII characters. n_base: all places of
    base phrases; first_word and last_word: their least and greatest first word, null without one. labels: the base
    ones and those of verified spans. score: the best cover, 0 without a span. Null or empty text: no words, no labels.
    Repeated rows give a row each; an empty table gives none; further columns are ignored.
    """
    found = spans(docs)
    base, head = F.col("base"), F.col("template") < 0
    per = found.groupBy("doc_id", "tk", "n_words").agg(
        F.max(F.when(head, F.col("copies"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(~head, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(~head, F.col("cover"))), F.lit(0.0)).alias("score"),
    )
    # a row for each of the rows that are alike
    each = per.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
