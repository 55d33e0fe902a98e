"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are the byte 2- to 4-grams of its lower-cased words with a mark at either end, hashed to BUCKETS. The
model averages their embeddings and applies a linear softmax; numpy trains both by stochastic gradient descent on a
bounded sample of labelled rows, a temperature calibrates the probabilities on a held part of that sample, and a
threshold set there says which predictions are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices

BUCKETS = 1 << 15
DIM = 12
#: Labelled rows of each language that are learned from, about (the bound of the training sample).
ROWS_PER_LANGUAGE = 600
BROADCAST_LANGUAGES = 10_000
EPOCHS = 6
#: Share of the sample that is kept from training for calibration.
CALIBRATE = 0.25
#: At most this share of the calibration rows may be rejected, and no prediction of a probability of 0.5 or more.
REJECTED = 0.002
UNKNOWN = "und"
#: Texts that a Python worker is sent at once, and bytes of them whose subwords are made at once: a byte takes some 150 more.
TEXTS, SUBWORD_BYTES = 512, 1 << 18

_STREAM = np.full(256, 0x20, np.uint8)
_STREAM[0x41:0x5B] = np.arange(0x61, 0x7B)
_STREAM[0x61:0x7B] = np.arange(0x61, 0x7B)
_STREAM[0x80:] = np.arange(0x80, 0x100)


def subwords(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every subword."""
    rows = len(offs) - 1
    size = np.diff(offs)
    of = np.repeat(np.arange(rows), size)
    stream = np.full(len(data) + rows + 1, 0x20, np.uint8)
    stream[np.arange(len(data)) + of + 1] = _STREAM[data]
    row = np.repeat(np.arange(rows + 1), np.append(size + 1, 1))
    row[1:] = row[:-1].copy()  # the mark after a document belongs to it
    wide, blank = stream.astype(np.uint32), stream == 0x20
    out_rows, out = [], []
    code = wide.copy()
    inner = np.zeros(len(stream), bool)
    for n in (2, 3, 4):
        m = len(stream) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(0x01000193) ^ wide[n - 1 :]
        if n > 2:
            inner = inner[:m] | blank[n - 2 : n - 2 + m]
        else:
            inner = inner[:m]
        ok = ~inner & ~(blank[:m] & blank[n - 1 :])
        if n == 2:
            ok &= ~blank[:m] | ~blank[1:]
        at = np.flatnonzero(ok)
        x = code[at] + np.uint32(n)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        out_rows.append(row[at + n - 1] if n == 2 else row[at + 1])
        out.append((x & np.uint32(BUCKETS - 1)).astype(np.int64))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.minimum(np.concatenate(out_rows), max(rows - 1, 0)), np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a bucket's contribution to each language's score
    bias: np.ndarray
    threshold: float

    def predict(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, document by language."""
        rows, buckets = subwords(data, offs)
        n = len(offs) - 1
        count = np.maximum(np.bincount(rows, minlength=n), 1)
        score = np.stack([np.bincount(rows, weights=self.table[buckets, j], minlength=n) for j in range(len(self.languages))], axis=1)
        return _softmax(score / count[:, None] + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> Model | None:
    """samples: (language, buckets, shares of each bucket). Stochastic gradient descent, one text a step."""
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    code = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held = order[: int(CALIBRATE * len(order))]
    used = order[len(held) :]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            lang, idx, share = samples[i]
            rate = 0.5 * (1 - done / steps)
            done += 1
            h = share @ emb[idx]
            g = _softmax((h @ out + bias)[None, :])[0]
            g[code[lang]] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            emb[idx] -= (40 * rate) * share[:, None] * back
    table = emb @ out
    check = held if len(held) else used
    logits = np.stack([s[2] @ table[s[1]] for s in (samples[i] for i in check)]) + bias
    truth = np.array([code[samples[i][0]] for i in check])
    best = min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0), key=lambda t: -np.log(np.maximum(_softmax(logits * t)[np.arange(len(truth)), truth], 1e-12)).mean())
    top = _softmax(logits * best).max(axis=1)
    threshold = min(0.5, float(np.quantile(top, REJECTED)))
    return Model(languages, (table * best).astype(np.float32), bias * best, threshold)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from rows with a language whose crc32(id as text) mod 3 is not 1; None where there are none."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.crc32(F.col(id_col).cast("string")).alias("crc"), F.xxhash64(F.col(id_col), F.lit(3)).alias("order"))
    rows = rows.filter("lang is not null and text is not null and crc % 3 <> 1").filter(F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").count()
    share = counts.select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(float(ROWS_PER_LANGUAGE)) / F.col("count")).alias("share"))
    # sent to every task where the languages are few, so that a language of most rows is no large task
    share = F.broadcast(share) if counts.count() <= BROADCAST_LANGUAGES else share
    picked = rows.join(share, rows["lang"] == share["l"]).filter(F.pmod("order", F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30)).select("text", "lang", "order")

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(0), SUBWORD_BYTES):
                row, bucket = subwords(data, offs)
                both, count = np.unique(row * BUCKETS + bucket, return_counts=True)
                of, idx = both // BUCKETS, both % BUCKETS
                ends = np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)
                total = np.maximum(np.bincount(row, minlength=hi - lo), 1)
                buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array(idx.astype(np.int32)))
                shares = pa.ListArray.from_arrays(pa.array(ends), pa.array((count / total[of]).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), buckets, shares], ["lang", "order", "buckets", "shares"])

    found = picked.mapInArrow(run, "lang string, order long, buckets array<int>, shares array<float>").toArrow()
    samples = sorted(zip(found["order"].to_pylist(), range(len(found)), strict=True))
    lang, buckets, shares = found["lang"].to_pylist(), found["buckets"].combine_chunks(), found["shares"].combine_chunks()
    return train([(lang[i], buckets[i].values.to_numpy().astype(np.int64), shares[i].values.to_numpy().astype(np.float64)) for _, i in samples if len(buckets[i])])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row.

    Null text, or text without a letter: `und`, score 0, rejected. Where nothing could be learned every row is so. A
    prediction below the model's threshold keeps its language and is marked rejected. Repeated rows give a row each;
    equal texts get equal predictions; further columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1), SUBWORD_BYTES):
                letter = batch.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                if model is None:
                    lang, score, low = [UNKNOWN] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
                else:
                    p = model.predict(data, offs)
                    best = p.argmax(axis=1)
                    score = np.where(letter, p[np.arange(len(p)), best], 0.0)
                    low = ~letter | (score < model.threshold)
                    lang = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = (F.crc32(F.col(id_col).cast("string")) % 3 == 1).alias("held_out")
    letters = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letter")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held, letters).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs whose language is not rejected, with the columns of docs, whatever their names.

    Rows are judged by their own text: null texts and texts without a letter go, whatever else stands under their id.
    Repeated rows stay or go together; an empty table, or one without a label, is left without rows.
    """
    from .storage import short_batches, spare, store

    k = spare(docs, "_gone_text")
    with short_batches(docs.sparkSession, TEXTS):
        model = learn(docs) if model is None else model
        keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")  # a prediction follows from the text alone
        gone = store(predict(keyed, model).filter("rejected").select(F.col("doc_id").alias(k)).distinct(), "rejected")
    return docs.join(gone, F.xxhash64(docs["text"]) == gone[k], "left_anti")
