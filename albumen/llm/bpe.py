"""Byte-level BPE over padded numpy matrices.

The pieces of a text (matches of a pattern) are encoded once each: distinct pieces of a batch are bucketed by length
into padded matrices, and in every round each row merges its leftmost pair of minimum rank. Pair ranks come from an
open-addressing hash table; rows that have no mergeable pair left are taken out, and merged rows are compacted. A very
long piece is a matrix by itself: its places are folded into rows of `FOLD`, whose minima tell where to look.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import mix

#: Distinct pieces whose ids a worker keeps; beyond that it starts afresh, which costs time only.
CACHE_PIECES = 400_000
#: Pieces in one matrix.
MATRIX_ROWS = 1 << 14
#: Bytes of a piece above which it is folded into a matrix of its own; such pieces are not kept in the memo.
LONG = 2048
#: Places in a row of a folded piece.
FOLD = 256
_NONE = np.int64(1 << 40)


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """The rank file's tokens in id order. Its size is that of a vocabulary."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PairTable:
    """(left id, right id) -> merged id, by linear probing in two flat arrays."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        left, right, out = [], [], []
        for token, i in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(i)
        keys = np.array(left, np.int64) << np.int64(20) | np.array(right, np.int64)
        values = np.array(out, np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << np.int64(20) | right).ravel()
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out.reshape(left.shape)


def _merge_matrix(ids: np.ndarray, length: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges each row until no pair has a rank. ids: rows x width, -1 beyond a row's length."""
    done_ids, done_len = ids.copy(), length.copy()
    live = np.flatnonzero(length > 1)
    ids, length = ids[live], length[live]
    width = ids.shape[1]
    if not len(live):
        return done_ids, done_len
    rank = np.where(ids[:, 1:] >= 0, table.ranks(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)), _NONE)
    while len(live):
        best = rank.argmin(axis=1)  # the leftmost of equal ranks
        low = rank[np.arange(len(live)), best]
        more = low < _NONE
        if not more.all():
            over = np.flatnonzero(~more)
            done_ids[live[over], : ids.shape[1]] = ids[over]
            done_ids[live[over], ids.shape[1] :] = -1
            done_len[live[over]] = length[over]
            live, ids, length, rank, best, low = live[more], ids[more], length[more], rank[more], best[more], low[more]
            if not len(live):
                break
        rows = np.arange(len(live))
        columns = np.arange(ids.shape[1])
        shift = columns[None, :] > best[:, None]
        moved = np.full_like(ids, -1)
        moved[:, :-1] = ids[:, 1:]
        ids = np.where(shift, moved, ids)
        ids[rows, best] = low
        length = length - 1
        later = np.full_like(rank, _NONE)
        later[:, :-1] = rank[:, 1:]
        rank = np.where(columns[None, :-1] > best[:, None], later, rank)
        for at in (best - 1, best):  # only the two pairs beside the merged one are new
            ok = np.flatnonzero((at >= 0) & (at + 1 < length))
            rank[ok, at[ok]] = table.ranks(ids[ok, at[ok]], ids[ok, at[ok] + 1])
            gone = np.flatnonzero((at >= 0) & (at + 1 >= length) & (at < rank.shape[1]))
            rank[gone, at[gone]] = _NONE
        width = max(2, int(length.max()))
        if width < ids.shape[1]:
            ids, rank = ids[:, :width], rank[:, : width - 1]
    return done_ids, done_len


def _merge_folded(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """The same for one long row, in time about linear in its length.

    A round looks at the minima of the folds and at the folds that hold the least rank. It merges the leftmost such pair
    and, in order, those of the same rank after it, up to the first merge that makes a pair of a lesser rank: until then
    one merge a round would have taken the same pairs. Merged places are skipped by links, and go once they are half.
    """
    while True:
        n = len(ids)
        rank = np.full((n // FOLD + 1) * FOLD, _NONE, np.int64)
        rank[: n - 1] = table.ranks(ids[:-1], ids[1:])
        folds = rank.reshape(-1, FOLD)
        least = folds.min(axis=1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n stands for the end
        ids, gone = np.append(ids, 0), np.zeros(n, bool)
        alive, half = n, n // 2 if n > LONG else 0
        while alive > max(half, 1) and (low := least.min()) < _NONE:
            held = np.flatnonzero(least == low)
            row, column = np.nonzero(folds[held] == low)
            at = held[row] * FOLD + column
            chained = np.append(False, after[at[:-1]] == at[1:])  # shares a token with the place before
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
            right = after[at]
            end, left = after[right], before[at]
            joined = np.append(False, end[:-1] == at[1:])  # its left neighbour has just been merged
            first = np.where(joined, low, ids[np.maximum(left, 0)])
            token = np.full(len(at), low)
            made = np.minimum(np.where(left >= 0, table.ranks(first, token), _NONE), np.where(end < n, table.ranks(token, ids[end]), _NONE))
            if (lesser := made < low).any():
                some = int(lesser.argmax()) + 1
                at, right, end = at[:some], right[:some], end[:some]
            ids[at] = low
            after[at] = end
            before[end] = at
            rank[right], gone[right] = _NONE, True
            left = before[at]
            left = left[left >= 0]
            for place in (at, left):
                rank[place] = np.where(after[place] < n, table.ranks(ids[place], ids[after[place]]), _NONE)
            touched = np.unique(np.concatenate([at, right, left]) // FOLD)
            least[touched] = folds[touched].min(axis=1)
            alive -= len(at)
        finished = not (least < _NONE).any()
        ids = ids[:n][~gone]
        if finished or len(ids) < 2:
            return ids


def encode_pieces(pieces: list[bytes], table: PairTable) -> list[list[int]]:
    """The ids of each piece."""
    out: list[list[int]] = [[]] * len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    order = np.argsort(size, kind="stable")
    lo = int(np.searchsorted(size[order], 0, "right"))
    short = int(np.searchsorted(size[order], LONG, "right"))
    for i in order[short:].tolist():
        out[i] = _merge_folded(table.byte[np.frombuffer(pieces[i], np.uint8)], table).tolist()
    order = order[:short]
    while lo < len(order):
        width = 1 << int(size[order[lo]] - 1).bit_length()  # of the bucket
        hi = int(np.searchsorted(size[order], width, "right"))
        hi = min(hi, lo + max(1, min(MATRIX_ROWS, (1 << 21) // width)))
        part = order[lo:hi]
        length = size[part]
        flat = table.byte[np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)]
        ids = np.full((len(part), max(2, int(length.max()))), -1, np.int64)
        ids[np.arange(ids.shape[1])[None, :] < length[:, None]] = flat
        ids, length = _merge_matrix(ids, length, table)
        for i, row, n in zip(part.tolist(), ids.tolist(), length.tolist(), strict=True):
            out[i] = row[:n]
        lo = hi
    return out


class Coder:
    """Texts to ids and back, with a bounded memo of pieces."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.tokens, self.find, self.table = tokens, regex.compile(pattern).findall, PairTable(tokens)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.shared = list(range(len(tokens)))  # one object for each id, so that the memo stays small

    def encode(self, texts: list[str | None]) -> Iterator[list[tuple[int, ...]]]:
        """For each text the ids of its pieces."""
        found = [self.find(t) if t else [] for t in texts]
        new = list({p for ps in found for p in ps if p not in self.memo})
        if len(self.memo) + len(new) > CACHE_PIECES:
            self.memo.clear()
            new = list({p for ps in found for p in ps})
        self.memo.update((p, tuple(map(self.shared.__getitem__, ids))) for p, ids in zip(new, encode_pieces([p.encode() for p in new], self.table), strict=True))
        for ps in found:
            yield list(map(self.memo.__getitem__, ps))
        for p in new:
            if len(p) > LONG:
                del self.memo[p]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def text_groups(texts: list[str | None], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size or i + 1 == len(texts):
            yield lo, i + 1
            lo, total = i + 1, 0


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. Null or empty text: no ids. Repeated rows: each its own row."""

    def run(batches):
        coder = Coder(tokens, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in text_groups(texts):
                ids = [list(chain.from_iterable(x)) for x in coder.encode(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """(doc_id, text_bytes binary) from (doc_id, ids); null ids give null."""

    def run(batches):
        for batch in batches:
            out = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "text_bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text_bytes binary")


def roundtrip_digest(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text: encoded, then decoded from the ids.

    Null text counts as empty (no ids). Repeated rows and ties give a row each; an empty table gives none; further
    columns are ignored, whatever their names. A text is held by one task as a whole; the time it takes is about linear
    in its length, also where it is one piece without a break.
    """

    def run(batches):
        coder = Coder(tokens, pattern)
        said: list[str] = [str(i) for i in range(len(tokens))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in text_groups(texts):
                n, ids_sha, text_sha = [], [], []
                for pieces in coder.encode(texts[lo:hi]):
                    ids = list(chain.from_iterable(pieces))
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(said.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
