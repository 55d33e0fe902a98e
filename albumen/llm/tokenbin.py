"""Token ids in binary blocks, by an adaptive context-mixing range coder.

Texts are encoded with the tokenizers library, each document gets an end id, and runs of whole documents form a chunk. A
chunk's ids are cut into blocks that are coded apart from one another: each starts from empty models and has a checksum.
For each id, order-2 and order-1 tables (the last id after these two, after this one) each predict an id with a
confidence, and order-0 statistics predict its size class; the counts of the order-0 statistics and of the statistics in
the context of both confidences are mixed by addition, every few ids anew, and drive one arithmetic-coding step. A
carry-less range coder of 64 bits writes 16-bit words. The blocks of a chunk are the lanes of numpy arrays, so each step codes one id of each.

Files: Parquet as the container, a chunk in each row, rows and files in ascending document order.
"""

from __future__ import annotations

import unicodedata
import zlib
from itertools import chain, repeat
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import new_path

END_ID = 2
BLOCK = 1024
#: Ids in a chunk, about; a longer document is a chunk of its own.
CHUNK = 1 << 21
#: Distinct stems and other words whose ids a worker keeps; beyond that it starts afresh, which costs time only.
CACHE_WORDS = 800_000
#: Texts whose words are looked up at once.
SLICE_TEXTS = 1024
#: Ids are below 2 ** ID_BITS.
ID_BITS = 16
#: Ids of up to so many bits are one class.
_LEAST_BITS = 8
_CLASSES = ID_BITS - _LEAST_BITS + 1
_HIT1, _HIT2 = _CLASSES, _CLASSES + 1
_SYMBOLS = _CLASSES + 2
_SLOTS_BITS = 9
#: Pairs of confidences, each of 0 to 3.
_CONTEXTS = 16
#: Frequencies of a context sum up to 2 ** _SCALE.
_SCALE = 12
#: Statistics become frequencies before these places of a block, and are halved before each of the second.
_FRESH = frozenset([1, 2, 4, 8, 16, *range(32, BLOCK, 32)])
_HALVED = frozenset(range(256, BLOCK, 256))
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_U = np.uint64


class _Model:
    """The lanes' predictions and statistics; coder and decoder run the same steps. Arrays have the lanes innermost, tables a lane after another."""

    def __init__(self, lanes: int):
        self.guesses = np.full(2 * lanes << _SLOTS_BITS, 1 << ID_BITS + 2, np.uint32)  # id << 2 | confidence, by the last id and by the last two
        self.seen = np.zeros((_SYMBOLS, _CONTEXTS, lanes), np.int16)
        self.run = np.full((16, _CONTEXTS, lanes), 1 << _SCALE, np.uint16)  # running sums of frequencies; symbols below the first have none
        self.run[0] = 0
        self.plane = np.int64(_CONTEXTS * lanes)
        self.lane, self.all = np.arange(lanes), lanes
        self.slot0 = np.arange(2 * lanes).reshape(2, lanes) << _SLOTS_BITS
        self.last = np.zeros(lanes, np.uint32)
        self.hash = np.zeros((2, lanes), np.uint32)
        self.refresh()

    def keep(self, live: int) -> None:
        """The first `live` lanes go on."""
        self.lane, self.slot0, self.last, self.hash = self.lane[:live], self.slot0[:, :live], self.last[:live], self.hash[:, :live]

    def refresh(self) -> None:
        """Frequencies of each context: its own statistics and those of all contexts, mixed by addition."""
        mixed = self.seen.astype(np.uint32) * np.uint32(40)
        mixed += (self.seen.sum(1, dtype=np.uint32) * np.uint32(12) + np.uint32(1))[:, None]
        for j in range(1, _SYMBOLS):
            mixed[j] += mixed[j - 1]
        mixed *= np.uint32(((1 << _SCALE) - _SYMBOLS) << 16) // mixed[-1]
        mixed >>= np.uint32(16)
        self.run[1:_SYMBOLS] = mixed[:-1]
        self.run[1:_SYMBOLS] += np.arange(1, _SYMBOLS, dtype=np.uint16)[:, None, None]

    def start(self, t: int) -> None:
        """What the tables hold for place t."""
        if t in _FRESH:
            self.refresh()
            if t in _HALVED:
                self.seen >>= 1
        self.at = self.slot0 + (self.hash >> np.uint32(32 - _SLOTS_BITS))
        self.held = self.guesses.take(self.at)
        conf = self.held & np.uint32(3)
        self.context = (conf[1] * np.uint32(4) + conf[0]) * np.int64(self.all) + self.lane

    def bounds(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(running sum before the symbol, its frequency)."""
        self.row = symbols * self.plane + self.context
        flat = self.run.ravel()
        under = flat.take(self.row)
        return under.astype(np.uint64), (flat.take(self.row + self.plane) - under).astype(np.uint64)

    def find(self, place: np.ndarray) -> np.ndarray:
        """The symbol whose interval holds the place."""
        flat, place, at = self.run.ravel(), place.astype(np.uint16), self.context
        for b in (8, 4, 2, 1):
            at = at + (flat.take(at + b * self.plane) <= place) * (b * self.plane)
        return (at - self.context) // self.plane

    def symbol(self, ids: np.ndarray) -> np.ndarray:
        out = _BITS.take(ids)
        hit = (self.held ^ (ids << np.uint32(2))) < 4
        np.copyto(out, _HIT1, where=hit[0])
        np.copyto(out, _HIT2, where=hit[1])
        return out

    def update(self, ids: np.ndarray) -> None:
        flat = self.seen.ravel()
        flat[self.row] = flat.take(self.row) + np.int16(1)
        wide = ids << np.uint32(2)
        differ = self.held ^ wide  # of equal ids: the confidence
        self.guesses[self.at] = wide | np.where(differ < 4, np.minimum(differ + np.uint32(1), np.uint32(3)), np.uint32(1))
        self.hash[0] = ids * np.uint32(0x9E3779B1)
        self.hash[1] = ids * np.uint32(0x85EBCA6B) + self.last * np.uint32(0xC2B2AE35)
        self.last = ids


_BITS = np.array([max(int(i).bit_length() - _LEAST_BITS, 0) for i in range(1 << ID_BITS)], np.int64)  # the class of each id
_RAW = np.array([_LEAST_BITS, *range(_LEAST_BITS, ID_BITS), 0, 0], np.uint64)  # bits that a symbol leaves open
_OPEN = (_U(1) << _RAW) - _U(1)
_HEAD = np.array([0, *(1 << b for b in range(_LEAST_BITS, ID_BITS)), 0, 0], np.int64)


def _settle(low: np.ndarray, span: np.ndarray, shift) -> None:
    """Brings lanes to a span of _BOT at least. shift(lanes) is told of those whose first word is settled, before it goes:
    of all lanes (None, and a mask) at first, then of the few that have more."""
    settled, small = (low ^ (low + span)) < _TOP, span < _BOT
    if len(cut := np.flatnonzero(small & ~settled)):
        span[cut] = (_U(0) - low[cut]) & (_BOT - _U(1))
        settled |= small
    shift(None, settled)
    by = settled.astype(np.uint64) << _U(4)
    low <<= by
    span <<= by
    which = np.flatnonzero(span < _TOP)
    while len(which):
        lo, sp = low[which], span[which]
        settled, small = (lo ^ (lo + sp)) < _TOP, sp < _BOT
        cut = small & ~settled
        sp[cut] = (_U(0) - lo[cut]) & (_BOT - _U(1))
        go = settled | small
        which = which[go]
        shift(which, None)
        low[which], span[which] = lo[go] << _U(16), sp[go] << _U(16)


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """(coded bytes, crc32 of the ids) of each block of BLOCK ids."""
    n = len(ids)
    lanes = -(-n // BLOCK)
    if not n:
        return [], []
    padded = np.zeros(lanes * BLOCK, np.uint32)
    padded[:n] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)  # only the last block can be shorter
    raw = memoryview(padded[:n].astype("<u4").tobytes())
    sums = [zlib.crc32(raw[i * BLOCK * 4 : (i + 1) * BLOCK * 4]) for i in range(lanes)]
    room = 3 * BLOCK + 8
    out = np.zeros(lanes * room, np.uint16)
    ends_at = np.arange(lanes) * room  # where each lane's next word goes
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    every, model = (low, ends_at), _Model(lanes)
    ends = n - (lanes - 1) * BLOCK

    def shift(which, mask) -> None:
        if which is None:
            out[ends_at] = low >> _U(48)
            np.add(ends_at, mask, out=ends_at)
        else:
            out[ends_at[which]] = low[which] >> _U(48)
            ends_at[which] += 1

    for t in range(BLOCK):
        if t == ends:
            if lanes == 1:
                break
            model.keep(lanes - 1)
            low, span, ends_at = low[:-1], span[:-1], ends_at[:-1]
        s = grid[t, : len(low)]
        model.start(t)
        symbol = model.symbol(s)
        under, freq = model.bounds(symbol)
        step = span >> _U(_SCALE)
        low += step * under
        step *= freq
        step >>= _RAW.take(symbol)
        low += step * (s & _OPEN.take(symbol))
        span[:] = step
        _settle(low, span, shift)
        model.update(s)
    low, ends_at = every
    for _ in range(4):
        out[ends_at] = low >> _U(48)
        ends_at += 1
        low <<= _U(16)
    return [out[i * room : e].tobytes() for i, e in enumerate(ends_at.tolist())], sums


def decode_blocks(blocks: list[bytes], sums: list[int], n: int) -> np.ndarray:
    """The n ids of the blocks; raises ValueError where a block's checksum does not hold."""
    lanes = len(blocks)
    if not lanes:
        return np.zeros(0, np.int64)
    size = np.array([len(b) // 2 for b in blocks])
    data = np.frombuffer(b"".join(blocks) + bytes(16), np.uint16)
    at = np.cumsum(size) - size  # each lane's next word; a broken block may read those of others
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _U(16) | data.take(at, mode="clip")
        at += 1
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    grid = np.zeros((BLOCK, lanes), np.uint32)
    model = _Model(lanes)
    ends = n - (lanes - 1) * BLOCK

    def shift(which, mask) -> None:
        if which is None:
            by = mask.astype(np.uint64)
            np.left_shift(code, by << _U(4), out=code)
            np.bitwise_or(code, by * data.take(at, mode="clip"), out=code)
            np.add(at, mask, out=at)
        else:
            code[which] = code[which] << _U(16) | data.take(at[which], mode="clip")
            at[which] += 1

    for t in range(BLOCK):
        if t == ends:
            if lanes == 1:
                break
            model.keep(lanes - 1)
            low, span, code, at = low[:-1], span[:-1], code[:-1], at[:-1]
        model.start(t)
        step = span >> _U(_SCALE)
        symbol = model.find(np.minimum((code - low) // step, _U((1 << _SCALE) - 1)))
        under, freq = model.bounds(symbol)
        low += step * under
        step *= freq
        step >>= _RAW.take(symbol)
        rest = np.minimum((code - low) // step, _OPEN.take(symbol))
        low += step * rest
        span[:] = step
        s = (_HEAD.take(symbol) | rest.astype(np.int64)).astype(np.uint32)
        np.copyto(s, model.held[0] >> np.uint32(2), where=symbol == _HIT1)
        np.copyto(s, model.held[1] >> np.uint32(2), where=symbol == _HIT2)
        grid[t, : len(s)] = s
        _settle(low, span, shift)
        model.update(s)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    raw = memoryview(ids.astype("<u4").tobytes())
    for i, want in enumerate(sums):
        if zlib.crc32(raw[i * BLOCK * 4 : (i + 1) * BLOCK * 4]) != want:
            raise ValueError(f"block {i}: checksum does not hold")
    return ids.astype(np.int64)


_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The character that the byte-level vocabulary writes for each byte.
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


def _simple_letters() -> list[str]:
    """Latin, Greek and Cyrillic letters whose lower case is one letter to Python, Arrow and the tokenizer, wherever it stands (a sigma's is not), and that normalisation leaves alone."""
    found = [c for c in map(chr, range(0x530)) if c.isalpha() and c != "\u03a3" and c.lower().isalpha() and len(c.lower()) == 1 and all(unicodedata.is_normalized("NFC", x) for x in (c, c.lower()))]
    return [c for c, low in zip(found, pc.utf8_lower(pa.array(found)).to_pylist(), strict=True) if low == c.lower()]


_SIMPLE = _simple_letters()
_LETTERS = f"[{''.join(_SIMPLE)}]"
_MARKS = f"[{''.join(chr(92) + c for c in punctuation)}]"


class _Words:
    """Ids of texts, word by word; the tokenizer drops white space, so a word's ids do not depend on its neighbours.

    A word of Latin, Greek or Cyrillic letters is one piece to the tokenizer, and ASCII marks after it another: they are
    taken apart for all different words of a slice of texts at once, and each different stem is looked up once. The
    tokenizer's model alone is asked for the letters of a new stem in lower case; other words and marks go through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.filled = np.zeros(1 << 20, np.uint16), 0
        self.start, self.size = np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.int64)

    def _encode(self, new: list[str], simple: list[bool]) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        shown = [(s if s.isascii() else s.encode().decode("latin-1").translate(_BYTE_CHARS)) if one else None for s, one in zip(new, simple, strict=True)]
        others = iter(self.tokenizer.encode_batch_fast([s for s, one in zip(new, simple, strict=True) if not one], add_special_tokens=False))
        return [[x.id for x in tokenize(s)] if s is not None else next(others).ids for s in shown]

    def _learn(self, new: list[str], simple: list[bool]) -> None:
        ids = self._encode(new, simple)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = len(self.memo), int(size.sum())
        if first + len(new) > len(self.size):  # a slice with more different words than are kept
            more = first + len(new) - len(self.size)
            self.start, self.size = np.append(self.start, np.zeros(more, np.int64)), np.append(self.size, np.zeros(more, np.int64))
        if self.filled + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(max(total, len(self.flat)), np.uint16))
        self.flat[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(ids), np.uint16, total)
        self.size[first : first + len(new)] = size
        self.start[first : first + len(new)] = self.filled + np.cumsum(size) - size
        self.filled += total
        self.memo.update(zip(new, range(first, first + len(new)), strict=True))

    def _places(self, names: list[str], simple: np.ndarray) -> np.ndarray:
        """Where each of the different names stands; unknown ones are learned."""
        at = np.fromiter(map(self.memo.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.memo) + len(new) > CACHE_WORDS:
                self._clear()
                new = np.arange(len(names))
            first = len(self.memo)
            self._learn([names[i] for i in new.tolist()], simple[new].tolist())
            at[new] = np.arange(first, first + len(new))
        return at

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, how many each has); null counts as empty."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary
        simple = pc.match_substring_regex(different, f"^{_LETTERS}+{_MARKS}*$")
        bare = pc.ascii_rtrim(different, punctuation)
        stems = pc.if_else(simple, pc.utf8_lower(bare), different)
        marked = np.flatnonzero(pc.and_(simple, pc.not_equal(pc.binary_length(different), pc.binary_length(bare))).to_numpy(zero_copy_only=False))
        marks = pc.utf8_ltrim(different.take(pa.array(marked)), "".join(_SIMPLE))
        parts = pa.concat_arrays([stems, marks]).dictionary_encode()
        letters = pc.match_substring_regex(parts.dictionary, f"^{_LETTERS}+$").to_numpy(zero_copy_only=False)
        at = self._places(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), letters)[parts.indices.to_numpy()]
        start, sizes = np.zeros((2, len(different), 2), np.int64)  # of a stem and of its marks, if any
        start[:, 0], sizes[:, 0] = self.start[at[: len(different)]], self.size[at[: len(different)]]
        start[marked, 1], sizes[marked, 1] = self.start[at[len(different) :]], self.size[at[len(different) :]]
        flat = _spread(self.flat, start.ravel(), sizes.ravel())
        each, of = sizes.sum(1), coded.indices.to_numpy()
        size = each[of]
        out = _spread(flat, (np.cumsum(each) - each)[of], size)
        word_ends = np.r_[0, np.cumsum(size)][words.offsets.to_numpy() - words.offsets[0].as_py()]
        return out, np.diff(word_ends)


def _spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat from each start on, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - ends + size, size) + np.arange(total)]


_held: dict[str, _Words] = {}


def _words(path: str) -> _Words:
    """The words of this worker, which go on from task to task."""
    if path not in _held:
        _held.clear()
        _held[path] = _Words(path)
    return _held[path]


_CHUNK_SCHEMA = "part int, before long, doc_ids array<long>, lengths array<int>, n long, blocks array<binary>, sums array<long>"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes docs(doc_id, text) and writes the files; null text has the end id alone."""
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        words, part = _words(tokenizer), TaskContext.get().partitionId()
        done, held, names, lengths, total = 0, [], [], [], 0

        def chunk():
            nonlocal done, held, names, lengths, total
            ids = np.concatenate(held) if held else np.zeros(0, np.int64)
            blocks, sums = encode_blocks(ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([done], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([len(ids)], pa.int64()), pa.array([blocks], pa.list_(pa.binary())), pa.array([sums], pa.list_(pa.int64()))], ["part", "before", "doc_ids", "lengths", "n", "blocks", "sums"])
            done += total
            held, names, lengths, total = [], [], [], 0
            return out

        for batch in batches:
            for lo in range(0, len(batch), SLICE_TEXTS):
                ids, sizes = words.ids(batch.column(1).slice(lo, SLICE_TEXTS))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                at, of = 0, batch.column(0).slice(lo, SLICE_TEXTS).to_pylist()
                for name, size in zip(of, (sizes + 1).tolist(), strict=True):
                    held.append(ids[at : at + size])
                    names.append(name)
                    lengths.append(size)
                    total += size
                    at += size
                    if total >= CHUNK:
                        yield chunk()
        if names:
            yield chunk()

    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(run, _CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian unsigned 32-bit ids) from the files."""
    return _read(spark, path, lambda raw: raw, "ids binary", pa.binary())


def _read(spark: SparkSession, path: str, of, column: str, kind) -> DataFrame:
    files = spark.read.schema(_CHUNK_SCHEMA).parquet(path)
    name = column.split()[0]

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                part, before, names, lengths, n, blocks, sums = (batch.column(i)[row].as_py() for i in range(7))
                ids = decode_blocks(blocks, sums, n)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                got = [of(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(before + ends - np.array(lengths), pa.int64()), pa.array(lengths, pa.int64()), pa.array(got, kind)], ["part", "doc_id", "at", "n_tokens", name])

    parts = files.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each file
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = files.select(*[c.split()[0] for c in _CHUNK_SCHEMA.split(", ")]).mapInArrow(run, f"part int, doc_id long, at long, n_tokens long, {column}")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", name)


def written_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from files written and read back.

    Null or empty text: the end id alone. Rows are in ascending id, null ids first, rows with one id in any order.
    Repeated rows are written each. An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer)
    return _read(spark, path, zlib.crc32, "ids_crc32 long", pa.int64())
