"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is well formed if its role initials read `(s?(ua)+)?`. Four states tell what has been emitted so far: nothing
(0), the system turn (1), a user turn (2), an assistant turn (3). The cheapest edits are found in linear space: cost
vectors of the four states run forward from one end and backward from the other, meet in the middle, the crossing of least
cost is chosen, among equals the one whose edits read least, and both halves are solved in the same way. What makes that
comparison possible without keeping any edits: within the forward vector the least edits of the states are ranked, and a
step's rank follows from the rank before and the step's own letters.

On Spark the division starts above the rows. Rows are reduced to a few numbers, dealt by their order to range partitions
and cut into blocks; a block is a 4 x 4 matrix of costs and ranks, and matrices meet for a whole conversation as vectors do
for rows. Then every block is solved by itself between its two states. So a conversation of any length is no task's
burden, except that its texts pass through one task as a stream, for its digest or its rows in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import store

#: Rows of a block at most.
BLOCK = 1024
#: Rows solved in one numpy call at most.
AT_ONCE = 1 << 15

_FAR = 1 << 40  # the cost of what cannot be
_AFTER_INSERT = (2, 2, 3, 2)
_EMITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_INITIALS = "?sua"
#: The kind of a row that must be deleted; other kinds are 2 * initial + truncated.
_FORCED = 8
#: Cost and edits that lead from each state to an end.
_END_COST, _END = np.array([0, 4, 2, 0]), ("", "II", "I", "")


def _steps() -> tuple[np.ndarray, np.ndarray, list]:
    """For each kind of row and pair of states: the least cost, the order of its edits among edits of equal origin, the edits."""
    cost, order = np.full((9, 4, 4), _FAR), np.zeros((9, 4, 4), np.int64)
    edits = [[[""] * 4 for _ in range(4)] for _ in range(9)]
    for kind in range(9):
        for p in range(4):
            best: dict[int, tuple[int, str]] = {}
            at, inserted = p, ""
            for _ in range(3):
                moves = [(at, 3, "D")]
                if kind != _FORCED:
                    fault = kind % 2
                    if (kept := _EMITS.get((at, _INITIALS[kind // 2]))) is not None:
                        moves.append((kept, fault, "K"))
                    moves.append((_AFTER_INSERT[at], 2 + fault, "R"))
                for q, c, letter in moves:
                    found = (2 * len(inserted) + c, inserted + letter)
                    best[q] = min(best.get(q, found), found)
                at, inserted = _AFTER_INSERT[at], inserted + "I"
            for q, (c, said) in best.items():
                cost[kind, p, q], edits[kind][p][q] = c, said
                order[kind, p, q] = int("".join(str(" DIKR".index(x)) for x in said.ljust(3)), 5)
    return cost, order, edits


_COST, _ORDER, _EDITS = _steps()


def _forward(cost: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(costs, ranks) of the four states after the steps lo..hi of each segment, from its start state."""
    by = np.argsort(lo - hi, kind="stable")
    lo, size = lo[by], (hi - lo)[by]
    c = np.full((len(lo), 4), _FAR)
    c[np.arange(len(lo)), start[by]] = 0
    r = np.zeros((len(lo), 4), np.int64)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        step = lo[:n] + j
        both = ((c[:n, :, None] + cost[step]) << 12) + ((r[:n, :, None] << 7) + order[step])
        both = both.min(1)
        key = both & 4095
        c[:n] = np.minimum(both >> 12, _FAR)
        r[:n] = (key[:, :, None] > key[:, None, :]).sum(2)
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    return c[back], r[back]


def _backward(cost: np.ndarray, lo: np.ndarray, hi: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs from each of the four states to the end state over the steps lo..hi."""
    by = np.argsort(lo - hi, kind="stable")
    hi, size = hi[by], (hi - lo)[by]
    c = np.full((len(hi), 4), _FAR)
    c[np.arange(len(hi)), end[by]] = 0
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        c[:n] = np.minimum((cost[hi[:n] - 1 - j] + c[:n, None, :]).min(2), _FAR)
    out = np.empty_like(c)
    out[by] = c
    return out


def _crossings(cost: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each step, on the least of the cheapest ways from start to end of each segment."""
    before, after = np.zeros(len(cost), np.int64), np.zeros(len(cost), np.int64)
    while len(lo):
        one = hi - lo == 1
        before[lo[one]], after[lo[one]] = start[one], end[one]
        lo, hi, start, end = (x[hi - lo > 1] for x in (lo, hi, start, end))
        mid = (lo + hi) // 2
        there, rank = _forward(cost, order, lo, mid, start)
        cross = (((there + _backward(cost, mid, hi, end)) << 2) + rank).argmin(1)
        lo, hi, start, end = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([start, cross]), np.concatenate([cross, end])
    return before, after


# --- rows to numbers

_ORDER_BY = ["turn", "role", "h1", "h2"]
_PLACE = "turn long, role string, h1 long, h2 long"


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies; nulls of role and text are one blank."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0 to 2) of rows damaged by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties
    its text, 2 takes its `.!?` away, 3 repeats it, 4 makes it the user's. Nulls are one blank."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _rows(conversations).withColumn("fault", F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20)))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(3), F.col("text"))})


def _kinds(rows: DataFrame) -> DataFrame:
    """One row for each distinct row of a conversation: its place, how many copies, initial, blank, truncated, repeated."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    initial = F.when(F.col("role") == "", 0).otherwise(F.instr(F.lit(_INITIALS[1:]), F.substring("role", 1, 1)))
    seen = _placed(rows).select("conv_id", *_ORDER_BY, F.col("copies").cast("long").alias("copies"), initial.alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    once = store(seen.groupBy("conv_id", *_ORDER_BY).agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("initial", "blank", "open")]), "kinds")
    of = once.filter("copies > 0 and not blank").groupBy("conv_id", "role", "h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min("turn").alias("since"), F.max(F.col("turn").isNull()).alias("always")).filter("c > 1")
    of = of.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "since", "always")
    both = once.join(of, once["conv_id"].eqNullSafe(of["_c"]) & (once["role"] == of["_r"]) & (once["h1"] == of["_1"]) & (once["h2"] == of["_2"]), "left")
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("always") | (F.col("turn") > F.col("since"))), F.lit(False))
    return both.select("conv_id", *_ORDER_BY, "copies", "initial", "blank", "open", again.alias("again"))


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_BLOCK = f"{_PLACE}, first int, last int, low long, high long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", matrix binary, kinds binary, runs binary"


def _blocks(kinds: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """The blocks of every conversation in order: where they start, their counts, their matrix and the kinds of their rows."""
    n = max(2, int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = ["conv_id", *_ORDER_BY]
    dealt = kinds.repartitionByRange(n, *by).sortWithinPartitions(*by)
    names = [*by, "first", "last", "low", "high", *_COUNTS, "matrix", "kinds", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            conv, turn = batch.column("conv_id"), batch.column("turn")
            coded = conv.dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            heads = np.concatenate([np.arange(a, b, block_rows) for a, b in zip(cut, np.r_[cut[1:], len(code)], strict=True)])
            ends = np.r_[heads[1:], len(code)]
            block = np.repeat(np.arange(len(heads)), ends - heads)
            copies, initial, blank, open_, again = get("copies"), get("initial"), get("blank"), get("open"), get("again")
            there, forced = copies > 0, blank | again
            kind = np.where(forced, _FORCED, 2 * initial + open_)
            # a row of several copies is two steps: itself, and the others, which must go
            own = np.where(forced, copies, 1)
            item = np.flatnonzero(there)
            more = item[(copies > own)[item]]
            at = np.argsort(np.r_[2 * item, 2 * more + 1], kind="stable")
            steps = np.r_[kind[item], np.full(len(more), _FORCED)][at]
            runs = np.r_[own[item], (copies - own)[more]][at]
            owner = block[np.r_[item, more][at]]
            bounds = np.searchsorted(owner, np.arange(len(heads) + 1))
            cost, order = _COST[steps] + 3 * (runs - 1)[:, None, None], _ORDER[steps]
            c, r = _forward(np.minimum(cost, _FAR), order, np.repeat(bounds[:-1], 4), np.repeat(bounds[1:], 4), np.tile(np.arange(4), len(heads)))
            matrix = np.concatenate([c.reshape(-1, 16), r.reshape(-1, 16)], 1)
            total = lambda x: np.bincount(block, weights=x, minlength=len(heads)).astype(np.int64)  # noqa: B023, E731
            live = np.flatnonzero(there)
            a, b = live[:-1], live[1:]
            legal = np.isin(initial[a] * 4 + initial[b], [1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2])
            wrong = np.where(there, copies - 1, 0)
            wrong[b[~legal & (block[a] == block[b])]] += 1
            known = turn.is_valid().to_numpy(zero_copy_only=False) & there
            when = turn.fill_null(0).to_numpy(zero_copy_only=False)
            spot = np.flatnonzero(known)
            fresh = np.zeros(len(code), bool)
            fresh[spot] = np.r_[[True] * bool(len(spot)), (when[spot[1:]] != when[spot[:-1]]) | (block[spot[1:]] != block[spot[:-1]])]
            edge = lambda x, ok, f: _edges(x, ok, block, len(heads), f)  # noqa: B023, E731
            counts = [total(np.where(there & blank, copies, 0)), total(np.where(there & ~blank, copies - ~again, 0)), total(there & ~forced & open_), total(wrong), total(fresh)]
            flat = np.r_[0, np.cumsum(bounds[1:] - bounds[:-1])]
            small, long = steps.astype(np.uint8), (runs.astype(np.int64) if (runs > 1).any() else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(x).take(pa.array(heads)) for x in by],
                    edge(initial, there, "first").cast(pa.int32()), edge(initial, there, "last").cast(pa.int32()), edge(when, known, "first"), edge(when, known, "last"),
                    *map(pa.array, counts),
                    pa.array([m.tobytes() for m in matrix], pa.binary()),
                    pa.array([small[x:y].tobytes() for x, y in zip(flat[:-1], flat[1:], strict=True)], pa.binary()),
                    pa.array([b"" if long is None else long[x:y].tobytes() for x, y in zip(flat[:-1], flat[1:], strict=True)], pa.binary()),
                ],
                names,
            )

    return dealt.mapInArrow(run, f"conv_id {kinds.schema['conv_id'].dataType.simpleString()}, {_BLOCK}")


def _edges(x: np.ndarray, ok: np.ndarray, block: np.ndarray, n: int, which: str) -> pa.Array:
    """The first or last value of each block that counts, or null."""
    spot = np.flatnonzero(ok)
    out, mask = np.zeros(n, np.int64), np.ones(n, bool)
    if which == "first":
        spot = spot[::-1]
    out[block[spot]], mask[block[spot]] = x[spot], False
    return pa.array(out, mask=mask)


_TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _met(blocks: DataFrame) -> DataFrame:
    """conv_id, place, kinds, runs, start, end, tail and the conversation's totals, of every block: matrices meet."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole conversations."""
        coded = table.column("conv_id").combine_chunks()
        coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        lo = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        hi = np.r_[lo[1:], len(code)]
        whole = np.repeat(np.arange(len(lo)), hi - lo)
        m = np.frombuffer(b"".join(table.column("matrix").to_pylist()), np.int64).reshape(-1, 2, 4, 4)
        cost, order = m[:, 0], m[:, 1]
        c, r = _forward(cost, order, lo, hi, np.zeros(len(lo), np.int64))
        final = c + _END_COST
        last = ((final << 2) + r).argmin(1)
        before, after = _crossings(cost, order, lo, hi, np.zeros(len(lo), np.int64), last)
        sums = {x: np.bincount(whole, weights=table.column(x).to_numpy(), minlength=len(lo)).astype(np.int64) for x in _COUNTS}
        first, final_initial, low, high = (table.column(x).to_pylist() for x in ("first", "last", "low", "high"))
        gaps = np.zeros(len(lo), np.int64)
        for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
            said, when, start = None, None, None
            for j in range(a, b):
                if first[j] is not None:
                    sums["illegal"][i] += said is not None and said * 4 + first[j] not in (6, 11, 14)
                    said = final_initial[j]
                if low[j] is not None:
                    sums["turns"][i] -= when == low[j]
                    start, when = (low[j] if start is None else start), high[j]
            if when is not None:
                gaps[i] = when - start + 1 - sums["turns"][i]
        tail = np.full(len(code), "", object)
        tail[hi - 1] = np.array(_END, object)[last]
        totals = [gaps, *(sums[x] for x in _TOTALS[1:5]), final[np.arange(len(lo)), last]]
        kept = [table.column(x).combine_chunks() for x in ("conv_id", *_ORDER_BY, "kinds", "runs")]
        out = pa.Table.from_arrays([*kept, pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(tail, pa.string()), *[pa.array(x[whole]) for x in totals]], names)
        yield from out.to_batches()

    names = ["conv_id", *_ORDER_BY, "kinds", "runs", "start", "end", "tail", *_TOTALS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            last, at = conv[-1].as_py(), batch.num_rows
            while at and conv[at - 1].as_py() == last:
                at -= 1
            if not at and held and held[-1].column(0)[-1].as_py() == last:
                held.append(batch)
                continue
            if at or held:
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held = [batch.slice(at)]
        if held:
            yield from settle(pa.Table.from_batches(held))

    by = ["conv_id", *_ORDER_BY]
    kind = blocks.schema["conv_id"].dataType.simpleString()
    return blocks.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(run, f"conv_id {kind}, {_PLACE}, kinds binary, runs binary, start int, end int, tail string, " + ", ".join(f"{x} long" for x in _TOTALS))


def _solved(met: DataFrame) -> DataFrame:
    """conv_id, place, totals and the audit of every block."""
    kept = ["conv_id", *_ORDER_BY, *_TOTALS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, runs, tails = (batch.column(x).to_pylist() for x in ("kinds", "runs", "tail"))
            start, end = (batch.column(x).to_numpy().astype(np.int64) for x in ("start", "end"))
            sizes = np.array([len(x) for x in kinds], np.int64)
            group = np.cumsum(sizes) // AT_ONCE
            audits: list[str] = []
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                steps = np.frombuffer(b"".join(kinds[i] for i in rows), np.uint8).astype(np.int64)
                times = np.concatenate([np.frombuffer(runs[i], np.int64) if runs[i] else np.ones(sizes[i], np.int64) for i in rows])
                hi = np.cumsum(sizes[rows])
                lo, some = hi - sizes[rows], sizes[rows] > 0
                before, after = _crossings(np.minimum(_COST[steps] + 3 * (times - 1)[:, None, None], _FAR), _ORDER[steps], lo[some], hi[some], start[rows][some], end[rows][some])
                said = [("D" * (n - 1) if n > 1 else "") + _EDITS[k][p][q] for k, n, p, q in zip(steps.tolist(), times.tolist(), before.tolist(), after.tolist(), strict=True)]
                audits += ["".join(said[a:b]) + tails[i] for i, a, b in zip(rows, lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in kept], pa.array(audits, pa.string())], [*kept, "audit"])

    kind = met.schema["conv_id"].dataType.simpleString()
    dealt = met.repartition("conv_id", *_ORDER_BY)
    return dealt.mapInArrow(run, f"conv_id {kind}, {_PLACE}, " + ", ".join(f"{x} long" for x in _TOTALS) + ", audit string")


# --- edits to rows


class _Emitter:
    """Applies a conversation's edits, which come block by block, to its rows, which come in order."""

    def __init__(self):
        self.state, self.n, self.audit, self.at = 0, 0, "", 0

    def block(self, audit: str) -> None:
        self.audit, self.at = audit, 0

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._say("assistant" if self.state == 2 else "user", "", "I")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._say(role, text, edit)
        elif edit == "R":
            yield self._say("assistant" if self.state == 2 else "user", text, edit)

    def _say(self, role: str, text: str, edit: str) -> tuple[str, str, str]:
        self.state, self.n = _INITIALS.index(role[0]), self.n + 1
        return role, text, edit


def _streamed(rows: DataFrame, solved: DataFrame, emit, schema: str) -> DataFrame:
    """emit over the rows and audits of whole conversations, in order: rows of a partition pass as a stream."""
    blocks = solved.select("conv_id", *_ORDER_BY, F.lit(0).alias("kind"), "audit", *_TOTALS, F.lit(None).cast("string").alias("text"))
    texts = _placed(rows.filter("copies > 0")).select("conv_id", *_ORDER_BY, F.col("copies").cast("int").alias("kind"), F.lit(None).cast("string").alias("audit"), *[F.lit(None).cast("long").alias(x) for x in _TOTALS], "text")
    both = blocks.unionByName(texts)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER_BY, "kind").mapInArrow(emit, schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(new conversation, conv_id, role, kind, audit, totals, text) of every row."""
    first, held = True, None
    for batch in batches:
        conv, role, kind, audit, text = (batch.column(x).to_pylist() for x in ("conv_id", "role", "kind", "audit", "text"))
        totals = [batch.column(x) for x in _TOTALS]
        for i, c in enumerate(conv):
            new = first or c != held
            first, held = False, c
            yield new, c, role[i], kind[i], audit[i], [x[i].as_py() for x in totals] if new else None, text[i]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *_TOTALS, "audit", "repaired_sha256"]
    out: list[list] = [[] for _ in names]
    kind = None
    key = totals = emitter = digest = None
    audits: list[str] = []

    def add(found) -> None:
        for role, text, _ in found:
            digest.update(f"{chr(10) if emitter.n > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))

    def close() -> None:
        add(emitter.inserts())
        for column, value in zip(out, [key, *totals, "".join(audits), digest.hexdigest()], strict=True):
            column.append(value)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], kind), *[pa.array(x, pa.int64()) for x in out[1:7]], pa.array(out[7], pa.string()), pa.array(out[8], pa.string())], names)
        for x in out:
            x.clear()
        return batch

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield batch

    for new, conv, role, copies, audit, sums, text in _conversations(typed()):
        if new:
            if emitter is not None:
                close()
                if len(out[0]) >= 5000:
                    yield flush()
            key, totals, emitter, digest = conv, sums, _Emitter(), hashlib.sha256()
            audits.clear()
        if copies == 0:
            emitter.block(audit)
            audits.append(audit)
        for _ in range(copies):
            add(emitter.row(role, text))
    if emitter is not None:
        close()
    if out[0]:
        yield flush()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    kind = key = emitter = None

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield batch

    def flush() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv_id", "place", "role", "text", "edit"])
        out.clear()
        return batch

    for new, conv, role, copies, audit, _, text in _conversations(typed()):
        if new:
            if emitter is not None:
                out += [(key, emitter.n - 1, *x) for x in emitter.inserts()]
            key, emitter = conv, _Emitter()
        if copies == 0:
            emitter.block(audit)
        for _ in range(copies):
            out += [(key, emitter.n - 1, *x) for x in emitter.row(role, text)]
        if len(out) >= 1000:
            yield flush()
    if emitter is not None:
        out += [(key, emitter.n - 1, *x) for x in emitter.inserts()]
    if out:
        yield flush()


def _plan(rows: DataFrame) -> DataFrame:
    return _solved(_met(store(_blocks(_kinds(rows)), "blocks")))


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit (K, R or I): the turns of the repaired conversations, of (conv_id, turn, role, text).

    Rows are taken by turn, nulls first, then by role and text. Blank and repeated rows go (3 each), as others may; a row
    may be kept (0), given the role of user or assistant (2), and turns without text may be put in (2); a row that stays
    without `.!?` at its end costs 1 more. Of the cheapest edits the least in order of their initials is made.

    Null role or text is one blank; a null conv_id is a conversation of its own. A role counts by its first letter, in
    lower case; a row without role has none and cannot be kept. Equal rows are repeats whatever their order. Texts and
    conversations of any length pass as a stream. An empty table, or a conversation that loses all, gives no rows;
    further columns are ignored, whatever their names.
    """
    rows = _rows(conversations.select("conv_id", "turn", "role", "text"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, _plan(rows), _turns, f"conv_id {kind}, place long, role string, text string, edit string")


def repair_digest(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows
    (conv_id, turn, role, text, copies), as of `damaged`; one without copies has zeros and an empty repair. Odd rows: `repair`."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, _plan(rows), _digest, f"conv_id {kind}, " + ", ".join(f"{x} long" for x in _TOTALS) + ", audit string, repaired_sha256 string")
