"""Conversation repair against a plain dynamic programme that keeps every state's edits."""

import hashlib
import random
import re
import zlib

import pytest
from albumen.llm import conversations as C

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            out += [row] * (1 + (fault == 3))
    return out


def hashes(spark, texts):
    df = C._placed(spark.createDataFrame([(t,) for t in texts], "text string"))
    return {r.text: (r.h1, r.h2) for r in df.collect()}


def cheapest(rows):
    """(cost, edits) of the cheapest repair of [(initial, forced, truncated)], the least among equals."""
    best = {"": (0, "")}

    def inserted(best):
        while True:
            more = dict(best)
            for last, (c, e) in best.items():
                for x in NEXT[last].replace("s", ""):
                    more[x] = min(more.get(x, (9**9, "")), (c + 2, e + "I"))
            if more == best:
                return best
            best = more

    for initial, forced, truncated in rows:
        after = {}
        for last, (c, e) in inserted(best).items():
            moves = [(last, 3, "D")]
            if not forced:
                moves += [(initial, truncated, "K")] if initial and initial in NEXT[last] else []
                moves += [(x, 2 + truncated, "R") for x in NEXT[last].replace("s", "")]
            for x, cost, letter in moves:
                after[x] = min(after.get(x, (9**9, "")), (c + cost, e + letter))
        best = after
    best = inserted(best)
    return min(best.get("", (9**9, "")), best.get("a", (9**9, "")))


def repaired(rows, edits):
    out, rows = [], iter(rows)
    for e in edits:
        role = "assistant" if out and out[-1][0][0] == "u" else "user"
        if e == "I":
            out.append((role, ""))
            continue
        row = next(rows)
        if e != "D":
            out.append((row[2] if e == "K" else role, row[3]))
    return out


def expected(original, rows, h):
    out = set()
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), h[r[3]]))
        turns = [r[1] for r in mine if r[1] is not None]
        seen, items, counts = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            blank, again = not text.strip(SPACE), (role, text) in seen
            truncated = not blank and text.rstrip(SPACE)[-1] not in ".!?"
            seen.add((role, text))
            fault = [blank, again, truncated]
            if any(fault):
                counts[fault.index(True)] += 1
            items.append((role[:1], blank or again, truncated))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(items, items[1:], strict=False))
        cost, edits = cheapest(items)
        said = "\n".join(f"{r}:{t}" for r, t in repaired(mine, edits))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.add((conv, gaps, *counts, illegal, cost, edits, hashlib.sha256(said.encode()).hexdigest()))
    return out


def invented(seed, convs=40, turns=14):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randrange(turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unicorn"])
            text = rng.choice(["Yes.", "No!", "yes", " ", "", None, "é?\n", "one.", f"t{turn}.", f"t{turn}.", "cut off"])
            rows.append((conv, rng.choice([turn, turn, turn + 2, turn // 2, None]), role, text))
    return rows


def digests(spark, rows, damaged=True):
    df = spark.createDataFrame(rows, TURNS)
    return {tuple(r) for r in C.repair_digest(C.damaged(df) if damaged else C._rows(df)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_are_the_cheapest_and_least(spark, seed):
    rows = invented(seed)
    after = damage(rows)
    assert digests(spark, rows) == expected(rows, after, hashes(spark, {r[3] for r in after}))


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_meet_as_one(spark, monkeypatch, block):
    """Long conversations over several partitions, cut into blocks of a few rows, with runs of equal rows."""
    rng = random.Random(block)
    kinds = [("user", "a?"), ("assistant", "b."), ("assistant", "c"), ("system", "d."), ("tool", "e"), ("user", ""), ("user", "f.")]
    rows = [(c, i // 3, *kinds[rng.randrange(len(kinds))]) for c in range(3) for i in range(300)]
    rows = [(c, t, r, f"{t % 40}{x}" if x and rng.random() < 0.9 else x) for c, t, r, x in rows]
    rows += [(7, 1, "user", "same.")] * 500 + [(7, 2, "assistant", "same.")]
    monkeypatch.setattr(C, "_blocks", lambda kinds, f=C._blocks: f(kinds, block))
    as_text = [(c, t, r or " ", x or "") for c, t, r, x in rows]
    assert digests(spark, rows, damaged=False) == expected(rows, as_text, hashes(spark, {r[3] for r in as_text}))


def test_repaired_rows_are_those_of_the_edits(spark):
    rows = invented(3)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS + ", copies int, place int")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    h = hashes(spark, {r[3] for r in plain})
    got = {}
    for r in sorted(C.repair(df).collect(), key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {}
    for conv, *_, edits, _ in expected(rows, plain, h):
        mine = sorted((r for r in plain if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), h[r[3]]))
        want[conv] = repaired(mine, edits)
    assert got == {c: t for c, t in want.items() if t}
    for turns in got.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns))


def test_nothing_and_conversations_that_lose_all(spark):
    assert digests(spark, []) == set() and C.repair(spark.createDataFrame([], TURNS)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert digests(spark, [(dropped, 0, "user", "Hi.")]) == {(dropped, 0, 0, 0, 0, 0, 0, "", empty)}
    assert digests(spark, [(1, 1, "user", " ")] * 3, damaged=False) == {(1, 0, 3, 0, 0, 2, 9, "DDD", empty)}


def test_a_text_of_megabytes(spark):
    long = "word " * 400_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "short."), (1, 2, "user", long), (1, 3, "assistant", long + "x")]
    assert digests(spark, rows, damaged=False) == expected(rows, rows, hashes(spark, {r[3] for r in rows}))
