"""Source mixing against the same rules in plain Python."""

import collections
import hashlib
import math
import random
import re

import pytest
from albumen.llm import mixing

DOCS = "doc_id long, text string, source string"


def plain(rows, weights=(1, 2, 3), most=3):
    size = [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for _, t, _ in rows]
    by = collections.defaultdict(list)
    for i, (_, _, source) in enumerate(rows):
        by[source].append(i)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole = {s: sum(size[i] for i in by[s]) for s in names}
    capped = set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        level = (sum(size) - sum(most * whole[s] for s in capped)) / free if free else 0
        more = {s for s in names if s not in capped and most * whole[s] < weight[s] * level}
        if not more:
            break
        capped |= more
    out = collections.Counter()
    for s in names:
        target = float(most * whole[s]) if s in capped else weight[s] * level
        rate = target / whole[s] if whole[s] else 0.0
        order = sorted(by[s], key=lambda i: (size[i].bit_length() or 1, hashlib.md5(b"" if rows[i][0] is None else str(rows[i][0]).encode()).hexdigest(), size[i]))

        def taken(u, rate=rate, order=order):
            return [size[i] * (math.floor(rate * (n + 1) + u) - math.floor(rate * n + u)) for n, i in enumerate(order)]

        offsets = [int(hashlib.md5(f"0:{j}:{'' if s is None else '=' + s}".encode()).hexdigest()[:8], 16) / 4294967296 for j in range(mixing.OFFSETS)]
        best = min(offsets, key=lambda u: abs(sum(taken(u)) - target))
        for i, t in zip(order, taken(best), strict=True):
            out[rows[i][0], size[i], whole[s], target, t] += 1
    return out


def invented(seed, n=400):
    rng = random.Random(seed)
    names = ["a", "b", "é", "Z", "", "tiny", None, "empty", *"xyz"]
    rows = []
    for i in range(n):
        source = rng.choice(names) if rng.random() < 0.6 else "b"
        words = {"tiny": 1, "empty": 0}.get(source, rng.choice([0, 1, 3, 20, 40, 300]))
        rows.append((rng.choice([i, i, i // 2, None]), " \t\nw" * words if words else rng.choice([None, "", " \n"]), source))
    return rows + rows[:30]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_is_that_of_the_rules(spark, seed):
    rows = invented(seed)
    got = collections.Counter(tuple(r)[:5] for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect())
    assert got == plain(rows)


def test_targets_are_met_and_reruns_agree(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.choice([1, 10, 50, 200]), f"s{i % 5 if i % 3 else 0}") for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    one = mixing.mix(df).collect()
    two = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    words = collections.Counter()
    for r in one:
        words[r.source_size, r.target] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(t - target) <= 200 for (_, target), t in words.items()) and abs(sum(words.values()) - sum(r.size for r in one)) <= 1000


def test_mixed_rows_and_odd_tables(spark):
    rows = invented(4)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", size int, place int")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = collections.Counter()
    for (i, size, _, _, t), n in plain(rows).items():
        if size:
            want[i, size] += n * t // size
    got = collections.Counter((r.doc_id, len(r.text.split())) for r in out.collect() if r.text and r.text.split())
    assert got == +want
    assert mixing.mix(df.limit(0)).collect() == []
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, None, None)], DOCS)).collect()] == [(1, 0, 0, 0.0, 0, 0)]
    long = mixing.mix(spark.createDataFrame([(1, "w " * 1_000_000, "a"), (2, "v", "b")], DOCS)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in long) == [(1, 1_000_000, 1_000_000), (2, 1, 3)]
