"""N-gram join and substring removal against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from albumen.llm import ngram_join, substring_dedup
from pyspark.sql import functions as F
from texts import corpus, sentence

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(t, lower=False):
    b = (t or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", b.translate(LOWER) if lower else b)


def shingles(t, k=5):
    w = words(t, True)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def linked(rows):
    """For each row its set's size and the least id of the rows that links lead to."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x + 1, len(sets)):
            if a and sets[y] and 100 * len(a & sets[y]) >= 75 * len(a | sets[y]):
                root[find(y)] = find(x)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), i), i)
    return [(i, len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(rows)]


def near_copies(seed, n=120):
    """A base text, near copies of it with more and more changed words, and copies of those."""
    rng = random.Random(seed)
    base = sentence(rng, 70).split()
    out = [(3000, " ".join(base))]
    for i in range(1, n):
        w = (base if i % 3 else rng.choice(out)[1].split())[:]
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"own{rng.randrange(40)}"
        out.append((3000 + i, " ".join(w)))
    return out


def components(spark, documents, rows):
    got = ngram_join.similarity_components(documents(rows)).collect()
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, documents, seed):
    rows = corpus(seed) + near_copies(seed)
    assert components(spark, documents, rows) == collections.Counter(linked(rows))


@pytest.mark.parametrize("rounds", [0, 2])
def test_components_with_leaders_are_the_same(spark, documents, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_POST", -1)
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "FRUITFUL", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 1)
    rows = corpus(3) + near_copies(3)
    assert components(spark, documents, rows) == collections.Counter(linked(rows))


def test_bitmaps_bound_overlaps_in_a_test_short_enough_to_compile(spark):
    rng = random.Random(8)
    whole = [rng.getrandbits(64) for _ in range(60)]
    sets = [np.array(sorted(rng.sample(whole, rng.randrange(1, 60)) + [rng.getrandbits(64) for _ in range(rng.randrange(20))]), np.uint64) for _ in range(60)]
    bits = ngram_join._bitmaps(np.repeat(np.arange(60), [len(g) for g in sets]), np.concatenate(sets), 60)
    rows = [(i, len(g), *[column[i].as_py() for column in bits]) for i, g in enumerate(sets)]
    marked = spark.createDataFrame(rows, ["class", "n", *ngram_join._BITMAP]).select("class", "n", *ngram_join._marked())
    side = lambda x: marked.select(*[F.col(c).alias(f"{c}_{x}") for c in marked.columns])
    pairs = side("a").crossJoin(side("b")).filter("class_a < class_b")
    kept = pairs.filter(ngram_join._may_overlap(75))
    got = {(r.class_a, r.class_b) for r in kept.select("class_a", "class_b").collect()}

    def bound(i, j):
        a, b = ({int(g) >> 20 & 2047 for g in sets[x]} for x in (i, j))
        return min(len(sets[i]) - len(a - b), len(sets[j]) - len(b - a))

    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if 175 * bound(i, j) >= 75 * (len(sets[i]) + len(sets[j]))}
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))}
    assert links and links <= got and len(got) < 60 * 59 // 2
    assert str(ngram_join._may_overlap(75)).lower().count("bit_count") <= 1  # it was 2 * LONGS: a method that the JVM does not compile


def test_ids_that_are_null_or_shared_by_texts(spark, documents):
    rng = random.Random(4)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(1, a), (1, b), (2, b + " end"), (None, c), (5, c + " end"), (None, a)]
    got = components(spark, documents, rows)
    assert got == {(1, 36, 1): 2, (2, 37, 1): 1, (None, 36, 5): 1, (5, 37, 5): 1, (None, 36, 1): 1}


def test_a_text_of_megabytes(spark, documents):
    rng = random.Random(5)
    long = [sentence(rng, 50) for _ in range(20_000)]
    rows = [(1, "\n".join(long)), (2, "\n".join(long[:-100])), (3, "\n".join(long[:9_000])), (4, "word " * 300_000)]
    got = ngram_join.similarity_components(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4} and [r.n_shingles for r in got if r.doc_id == 4] == [1]


def test_components_of_nothing(spark, documents):
    assert ngram_join.similarity_components(documents([])).count() == 0
    got = ngram_join.similarity_components(documents([(4, None), (2, "")]).withColumnRenamed("source", "class").withColumnRenamed("lang", "n")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(4, 0, 4), (2, 0, 2)}


def test_keep_one_keeps_columns(spark, documents):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y"), (4, None), (5, None)]
    df = documents(rows)
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]


def removal(rows, n=13):
    first = {}
    for i, t in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_removal_is_that_of_all_windows(spark, documents, batches):
    rows = corpus(batches)
    got = substring_dedup.removal_digest(documents(rows), batches=batches).collect()
    assert collections.Counter(tuple(r) for r in got) == removal(rows)


def test_removal_without_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", 0)
    rows = corpus(9)
    assert collections.Counter(tuple(r) for r in substring_dedup.removal_digest(documents(rows)).collect()) == removal(rows)


def test_texts_under_one_id_are_judged_each(spark, documents):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b)]
    df = documents(rows).withColumns({"_id": F.lit("x"), "_kept": F.lit("y"), "print": F.lit(1), "k": F.lit(2)})
    assert collections.Counter(tuple(r) for r in substring_dedup.removal_digest(df).collect()) == removal(rows)
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.text, r._id, r._kept, r.k) for r in out.collect()) == [(1, a, "x", "y", 2), (2, b, "x", "y", 2)]


def test_a_kept_index_takes_more_batches(spark, documents, tmp_path, monkeypatch):
    rows = sorted((r for r in corpus(11) if r[1]), key=lambda r: r[0])
    parts = [[r for r in rows if lo <= r[0] < hi] for lo, hi in ((0, 60), (60, 120), (120, 160), (160, 2000))]
    index, seen, got = substring_dedup.WindowIndex(spark, f"file://{tmp_path}/index", buckets=3), [], collections.Counter()
    for part in parts:
        batch = substring_dedup._keys(documents(part))
        gone, copies = index.add(batch, documents(seen))
        got += collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.marked(batch, gone, copies, 13, False).collect())
        seen += part
        assert all(len(names) <= substring_dedup.MAX_RUNS for names in index.runs.values())
        index = substring_dedup.WindowIndex.open(spark, index.save())
    assert got == removal(rows)
    assert len(list((tmp_path / "index").glob("run_*"))) == sum(map(len, index.runs.values()))
    index.close()


def test_removal_compacts_on_its_way(spark, documents, monkeypatch):
    made = []
    monkeypatch.setattr(substring_dedup.WindowIndex, "close", lambda self, close=substring_dedup.WindowIndex.close: (made.append(self.compactions), close(self)))
    substring_dedup.removal_digest(documents(corpus(1)))
    assert made == [3] and not [t for t in spark.catalog.listTables() if t.name.startswith("albumen")]


def test_removal_of_nothing(spark, documents):
    assert substring_dedup.removal_digest(documents([])).count() == 0
    assert substring_dedup.remove_repeats(documents([])).count() == 0


def test_removal_in_a_text_of_megabytes(spark, documents):
    rng = random.Random(6)
    passage, filler = sentence(rng, 60), " ".join(f"n{i}" for i in range(400_000))
    rows = [(1, passage), (2, f"{filler} {passage} {filler}"), (3, "same " * 200_000), (None, passage)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.removal_digest(documents(rows)).collect()}
    assert got == {1: (60, 0), 2: (800_060, 60), 3: (200_000, 0), None: (60, 0)}


def test_remove_repeats_keeps_clean_rows(spark, documents):
    passage = " ".join(f"w{i}" for i in range(20))
    df = documents([(1, passage), (2, f"before  it\n{passage} after"), (3, passage), (4, "clean  text"), (5, None)])
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    assert out == {1: passage, 2: "before it after", 4: "clean  text", 5: None}
