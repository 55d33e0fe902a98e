"""Collocations against a count of all phrases in plain Python."""

import collections
import random
import re

import pytest
from albumen.llm import collocations
from texts import WORDS, sentence

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain(rows, top, least, covers=50):
    """Every phrase counted, scored and ranked: the expected rows."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    candidates = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    most = collections.Counter()
    for (lang, p), c in candidates.items():
        if len(p) == 3:
            for part in (p[:2], p[1:]):
                most[lang, part] = max(most[lang, part], c)
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if len(p) == 2 and (lang, p) in most and 100 * most[lang, p] >= covers * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, b" ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, left, right) in enumerate(sorted(ps)[:top])}


def found(spark, rows, **how):
    return {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), **how).collect()}


def invented(seed):
    """Texts of few words, with set phrases, in three languages, one of them null."""
    rng = random.Random(seed)
    phrases = [sentence(rng, rng.choice([2, 2, 3, 4])) for _ in range(60)]
    rows = []
    for i in range(120):
        parts = [rng.choice(phrases) if rng.random() < 0.6 else sentence(rng, rng.randrange(1, 4)) for _ in range(rng.randrange(30))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for p in parts)
        rows.append((text.title() if i % 5 == 0 else text, ["en", "ß~", None][i % 3]))
    return rows


@pytest.mark.parametrize(("seed", "top", "least"), [(1, 2000, 3), (2, 15, 2), (3, 4, 2)])
def test_lists_are_those_of_all_phrases(spark, seed, top, least):
    rows = invented(seed)
    assert found(spark, rows, top=top, least=least) == plain(rows, top, least)


def test_the_frontier_is_lowered_until_the_list_is_full(spark, monkeypatch):
    """Nearly every good pair lies in a triple as frequent, so the first frontier holds too few survivors."""
    rng = random.Random(5)
    rows = [(". ".join(f"a{i} b{i} c{i}" for i in range(40)), "en")] * 3 + [(". ".join(f"{rng.choice(WORDS)} {rng.choice(WORDS)}" for _ in range(2500)), "en")]
    asked = []
    count = collocations._count
    monkeypatch.setattr(collocations, "_count", lambda docs, k, **filters: asked.append(k) or count(docs, k, **filters))
    assert found(spark, rows, top=60, least=2) == plain(rows, 60, 2)
    assert asked.count(3) > 1


def test_filters_full_of_strangers_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    rows = invented(4)
    assert found(spark, rows, top=20, least=2) == plain(rows, 20, 2)


def test_odd_rows(spark):
    long = "lo Mi nu. " * 150_000
    rows = [(None, "en"), ("", "en"), (" \t.,;\n", "en"), ("One two one two", "en"), ("one two", "en"), (long, "xx"), (None, None), ("Été été x Été été x", None)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, phrase int, f int, floor int")
    got = {tuple(r) for r in collocations.collocations(df, least=2).collect()}
    assert got == plain(rows, 2000, 2) and ("xx", 1, "lo mi nu", 150_000, 150_000, 150_000, 450_000, 1_000_000) in got
    assert collocations.collocations(df.limit(0)).collect() == []
    assert collocations.collocations(df.filter("lang = 'en'"), least=10).collect() == []


def test_scores_past_64_bits(spark):
    row = spark.range(1).selectExpr("4000000000000 a", "4000000000001 l", "4999999999999 r").select(collocations._score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * 4_000_000_000_000**2 // (4_000_000_000_001 * 4_999_999_999_999)
