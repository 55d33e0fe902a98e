"""Benchmark decontamination against a plain matcher, and the changes that copies come with."""

import itertools
import random
import time

import regex
from albumen.llm import decontaminate as D
from texts import sentence

NAMES = ["Maria", "Paul", "Igor", "Anna", "Rome", "Paris"]
MARKS = r"[^\p{L}\p{N}%$€£°]+"


def tokens(text):
    raw = [w for w in regex.split(r"[\x20\x09-\x0D]+", text or "") if w]
    out = []
    for before, w in zip(["."] + raw, raw):
        low = regex.sub(f"^{MARKS}|{MARKS}$", "", w).lower()
        if not low:
            continue
        if regex.search("[0-9]", w):
            t = "<num>"
        elif low in D.UNITS:
            t = "<unit>"
        elif regex.search(r"^\P{L}*\p{Lu}\p{Ll}+\P{L}*$", w) and not regex.search(r"[.!?:]\P{L}*$", before):
            t = "<name>"
        else:
            t = low
        out.append((low, t))
    return out


def longest(flags, counts):
    best, start = (0, 0), 0
    for i, f in enumerate([*flags, False]):
        if not f:
            if i - start > best[0]:
                best = (i - start, sum(counts[start:i]))
            start = i + 1
    return best


def plain_match(doc, item):
    """(n_words, verbatim) of each accepted run of one item in one document."""
    d, b, found = tokens(doc), tokens(item), []
    n, least, held = len(b), min(12, len(b)), D.PLACEHOLDERS
    if 0 < n <= 12 and any([x[0] for x in d[i : i + n]] == [x[0] for x in b] for i in range(len(d) - n + 1)):
        found.append((n, True))
    def forms(x):
        kinds = [t for _, t in x]
        free = sum(t not in held for t in kinds)
        return {tuple(w for w, _ in x)} | ({tuple(kinds)} if 8 > free >= 3 else set())

    mine = [forms(b[i : i + 8]) for i in range(n - 7)]
    diagonals = {}
    for j in range(len(d) - 7):
        here = forms(d[j : j + 8])
        for i, other in enumerate(mine):
            if here & other:
                diagonals.setdefault(j - i, []).append(i)
    for diag, hits in diagonals.items():
        runs = []
        for i in hits:
            if runs and i - runs[-1][1] <= 8:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        first, last = runs[0][0], runs[-1][1]
        if len(runs) > 1 and 4 * sum(y - x + 8 for x, y in runs) >= 3 * (last - first + 8):
            runs.append([first, last])
        for x, y in runs:
            size = y - x + 8
            if size < least:
                continue
            pair = list(zip(d[x + diag : x + diag + size], b[x : x + size]))
            slot = [(bt, bl, dl) if bt == dt and bt in held else None for (dl, dt), (bl, bt) in pair]
            slots = {s for s in slot if s}
            clash = {s for s in slots if any(o[0] == s[0] and (o[1] == s[1]) != (o[2] == s[2]) for o in slots)}
            steady = longest([s not in clash for s in slot], [bt not in held for _, (_, bt) in pair])
            stretch = longest([dl == bl for (dl, _), (bl, _) in pair], [0] * size)[0]
            whole = steady[0] >= least and 2 * steady[1] >= steady[0]
            if whole:
                found.append((max(steady[0], stretch), all(s[1] == s[2] for s in slots)))
            elif stretch >= least:
                found.append((stretch, True))
    return max(found, default=None, key=lambda f: f[0])


def question(rng, n):
    word = lambda: rng.choice([sentence(rng, 1)] * 6 + NAMES[:2] + [str(rng.randrange(40)), "km"])
    return " ".join(word() for _ in range(n))


def altered(rng, text):
    w = text.split()
    how = rng.randrange(8)
    if how == 0:
        return text.lower()
    if how == 1:
        return text.upper()
    if how == 2:
        return text.title()
    if how == 3:
        return " - ".join(w)
    if how == 4:
        return " ".join(str(rng.randrange(90)) if x.isdigit() else rng.choice(NAMES) if x in NAMES else x for x in w)
    if how == 5:
        w[rng.randrange(len(w))] = "zzz"
        return " ".join(w)
    if how == 6:
        return " ".join(f'"{x}",' if rng.random() < 0.3 else x for x in w)
    return " ".join(w[: rng.randrange(len(w))])


def bench_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS tokens")


def test_equals_a_plain_matcher(spark, documents):
    rng = random.Random(5)
    items = [(i, question(rng, rng.choice([3, 9, 12, 14, 22, 40]))) for i in range(30)]
    rows = [(None, items[4][1]), (1000, None), (1001, ""), (1002, "- * |"), (1003, items[5][1]), (1003, items[5][1])]
    rows += [(i, " ".join([question(rng, rng.randrange(12)), altered(rng, rng.choice(items)[1]), question(rng, rng.randrange(12))])) for i in range(150)]
    got = {(r.doc_id, r.item_id): (r.n_words, r.kind == "verbatim") for r in D.contaminated(documents(rows).selectExpr("*", "0 AS tk", "'x' AS win"), bench_of(spark, items)).collect()}
    want = {(d, i): m for (d, t), (i, b) in itertools.product(rows, items) if (m := plain_match(t, b))}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 60
    assert sum(got[k][1] != want[k][1] for k in want) <= len(want) // 20  # of runs of one length either may tell the kind


def test_copies_in_another_case_and_with_marks(spark, documents):
    short = "Later Maria told Paul that the small red Fiat of Igor was gone"
    long = "Yesterday Maria met Paul near the big Louvre and then Igor gave Anna six books about old Rome and some Paris maps"
    copies = [f(t) for t in (short, long) for f in (str, str.lower, str.upper, str.title, lambda t: " - ".join(t.split()), lambda t: "\n* ".join(t.split()))]
    got = {r.doc_id for r in D.contaminated(documents(list(enumerate(f"so it was {t} in the end" for t in copies))), bench_of(spark, [(1, short), (2, long)])).collect()}
    assert got == set(range(len(copies)))


def test_number_tables_end(spark, documents):
    rng = random.Random(6)
    digits = lambda n: " ".join(str(rng.randrange(1000)) for _ in range(n))
    item = digits(20)
    rows = [(1, digits(10000)), (2, f"{digits(5000)} {item} {digits(5000)}"), (3, " ".join(["7"] * 5000))]
    start = time.time()
    got = {(r.doc_id, r.item_id): r.n_words for r in D.contaminated(documents(rows), bench_of(spark, [(1, item), (2, " ".join(["7"] * 20))])).collect()}
    assert got == {(2, 1): 20, (3, 2): 20} and time.time() - start < 60


def test_a_text_of_megabytes(spark, documents):
    rng = random.Random(9)
    item = question(rng, 30)
    text = f"{sentence(rng, 150000)} {item.upper()} {sentence(rng, 150000)}"
    got = D.contaminated(documents([(1, text), (2, sentence(rng, 50))]), bench_of(spark, [(1, item)])).collect()
    assert [(r.doc_id, r.n_words) for r in got] == [(1, 30)]


def test_kept_rows_keep_their_columns(spark, documents):
    rng = random.Random(10)
    item = question(rng, 20)
    docs = documents([(1, item.lower()), (1, "another text under the id"), (None, item.upper()), (2, None), (3, "")]).selectExpr("*", "7 AS item_id", "'x' AS _gone", "0 AS tk")
    kept = D.keep_clean(docs, bench_of(spark, [(1, item), (2, None), (3, "")]))
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "another text under the id"), (2, ""), (3, "")]


def test_windows_without_the_benchmarks_pairs_are_not_made(spark):
    item = "how many red plates of 12 cm does Anna need to fill the two shelves"
    texts = [(1, "quite another story that shares no pair of words with it at all"), (2, f"so then {item} and no more")]
    hashed = lambda rows: D._hashed(D._tokens(spark.createDataFrame(rows, "id long, text string"), "text", "id"), "id")
    seen = D._seen_pairs(hashed([(0, item)]).withColumnRenamed("id", "item_id"))
    made = D._with_met(hashed(texts), seen).select("id", D.F.size(D._windows(True)).alias("some"), D.F.size(D._windows()).alias("every"))
    got = {r.id: (r.some, r.every) for r in made.collect()}
    assert got[1][0] == 0 < got[1][1] and 0 < got[2][0] < got[2][1]
