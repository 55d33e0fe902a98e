"""Language, licenses, fingerprints, shards, pages, decontamination and the pipeline."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from albumen.llm import decontaminate, fingerprint, html_extract, langid, licenses, sharding
from pyspark.sql import functions as F
from texts import corpus, sentence


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 3"), (4, "the of and"), (4, "the of and")], "doc_id long, text string").withColumn("score", F.lit("x"))
    out = collections.Counter((r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(odd, model).collect())
    assert out == {(1, "und", True): 1, (2, "und", True): 1, (3, "und", True): 1, (4, "en", False): 2}
    held = {r.doc_id: r.held_out for r in langid.predict(docs, model).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())


def test_language_without_labels(spark, documents):
    docs = documents([(1, "some text")]).withColumn("lang", F.lit(None).cast("string"))
    assert langid.learn(docs) is None
    assert [(r.lang_pred, r.score) for r in langid.predict(docs, None).collect()] == [("und", 0.0)]


def test_license_places(spark, documents):
    rng = random.Random(3)
    phrases = [p for p, _ in licenses.BASE]
    rows = [(i, " ".join(rng.choice([sentence(rng, 3), "Under the MIT License.", "CC BY-NC 4.0", "Apache License, Version 2.0", "apache license", "by nc cc by"]) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "cc by nc"), (202, "cc by nc"), (203, "é under the mit license " * 3)]
    want = []
    for i, t in rows:
        b = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b)
        places = [(j, label) for p, label in licenses.BASE for q in [p.encode().split()] for j in range(len(w) - len(q) + 1) if w[j : j + len(q)] == q]
        at = [j for j, _ in places]
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    got = licenses.scan(documents(rows)).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter(want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(documents([])).count() == 0 and len(phrases) == 3


def test_a_worn_license_is_found(spark, documents):
    text = licenses.TEMPLATES[0][0].split()
    worn = " ".join(text[:12] + ["really"] + text[12:])
    got = licenses.scan(documents([(1, "x y " + worn), (2, " ".join(text[:9]))])).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "mit", 2: ""}


def test_edited_texts(spark, documents):
    rows = [(i, t) for i, t in corpus(6) if t != "twice under one id" and i != 1006] + [(2000, "é" * 9), (2001, "b. a"), (2002, "a b.")]
    got = {r.doc_id: r for r in fingerprint.edited_digest(documents(rows)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        after, q = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[i].fingerprint != got[i].edited_fingerprint or edited == t or not t.strip()
    same = collections.defaultdict(set)
    for i, t in order:
        same[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_one_row_and_repeated_rows(spark, documents):
    one = fingerprint.edited_digest(documents([(1, "abcdefgh")])).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abcdefab").hexdigest()]
    assert fingerprint.edited_digest(documents([(1, "a."), (1, "a."), (2, None)])).count() == 3
    assert fingerprint.edited_digest(documents([])).count() == 0


def test_multisets_add_up(spark):
    def of(text):
        df = spark.createDataFrame([(1, text)], "i int, t string").select("i", F.explode(fingerprint.paragraphs(F.col("t"))).alias("p"))
        return fingerprint.sums(df, ["i"], "p").select(fingerprint.text_form().alias("f")).first().f

    a, b, both, other = of("one.\ntwo."), of("three."), of("three.\ntwo.\none."), of("one. three. two.")
    row = spark.createDataFrame([(a, b, both)], "a string, b string, c string").select(fingerprint.combine(F.col("a"), F.col("b")).alias("sum"), fingerprint.combine(F.col("c"), F.col("b"), -1).alias("rest")).first()
    assert row.sum == both == other and row.rest == a


def counts_and_slots(got, rows, shards=24):
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    counts = collections.Counter(r.shard for r in got)
    assert set(counts) <= set(range(shards)) and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    return counts


def test_parts_of_a_long_text_add_up(spark, documents, monkeypatch):
    rows = [(i, t) for i, t in corpus(6) if i < 100] + [(500, "same line\n" * 70), (501, "\n".join(f"line {i % 9}." for i in range(90)))]
    df = documents(rows).withColumns({"part": F.lit("x"), "v": F.lit(1), "t": F.lit("y"), "bucket": F.lit(2)})
    whole = {r.doc_id: tuple(r) for r in fingerprint.edited_digest(df).collect()}
    monkeypatch.setattr(fingerprint, "PART", 8)
    assert {r.doc_id: tuple(r) for r in fingerprint.edited_digest(df).collect()} == whole


def test_shards(spark, documents):
    rows = corpus(7, 200) + [(5000 + i, "hot text") for i in range(120)]
    got = sharding.shard_rows(documents(rows).withColumn("label", F.lit("x")).withColumn("shard", F.lit(7))).collect()
    counts = counts_and_slots(got, rows)
    places = collections.defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    split = sum(len(p) > 1 for c, p in places.items())
    assert split <= 24 and len(places[zlib.crc32(b"hot text")]) <= -(-120 // min(counts.values())) + 4
    assert sharding.shard_rows(documents([])).count() == 0
    assert sharding.shard_rows(documents([(1, None)])).count() == 1
    odd = [(None, "a"), (None, "a"), (3, None), (4, "")]
    counts_and_slots(sharding.shard_rows(documents(odd)).collect(), odd)


def test_linked_rows_go_where_their_label_is(spark, documents):
    rows = [(i, f"single {i}") for i in range(2160)] + [(3000 + i, f"pair {i // 2}") for i in range(240)]
    df = documents(rows)
    placed = sharding.shard_rows(df)
    got = placed.collect()
    counts_and_slots(got, rows)
    linked = [r for r in got if r.doc_id >= 3000]
    assert all(r.label == r.shard for r in linked) and all(r.label is None for r in got if r.doc_id < 3000)
    spread = collections.Counter(r.shard for r in linked)
    assert len(spread) >= 20 and max(spread.values()) <= 30
    report = sharding.cut_edges(df, placed).first()
    assert report.linked == 120 and report.cut <= 6 < 100 < report.cut_by_hash


def test_more_linked_rows_than_a_shard_holds(spark, documents):
    rows = [(i, f"copy {i % 7}") for i in range(240)]
    df = documents(rows)
    got = sharding.shard_rows(df).collect()
    counts_and_slots(got, rows)
    report = sharding.cut_edges(df, sharding.shard_rows(df)).first()
    assert report.linked == 7 and report.away < report.away_by_hash


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h1>A &amp; B</h1><p>First   <b>bold</b> words, of some length here.<br>More text &lt;here&gt;, and more.<p>Second paragraph, with
words, and marks.<aside>Related links</aside><form><input name=q><button>Go</button></form><ul><li>One<li>Two</ul><div class="ad">Buy!</div><section id="comments"><p>Nice article, I liked it.</p></section></article></main>
<div class="sidebar"><p>Other things, other places.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_pages():
    assert html_extract.main_text(PAGE) == "A & B First bold words, of some length here. More text <here>, and more. Second paragraph, with words, and marks. One Two"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>Menu</nav>") == ""
    assert html_extract.main_text("plain text") == "plain text"
    assert html_extract.main_text("<p>unclosed <b>text") == "unclosed text"
    assert html_extract.main_text("<div><p>" + "word, " * 50_000 + "</p></div>").startswith("word, word,")


STORY = "First sentence of the story, with words. Second one, longer than that, goes on. " * 6


@pytest.mark.parametrize("page", [
    '<div class="with-sidebar"><div class="sidebar">a b c</div><p>{}</p></div>', '<div class="has-header"><p>{}</p></div>', '<div class="post share"><p>{}</p></div>',
    '<div class="legal-content"><p>{}</p></div>', '<div class="related"><p>{}</p></div>', '<form id="f"><div><p>{}</p><ul><li><a>Home page</a><li><a>Other page</a></ul></div></form>',
    '<article><p>{}</p><div class="comments">' + "<p>Nice, I liked it. Really.</p>" * 60 + "</div></article>", "<p title='the hidden truth'>{}", "<head><title>x</title><p>{}",
])
def test_names_do_not_take_the_story_away(page):
    assert html_extract.main_text(page.format(STORY)) == STORY.strip()


def test_odd_markup_takes_no_time():
    for page, want in [("<a " * 20_000, ""), ('<a x="' * 20_000, ""), ("<!--" * 50_000, ""), ("<head>" * 20_000, ""), ("<div>" * 20_000 + "x" + "</div>" * 20_000, "x"), ("a < b and c > d", "a < b and c > d"), ("&am<b>p;</b>", "&amp;")]:
        began = time.time()
        assert html_extract.main_text(page) == want and time.time() - began < 5
    assert len(html_extract.main_text("<div>w" * 50_000)) > 99_000  # the outermost elements are outside the one that holds 90 %


def test_path_ratios_are_those_of_each_path():
    rng = random.Random(9)
    blocks = [(rng.randrange(6), rng.randrange(1, 200), rng.randrange(9)) for _ in range(40)]
    ratio = []
    for path, _, _ in blocks:
        mine = [(n, m) for p, n, m in blocks if p == path]
        ratio.append(sum(n for n, _ in mine) / len(mine) * (1 + sum(m for _, m in mine)) / len(mine))
    near = lambda i: ratio[min(max(i, 0), len(ratio) - 1)]
    want = [(r * (0.25 * near(i - 1) + 0.5 * r + 0.25 * near(i + 1))) ** 0.5 for i, r in enumerate(ratio)]
    got = html_extract.path_ratios(*(np.array(x, float) for x in zip(*blocks, strict=True)))
    assert np.allclose(got, want)


def test_pages_as_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(got[0].text)), (2, 0), (2, 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


ITEM = "Maria bought 12 apples for 3 dollars at the old market and gave 5 of them to her younger brother Paul before noon"


def test_leaks(spark, documents):
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short")], "item_id long, text string")
    renamed = ITEM.replace("12", "40").replace(" 3 ", " 8 ").replace("Paul", "Igor")
    muddled = ITEM.replace("Paul", "Igor").replace("noon", "Paul")
    rows = [(1, f"Some words. {ITEM} more words"), (2, f"Intro text here {renamed}, end"), (3, ITEM[:30]), (4, None), (5, sentence(random.Random(1), 80)), (6, ITEM.upper()), (6, ITEM), (6, ITEM), (10, muddled.upper())]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(documents(rows), bench).collect()}
    assert got[(1, 7)] == "verbatim" and got[(2, 7)] == "reparameterised" and got[(6, 7)] == "verbatim"
    assert {d for d, _ in got} == {1, 2, 6, 10} and got[(10, 7)] == "verbatim"  # 20 words in capitals are a copy
    kept = decontaminate.keep_clean(documents(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.contaminated(documents([]), bench).count() == 0
    assert decontaminate.contaminated(documents(rows), bench.limit(0)).count() == 0


CLASHING = ["tk", "n_words", "size", "first", "last", "said", "win", "pos", "ipos", "diag", "item_id", "kind", "w", "h", "low", "t", "tokens", "score", "labels", "gram", "_gone", "_gone_text", "rejected", "held_out"]


def test_further_columns_may_clash(spark, documents):
    bench = spark.createDataFrame([(7, ITEM), (8, None)], "item_id long, text string")
    docs = documents([(1, f"Some words. {ITEM} more words"), (2, "released under the MIT license"), (3, None), (4, "plain words of no one"), (4, "12 ..")])
    more = docs.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING if c not in docs.columns])
    odd = bench.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING if c not in bench.columns], "'x' AS doc_id")
    rows = lambda df: collections.Counter(map(tuple, df.collect()))
    assert rows(licenses.scan(more)) == rows(licenses.scan(docs))
    found = rows(decontaminate.contaminated(more, odd))
    assert found == rows(decontaminate.contaminated(docs, bench)) and [r[:2] for r in found] == [(1, 7)]
    clean = decontaminate.keep_clean(more, odd)
    assert clean.columns == more.columns and rows(clean) == rows(more.filter("doc_id <> 1"))
    model = langid.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    known = langid.keep_identified(more, model)
    assert known.columns == more.columns and rows(known) == rows(langid.keep_identified(docs, model).selectExpr("*", *[f"'x' AS {c}" for c in CLASHING if c not in docs.columns]))
    assert known.count() == 3


def test_slots_must_agree(spark, documents):
    item = "from 10 to 10 then back from 20 to 10 with the same slow train every single morning"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("10", "7").replace("20", "9")), (2, "from 1 to 2 then back from 3 to 4 with the same slow train every single morning")]
    assert [(r.doc_id, r.kind) for r in decontaminate.contaminated(documents(rows), bench).collect()] == [(1, "reparameterised")]


def test_a_changed_word_leaves_its_runs(spark, documents):
    item = sentence(random.Random(12), 30).split()
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    worn = lambda *at: " ".join("zzz" if i in at else w for i, w in enumerate(item))
    rows = [(i, f"before it {worn(i)} after") for i in range(30)] + [(100, " ".join(item[13:])), (101, worn(11, 23)), (102, worn(10, 20)), (103, " ".join(item[:11]))]
    got = {r.doc_id: r.n_words for r in decontaminate.contaminated(documents(rows), bench).collect()}
    assert got == {**{i: 30 for i in range(30)}, 0: 29, 29: 29, **{i: max(i, 29 - i) for i in [*range(1, 8), *range(22, 29)]}, 100: 17, 101: 23, 102: 30}


def test_verbatim_runs_need_no_slots(spark, documents):
    numbers = "table 4 8 15 16 23 42 then 7 9 11 13 17 19 with 3 5 rows"
    titles = "the Old Man And The Sea By Ernest Hemingway Tells Of Santiago Catching One Giant Marlin"
    twice = "so Paul gave the small red box back to Paul and went home before it rained again"
    items = [(1, numbers), (2, titles), (3, twice), (4, "what is the capital of Norway"), (5, "(...) --"), (6, "Who wrote the ninth book of that long series")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    other = numbers.replace("16", "99").replace("15", "99").replace("13", "98").replace("17", "98")
    rows = [(1, f"see {numbers} there"), (2, f"read {titles} now"), (3, twice.replace("to Paul", "to Paul,")), (4, "Well: What is the capital of Norway? Oslo"), (5, other), (6, "what is the capital of France"), (7, "and Who wrote the ninth book of that long series"), (8, numbers.replace("19", "20").replace("17", "20")), (9, "... -- (...) --")]
    got = {(r.doc_id, r.item_id): (r.n_words, r.coverage, r.kind) for r in decontaminate.contaminated(documents(rows), bench).collect()}
    assert got == {(1, 1): (18, 1, "verbatim"), (2, 2): (16, 1, "verbatim"), (3, 3): (17, 1, "verbatim"), (4, 4): (6, 1, "verbatim"), (7, 6): (9, 1, "verbatim"), (8, 1): (12, 12 / 18, "verbatim")}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken
    from test_pairs_and_repeats import linked, removal, words

    rng = random.Random(8)
    base = [(i, sentence(rng, 40)) for i in range(30)]
    rows = base + [(100, base[3][1]), (101, base[4][1] + " extra"), (102, sentence(rng, 10) + " " + base[5][1] + " " + sentence(rng, 60)), (103, ITEM), (104, None), (105, "123 456"), (106, sentence(rng, 20))]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    docs = {i: t for i, t in rows if t and re.search("[a-z]", t)}
    docs = {i: docs[i] for i, _, root in linked(list(docs.items())) if root == i}
    lost = {i: n for (i, _, n, _), _c in removal(list(docs.items())).items()}
    assert set(got) == {i for i, t in docs.items() if lost[i] < len(words(t))} - {103}
    ranks = {t: i for i, t in enumerate(__import__("albumen.llm.bpe", fromlist=["x"]).read_ranks(None, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        if not lost[i]:
            assert r.n_tokens == len(coder.encode_ordinary(docs[i]))
    assert lost[102] > 0 and 102 in got
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "decontamination", "byte_bpe"]
