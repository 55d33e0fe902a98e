"""Kept postings: batches in turn give what one run over all gives, and searches read the files of their words."""

import random

import pytest
from albumen.operators import search as H
from albumen.operators.postings import Postings, keep_postings
from pyspark.sql import functions as F

WORDS = ["sun", "sunset", "sea", "Über", "uber", "mountain", "mole", "7up", "日本", "red"]


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc long, text string")


def table(spark, rows):
    return H.token_table(texts(spark, rows), "doc", "text", "text")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def asked(spark, *said):
    return spark.createDataFrame(list(enumerate(said)), "query_id long, text string")


def test_batches_are_as_one_run(spark, tmp_path):
    rng = random.Random(5)
    say = lambda: " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))
    kept, now = Postings(spark, str(tmp_path / "p")), {}
    for version in range(5):
        new = {rng.randrange(40): say() for _ in range(15)} | ({99: None} if version == 2 else {})
        gone = [d for d in rng.sample(range(40), 4) if d not in new]
        for _ in range(1 + (version == 3)):  # one version comes twice
            kept.add(version, table(spark, list(new.items())), texts(spark, [(d, "") for d in [*gone, *new]]))
        now = {d: t for d, t in now.items() if d not in gone} | new
        if version == 1:
            kept.compact()
            kept.compact()
            kept.add(1, table(spark, [(1, "again")]))  # is in the base already
        whole = table(spark, list(now.items()))
        assert same(kept.read(), whole)
    for prefix in (False, True):
        words = asked(spark, "sun", "se mo", "UBER 日", "nowhere", "")
        for find in (H.search_all_words, H.search_any_word):
            assert same(find(kept.read(words, prefix), words, ["doc"], prefix=prefix), find(whole, words, ["doc"], prefix=prefix))
    many = asked(spark, " ".join(f"w{i}" for i in range(100)), "sun")
    assert same(H.search_any_word(kept.read(many), many, ["doc"]), H.search_any_word(whole, many, ["doc"]))
    with pytest.raises(ValueError, match="after"):
        kept.add(2, whole)


def test_empty_and_odd_rows(spark, tmp_path):
    kept = Postings(spark, str(tmp_path / "p"))
    assert kept.read().count() == 0 and kept.read(asked(spark, "sun")).count() == 0
    kept.compact()
    kept.add(0)
    kept.add(1, table(spark, [(None, "sun"), (1, None), (2, ""), (3, "sun sun"), (3, "sun")]), texts(spark, [(None, "")]))
    assert sorted(kept.read().select("doc", "pos", "token").collect()) == [(3, 0, "sun"), (3, 0, "sun"), (3, 1, "sun")]
    kept.add(2, gone=texts(spark, [(3, ""), (77, "")]))
    kept.compact()
    assert kept.read().count() == 0


def test_a_version_that_broke_off_does_not_count(spark, tmp_path):
    kept = Postings(spark, str(tmp_path / "p"))
    kept.add(0, table(spark, [(1, "sun"), (2, "sea")]))
    bad = table(spark, [(1, "moon")]).withColumn("token", F.expr("assert_true(false) || token"))
    with pytest.raises(Exception):  # noqa: B017
        kept.add(1, bad, texts(spark, [(1, "")]))
    assert {tuple(r) for r in kept.read().select("doc", "token").collect()} == {(1, "sun"), (2, "sea")}
    kept.add(1, table(spark, [(1, "moon")]), texts(spark, [(1, "")]))
    assert {tuple(r) for r in kept.read().select("doc", "token").collect()} == {(1, "moon"), (2, "sea")}


def _scanned(df):
    """Files that the scans of df read."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        found = [leaves.apply(i).metrics() for i in range(leaves.size())]
        return sum(m.apply("numFiles").value() for m in found if m.contains("numFiles"))
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_searches_read_the_files_of_their_words(spark, tmp_path):
    kept = Postings(spark, str(tmp_path / "p"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    kept.add(0, table(spark, [(i, " ".join(f"{c}{i}" for c in letters)) for i in range(50)]))
    every = _scanned(kept.read())
    words = asked(spark, "s1")
    assert every >= 10 and _scanned(kept.read(words, prefix=True)) <= 3
    assert kept.read(words, prefix=True).count() == 11 and kept.read(words).count() == 1
    plan = kept.read(words, prefix=True)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,s1)" in plan


def test_a_stream_keeps_the_last_text(spark, tmp_path):
    schema, folder = "doc long, text string, deleted boolean, at long", str(tmp_path / "in")
    kept = Postings(spark, str(tmp_path / "p"))
    for rows in (
        [(1, "sun", False, 1), (1, "sea", False, 2), (2, "red", False, 1), (3, "red", False, 1), (3, None, True, 1), (None, "x", False, 1)],
        [(2, None, True, 5), (4, "mole", False, 5)],
        [(4, "mole red", False, 6), (5, "", False, 1)],
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        keep_postings(spark.readStream.schema(schema).parquet(folder), kept, "text", str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, kept.read().select("doc", "token").collect())) == [(1, "sea"), (3, "red"), (4, "mole"), (4, "red")]


def test_starts_of_words_keep_letters_of_their_own(spark, tmp_path):
    kept = Postings(spark, str(tmp_path / "p"))
    kept.add(0, table(spark, [(1, "über ßchberin"), (2, "Schbérin"), (3, "ßchberin")]))
    words = asked(spark, "schber", "ßch")
    got = H.search_any_word(kept.read(words, prefix=True), words, ["doc"], prefix=True).collect()
    assert {(r.query_id, r.doc) for r in got} == {(0, 2), (1, 1), (1, 3)}
