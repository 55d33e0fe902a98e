"""Streams give what one batch gives."""

import datetime as dt
import random

import pytest
from albumen.sources.media import list_media
from albumen.streaming import watch as W
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data)


def test_ingest_in_steps(spark, tmp_path):
    inbox, lib, ck = tmp_path / "in", f"{tmp_path}/lib", f"{tmp_path}/ck"
    put(inbox / "a", "1.jpg", b"one")
    put(inbox / "a", "2.txt", b"no picture")
    put(inbox / "b", "copy.JPG", b"one")
    seen = []
    step = lambda: W.watch_ingest(W.watched_files(spark, str(inbox)), lib, ck, after=lambda df, i: seen.append(df.count())).awaitTermination()
    step()
    put(inbox / "b", "3.mp4", b"three")
    put(inbox / "b", "4.cr2", b"one")
    step()
    step()
    got = spark.read.parquet(lib).collect()
    assert sorted(r.media_type for r in got) == ["image", "video"] and len({r.hash for r in got}) == 2 and sum(seen) == 2
    assert list_media(spark, str(inbox)).count() == 4


def test_debounce(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [("a", t), ("a", t + dt.timedelta(seconds=2)), ("b", t)]
    spark.createDataFrame(rows, "path string, ts timestamp").write.parquet(f"{tmp_path}/ev")
    events = spark.readStream.schema("path string, ts timestamp").parquet(f"{tmp_path}/ev")
    q = W.debounce(events).writeStream.format("memory").queryName("calm").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.path for r in spark.table("calm").collect()) == ["a", "b"]


def test_a_changed_file_is_taken_as_it_was_last(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    row = lambda path, s, h: (f"/p/{path}.jpg", 10 + s, t + dt.timedelta(seconds=s), h, "image")
    schema = "path string, length long, modificationTime timestamp, hash string, media_type string"
    steps = [[row("a", 0, "half"), row("b", 1, "b")], [row("a", 4, "more"), row("a", 8, "whole"), row("a", 8, "whole"), (None, 1, t, "n", "image")], [row("later", 600, "l")], [row("b", 3, "late")]]
    for events in steps:
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ev")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/ev")
        W.watch_ingest(W.settled(stream), f"{tmp_path}/lib", f"{tmp_path}/ck").awaitTermination()
    got = {r.path: (r.hash, r.length) for r in spark.read.parquet(f"{tmp_path}/lib").filter("path IS NOT NULL").collect()}
    assert got == {"/p/a.jpg": ("whole", 18), "/p/b.jpg": ("b", 11)}


def test_a_scan_goes_on_after_a_failure(spark, tmp_path):
    inbox, lib, ck, done = tmp_path / "in", f"{tmp_path}/lib", f"{tmp_path}/ck", f"{tmp_path}/done"
    for i in range(6):
        put(inbox / ("a" if i < 4 else "b"), f"{i}.jpg", b"x" * (i + 1))
    scan = lambda after: W.watch_ingest(W.watched_files(spark, str(inbox), max_files=3), lib, ck, after=after, progress_path=done)

    def fail(new, batch_id):  # written, not yet committed
        raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        scan(fail).awaitTermination()
    assert spark.read.parquet(lib).count() == 3
    added = []
    scan(lambda new, i: added.append((i, new.count()))).awaitTermination()
    assert added == [(0, 0), (1, 3)]
    assert sorted(r.length for r in spark.read.parquet(lib).collect()) == [1, 2, 3, 4, 5, 6]
    got = {r.folder.rsplit("/", 1)[1]: (r.files, r.bytes) for r in W.scan_progress(spark, done).collect()}
    assert got == {"a": (4, 10), "b": (2, 11)}


def test_state_and_queue(spark):
    t = dt.datetime(2024, 1, 1)
    added = spark.createDataFrame([("/p/x/1.jpg", t), ("/q/2.jpg", t)], "path string, modificationTime timestamp")
    watch = spark.createDataFrame([("/p", None, True), ("/q", None, False)], "path string, last_checked timestamp, auto_tag boolean")
    assert [r.path for r in W.auto_tag_queue(added, watch).collect()] == ["/p/x/1.jpg"]
    assert all(r.last_checked == t for r in W.watch_state(watch.select("path", "last_checked"), added).collect())


def test_changes_merge(spark, tmp_path):
    schema = "kind string, photo_hash string, tag string, value string, updated_at long, by_device string, deleted boolean"
    a = [("tag", "h", "t", "1", 5, "d1", False), ("tag", "h", "u", "1", 1, "d1", False)]
    b = [("tag", "h", "t", "2", 5, "d2", True), ("tag", "h", "u", "0", 0, "d2", False)]
    spark.createDataFrame(a, schema).coalesce(1).write.parquet(f"{tmp_path}/f")
    stream = lambda: W.merge_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/f"), f"{tmp_path}/s", f"{tmp_path}/ck").awaitTermination()
    stream()
    spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
    stream()
    state = W.merged_state(spark, schema, f"{tmp_path}/s")
    batch = W.merge_changes(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in batch.collect()}
    assert [r.tag for r in W.live(state).collect()] == ["u"]
    assert W.changes_since(state, 1).count() == 1 and F is not None


def test_merging_rewrites_only_touched_buckets(spark, tmp_path):
    """Many batches, late and repeated rows, and a batch that is run again: the state is that of one batch over all."""
    schema = "kind string, photo_hash string, tag string, value string, updated_at long, by_device string, deleted boolean"
    rng = random.Random(1)
    rows = [("tag", f"h{i}", "t", "first", 1, "d0", False) for i in range(300)]
    batches = [rows] + [[("tag", f"h{rng.randrange(300)}", "t", f"v{b}", rng.randrange(9), f"d{b}", rng.random() < 0.2)] * 2 for b in range(5)]
    folder, state = f"{tmp_path}/f", f"{tmp_path}/s"
    stream = lambda ck: W.merge_stream(spark.readStream.schema(schema).parquet(folder), state, f"{tmp_path}/{ck}", 16).awaitTermination()
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream("ck")
    whole = W.merge_changes(spark.createDataFrame([], schema), spark.createDataFrame([r for b in batches for r in b], schema))
    want = {tuple(r) for r in whole.collect()}
    assert {tuple(r) for r in W.merged_state(spark, schema, state).collect()} == want
    written = [sorted(p.name for p in (tmp_path / "s" / f"v{b}").glob("bucket=*")) for b in range(len(batches))]
    assert all(len(w) <= 1 for w in written[1:])
    for name in ("offsets", "commits"):  # as if the last batch had been written and not committed
        if name == "commits":
            (tmp_path / "ck" / name / str(len(batches) - 1)).unlink()
    for crc in (tmp_path / "ck" / "commits").glob(".*.crc"):
        crc.unlink()
    stream("ck")
    assert {tuple(r) for r in W.merged_state(spark, schema, state).collect()} == want
    state_rows = W.merged_state(spark, schema, state)
    seen, cursor = [], -1
    while page := W.changes_since(state_rows, cursor, ["tag"], 40).collect():
        seen += page
        cursor = W.next_cursor(spark.createDataFrame(page, schema), cursor).first().next_cursor
    assert len(seen) == len(want) and W.changes_since(state_rows, -1, ["other"]).count() == 0
