"""Tags alike but for case: how many rows a task orders."""

from albumen.operators import ranking


def test_tasks_grow_in_number_and_not_in_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_A_TASK", 10, raising=False)
    n = 10 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 500
    rows = [(i // 3, ("sea", "Sea", "SEA")[i % 3] + str(i // 9), i) for i in range(n)] + [(None, "sea", 1), (None, "SEA", 2), (1, None, 3), (1, "", 4)]
    found = ranking.dedupe_tags_by_case(spark.createDataFrame(rows, "photo_id long, tag string, tag_id long"))
    assert found.columns == ["photo_id", "tag", "tag_id"]
    assert found.rdd.getNumPartitions() >= -(-len(rows) // 10)
    want = {}
    for photo, tag, at in rows:
        rank = (0 if (tag or "")[:1] != (tag or "")[:1].lower() else 1, at)
        key = (photo, tag and tag.lower())
        want[key] = min(want.get(key, (rank, None)), (rank, (photo, tag, at)), key=lambda x: (x[0], x[1] is None))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((v for _, v in want.values()), key=str)
