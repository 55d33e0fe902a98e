"""Kernels and operators without SQL against brute force, and edge rules."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from albumen.functions import text as X
from albumen.functions.order import dense_positions, ranges
from albumen.operators import faces as A
from albumen.operators import filters as L
from albumen.operators import geo as G
from albumen.operators import ingest as I
from albumen.operators import maintain as M
from albumen.operators import pixels as P
from albumen.operators import search as H
from albumen.operators import stats as S
from albumen.operators import vectors as V
from albumen.operators.ranking import collision_free_names
from albumen.plans import registry
from pyspark.sql import functions as F


def vectors(spark, m, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(m)), m, strict=True)], "face_id long, embedding array<float>")


def unit(rng, n, d, groups=4, noise=0.25):
    centre = rng.normal(size=(groups, d))
    m = centre[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, d))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_similarity_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(V, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(V, "BLOCK", 16)
    m = unit(np.random.default_rng(1), 60, 8)
    df = vectors(spark, m)
    got = {(r.face_id, r.ref_id) for r in V.similarity_pairs(df, df.withColumnRenamed("face_id", "ref_id"), 0.8).collect()}
    sims = m.astype(float) @ m.astype(float).T
    assert got == {(i, j) for i in range(60) for j in range(60) if sims[i, j] >= 0.8}


@pytest.mark.parametrize("limit", [1 << 25, 64])
def test_topk(spark, monkeypatch, limit):
    monkeypatch.setattr(V, "BROADCAST_BYTES", limit)
    m = unit(np.random.default_rng(2), 50, 6)
    df = vectors(spark, m).repartition(3)
    q = vectors(spark, m[:4]).withColumnRenamed("face_id", "query_id")
    got = {(r.query_id, r["rank"]): r.face_id for r in V.topk_per_query(df, q, 5).collect()}
    sims = m[:4].astype(float) @ m.astype(float).T
    for i in range(4):
        want = sorted(range(50), key=lambda j: (-sims[i, j], j))[:5]
        assert [got[i, r] for r in range(1, 6)] == want


def test_robust_centroid(spark):
    rng = np.random.default_rng(3)
    m = unit(rng, 12, 5, groups=1, noise=0.1)
    m[0] = -m[0]
    df = vectors(spark, m).withColumn("g", F.lit(1))
    got = np.array(V.robust_centroid(df, "g").first().embedding)

    def mean(x):
        c = x.astype(float).mean(axis=0)
        return c / np.linalg.norm(c)

    c = mean(m)
    s = m.astype(float) @ c
    keep = s >= s.mean() - 1.5 * s.std()
    assert np.allclose(got, mean(m[keep]), atol=1e-6) and not keep[0]


def dbscan(m, eps, min_pts, absorb):
    d = np.sqrt(np.maximum(0, 2 - 2 * (m.astype(float) @ m.astype(float).T)))
    n = len(m)
    near = [[j for j in range(n) if j != i and d[i, j] <= eps] for i in range(n)]
    core = {i for i in range(n) if len(near[i]) >= min_pts}
    label = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            for j in near[i]:
                if j in core and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = dict(label)
    for i in range(n):
        if i not in core and any(j in core for j in near[i]):
            out[i] = min(label[j] for j in near[i] if j in core)
    centre = {}
    for c in set(out.values()):
        x = m[[i for i in out if out[i] == c]].astype(float).mean(axis=0)
        centre[c] = x / np.linalg.norm(x)
    for i in range(n):
        if i not in out:
            sims = sorted(((-float(m[i].astype(float) @ v), c) for c, v in centre.items()))
            out[i] = sims[0][1] if sims and -sims[0][0] >= 1 - absorb**2 / 2 else i
    return out


def test_clusters(spark):
    m = unit(np.random.default_rng(4), 70, 6, groups=5, noise=0.35)
    want = dbscan(m, 0.6, 2, 0.7)
    got = {r.face_id: r.cluster_id for r in A.cluster_faces(vectors(spark, m), eps=0.6, min_pts=2, absorb=0.7).collect()}
    assert got == want
    again = {r.face_id: r.cluster_id for r in A.cluster_faces(vectors(spark, m).orderBy(F.rand(1)), eps=0.6, min_pts=2, absorb=0.7).collect()}
    assert again == want


@pytest.mark.parametrize("noise, eps, min_pts, absorb", [(0.35, 0.6, 2, 0.7), (0.6, 0.75, 3, 0.9), (0.1, 0.3, 1, 1.2)])
def test_clusters_of_many_blocks(spark, monkeypatch, noise, eps, min_pts, absorb):
    monkeypatch.setattr(A, "BLOCK", 16)
    m = unit(np.random.default_rng(8), 150, 6, groups=7, noise=noise)
    got = {r.face_id: r.cluster_id for r in A.cluster_faces(vectors(spark, m), eps=eps, min_pts=min_pts, absorb=absorb).collect()}
    assert got == dbscan(m, eps, min_pts, absorb)


def test_a_chain_through_many_blocks_is_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 16)
    angles = np.random.default_rng(1).permutation(np.r_[np.arange(90) * 0.02, 3 + np.arange(40) * 0.02, 5.5])
    m = np.stack([np.cos(angles), np.sin(angles)], 1).astype(np.float32)
    got = {r.face_id: r.cluster_id for r in A.cluster_faces(vectors(spark, m), eps=0.03, min_pts=2, absorb=0.1).collect()}
    assert got == dbscan(m, 0.03, 2, 0.1) and len(set(got.values())) == 3


def test_clustering_writes_no_table_of_pairs(spark, monkeypatch):
    written, plain = [], A.cut

    def cut(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(A, "cut", cut)
    monkeypatch.setattr(A, "BLOCK", 64)
    m = unit(np.random.default_rng(3), 300, 6, groups=3, noise=0.1)
    got = {r.face_id: r.cluster_id for r in A.cluster_faces(vectors(spark, m), eps=0.9, min_pts=2, absorb=0.9).collect()}
    assert got == dbscan(m, 0.9, 2, 0.9)
    assert max(written) <= 300, written


def test_nms(spark):
    rows = [(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 1, 1, 11, 11, 0.8), (1, 3, 20, 20, 30, 30, 0.1), (2, 4, 0, 0, 10, 10, 0.5), (2, 5, 0, 0, 10, 10, 0.5)]
    df = spark.createDataFrame(rows, "photo_id long, face_id long, x1 int, y1 int, x2 int, y2 int, score double")
    assert sorted(r.face_id for r in A.nms(df).collect()) == [1, 3, 4]


def sequential(points, radius):
    """The plain rule over (id, lat, lon) in order: {id: first id of its cluster}."""
    lat, lon, size, name, out = np.zeros(len(points)), np.zeros(len(points)), np.zeros(len(points)), [], {}
    for i, a, b in points:
        k = len(name)
        y, x = np.radians(lat[:k]), np.radians(lon[:k])
        h = np.sin((y - math.radians(a)) / 2) ** 2 + np.cos(y) * math.cos(math.radians(a)) * np.sin((x - math.radians(b)) / 2) ** 2
        d = 2 * G.RADIUS_KM * np.arcsin(np.minimum(1, np.sqrt(h)))
        if k and d.min() <= radius:
            k = int(d.argmin())
            lat[k] += (a - lat[k]) / (size[k] + 1)
            lon[k] += (b - lon[k]) / (size[k] + 1)
        else:
            lat[k], lon[k] = a, b
            name.append(i)
        size[k] += 1
        out[i] = name[k]
    return out


def clustered(spark, points, least=1):
    df = spark.createDataFrame([(*p, False) for p in points], "photo_id long, gps_lat double, gps_lon double, private boolean")
    return {r.photo_id: r.cluster_id for r in G.gps_clusters(df, 1.5, least).collect()}


@pytest.mark.parametrize("lat", [0.0, 38.0, 60.0, -84.0])
def test_gps_clusters_are_the_sequential_ones(spark, lat):
    rng = random.Random(int(lat) + 1)
    hubs = [(lat + rng.uniform(-1.5, 1.5), 20 + rng.uniform(-1.5, 1.5)) for _ in range(12)]
    points = [(i, a + rng.gauss(0, 0.012), b + rng.gauss(0, 0.012)) for i in range(160) for a, b in [rng.choice(hubs)]]
    assert clustered(spark, points) == sequential(points, 1.5)


def test_a_set_of_30000_coordinates_that_chain_together(spark):
    rng = random.Random(9)
    points = [(i, 38 + rng.uniform(0, 0.4), 20 + rng.uniform(0, 1.5)) for i in range(30_000)]
    assert clustered(spark, points) == sequential(points, 1.5)


@pytest.mark.parametrize(("lat", "lon"), [(10.0, 180.0), (88.95, 40.0), (-89.99, 0.0), (0.0, 0.0)])
def test_centres_are_found_across_the_seams_of_the_grid(lat, lon):
    rng = random.Random(3)
    turn = lambda x: (x + 180) % 360 - 180
    points = [(i, max(-90.0, min(90.0, lat + rng.uniform(-0.05, 0.05))), turn(lon + rng.uniform(-0.05, 0.05) / max(0.02, math.cos(math.radians(lat))))) for i in range(400)]
    for i, a, b in points:
        held = G.Centres(1.5)
        held.join(a, b, 1, i)
        for j, y, x in points[:60]:
            assert (G.Centres.join.__get__(_copy(held))(y, x, 1, -1 - j) == i) == (G._km(a, b, y, x) <= 1.5)


def _copy(held):
    out = G.Centres(held.radius)
    out.centres, out.cells = list(held.centres), {k: set(v) for k, v in held.cells.items()}
    return out


def test_equal_coordinates_join_together(spark):
    df = spark.createDataFrame([(i, 10.0 + 0.01 * (i % 3), 20.0, False) for i in range(300)], "photo_id long, gps_lat double, gps_lon double, private boolean")
    got = {r.photo_id: r.cluster_id for r in G.gps_clusters(df, 1.5, 3).collect()}
    assert len(got) == 300 and len({(i % 3, c) for i, c in got.items()}) == 3


def test_pixels():
    rng = np.random.default_rng(5)
    g = rng.integers(0, 256, (3, 32, 32)).astype(np.uint8)
    for image, h in zip(g, P.phash(g), strict=True):
        low = [[sum(float(image[y, x]) * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) * (math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1) for v in range(8)] for u in range(8)]
        flat = [c for r in low for c in r]
        mid = sorted(flat[1:])[31]
        assert int(h) == sum(1 << i for i in range(1, 64) if flat[i] > mid)
    assert P.blur(np.full((1, 32, 32), 7, np.uint8))["blur_score"][0] == 0
    two = np.zeros((4, 4, 3), np.uint8)
    two[:3] = (255, 0, 0)
    assert P.dominant(two)[0] == "#ff0000"


@pytest.mark.parametrize("name, side, channels", [("perceptual_hash", 32, 1), ("blur_metrics", 256, 1), ("dominant_colours", 48, 3)])
def test_pixel_queries_take_every_photo(spark, name, side, channels):
    sf = "/root/testdata/sf0.001"
    got = {r.photo_id: r for r in registry.QUERIES[name](spark, sf).collect()}
    ids = [r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()]
    assert set(got) == set(ids) and any(i % 40 for i in ids)
    for i in ids[:3]:
        n = side * side * channels
        drawn = b"".join(hashlib.sha256(f"{i}-{j}".encode()).digest() for j in range(-(-n // 32)))[:n]
        image = np.frombuffer(drawn, np.uint8).reshape((1, side, side) if channels == 1 else (side, side, channels))
        if name == "perceptual_hash":
            assert got[i].phash == f"{int(P.phash(image)[0]):016x}"
        elif name == "blur_metrics":
            assert got[i].blur_score == pytest.approx(P.blur(image)["blur_score"][0])
        else:
            assert got[i].dominant_colors == P.dominant(image)


def test_search_texts(spark):
    texts = [(1, 'cats Or dog "Red car" -Night -rating:>=4 AND year:2020 beach* x:y -"old barn" -'), (2, None), (3, "or a or"), (4, "before:2weeks lens:50mm -date:today")]
    got = {r.query_id: r for r in H.parse_searches(spark.createDataFrame(texts, "query_id long, text string"), F.lit("2024-03-31")).collect()}
    p = got[1]
    assert p.words == [["cats", "dog"], ["x:y"]] and p.must == [["cats", "cat", "dog"], ["x:y"]] and p.phrases == ["red car"] and p.must_not == ["night", "old barn"]
    assert [tuple(f) for f in p.fields] == [("!rating", ">=4"), ("year", "2020")] and p.wildcards == ["beach"]
    assert got[2].words == [] and got[3].words == [["a"]]
    assert [tuple(f) for f in got[4].fields] == [("before", "2024-03-17"), ("lens", "50mm"), ("!date", "today")]


def test_words(spark):
    df = spark.createDataFrame([("İstanbul",), ("Çiçekler",), ("running",), ("class",), ("boxes",)], "t string")
    got = {r.t: set(r.v) for r in df.select("t", X.term_variants(F.col("t")).alias("v")).collect()}
    assert got["İstanbul"] == {"istanbul"} and got["Çiçekler"] == {"çiçekler", "cicekler", "çiçek", "cicek"}
    assert got["running"] == {"running", "runn"} and got["class"] == {"class"} and got["boxes"] == {"boxes", "box"}


def test_date_words(spark):
    day = F.lit(dt.date(2024, 3, 31))
    rows = spark.createDataFrame([(w,) for w in ("today", "dün", "last-week", "lastmonth", "1month", "2-years", "3days", "this_week", "last week", "soon")], "w string")
    got = {r.w: tuple(r.r) if r.r else None for r in rows.select("w", H.date_keyword_range(F.col("w"), day).alias("r")).collect()}
    d = dt.date
    want = {"today": (d(2024, 3, 31),) * 2, "dün": (d(2024, 3, 30),) * 2, "last-week": (d(2024, 3, 18), d(2024, 3, 24)), "lastmonth": (d(2024, 2, 1), d(2024, 2, 29)), "1month": (d(2024, 2, 28),) * 2, "2-years": (d(2022, 3, 28),) * 2, "3days": (d(2024, 3, 28),) * 2}
    assert got == {**want, "this_week": (d(2024, 3, 25), d(2024, 3, 31)), "last week": None, "soon": None}


def test_blur_threshold_rank(spark):
    for n in (49, 50, 400):
        scores = [float(x) for x in random.Random(n).sample(range(3000), n)]
        df = spark.createDataFrame([(s,) for s in scores] + [(None,)], "blur_score double")
        want = None if n < 50 else min(120.0, max(25.0, sorted(scores)[max(1, int(0.03 * n))]))
        assert S.suggested_blur_threshold(df).first().threshold == want


def test_names_do_not_meet(spark):
    df = spark.createDataFrame([(1, "d", "a.jpg"), (2, "d", "A.jpg"), (3, "d", "a-1.jpg"), (4, "e", "a.jpg")], "id long, dir string, name string")
    got = {r.id: r.new_name for r in collision_free_names(df, "dir", "name", "id").collect()}
    assert got[1] == "a.jpg" and got[4] == "a.jpg" and len({got[i].lower() for i in (1, 2, 3)}) == 3


def test_upsert_never_doubles(spark):
    rng = random.Random(6)
    form = lambda: rng.choice(["sea", "Sea", "SEA", "sky", "Sky"])
    old = {(rng.randrange(5), form().lower()) for _ in range(12)}
    tags = spark.createDataFrame([(p, t, 0.5, "x") for p, t in old], "photo_id long, tag string, confidence double, source string")
    new = spark.createDataFrame([(rng.randrange(5), form(), 0.9, "y", i) for i in range(20)], "photo_id long, tag string, confidence double, source string, ord int")
    out = M.upsert_tags(tags, new).collect()
    keys = [(r.photo_id, r.tag.lower()) for r in out]
    assert len(keys) == len(set(keys)) and {(p, t) for p, t in old} <= set(keys)


def test_person_chains(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (5, 3)], "source long, target long")
    assert {(r.source, r.target) for r in M.resolve_chains(m).collect()} == {(1, 3), (2, 3), (5, 3)}


def test_undated_photos_pass_before(spark):
    df = spark.createDataFrame([(1, None, None), (2, dt.date(2019, 5, 1), None), (3, dt.date(2020, 5, 1), None)], "photo_id long, date_taken date, created_at date")
    got = lambda f, v: sorted(r.photo_id for r in L.field_filter(df, [(f, v)]).collect())
    assert got("before", "2020") == [1, 2] and got("after", "2020") == [3] and got("year", "2019-2020") == [2, 3] and got("!wrong", "x") == [] and got("wrong", "x") == [1, 2, 3]


def test_oldest_date(spark):
    row = ("/a/2015-02-30/IMG_20140506.jpg", "2016:01:02 03:04:05", None, "bad", "2013:07:08", dt.datetime(2020, 1, 1), dt.datetime(1985, 1, 1))
    df = spark.createDataFrame([row], "path string, exif_original string, exif_digitized string, exif_datetime string, gps_date string, mtime timestamp_ntz, birthtime timestamp_ntz")
    assert I.oldest_plausible_date(df, dt.datetime(2024, 1, 1)).first().date_taken == dt.datetime(2013, 7, 8, 12)
    assert I.oldest_plausible_date(df.withColumn("gps_date", F.lit(None).cast("string")), dt.datetime(2024, 1, 1)).first().date_taken == dt.datetime(2014, 5, 6, 12)


def test_responses(spark):
    texts = ["```json\n[\"A\", \" b \"]\n```", 'x {"tags": ["Z"], "location": {"name": "n", "lat": 95, "lon": 1}} y', "- one\n- two", "1. one\n2) two\n* three", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    got = {r.i: (r.tags, r.lat) for r in I.parse_tag_responses(df).collect()}
    assert got == {0: (["a", "b"], None), 1: (["z"], None), 2: ([], None), 3: (["one", "two", "three"], None), 4: ([], None)}


def test_exports_come_back(spark, tmp_path):
    photos = spark.createDataFrame([(2, "/b/y.jpg", "/b", 1.0, 2.0), (1, "/a/x, \"1\".jpg", "/a", None, None)], "photo_id long, path string, folder string, gps_lat double, gps_lon double")
    tags = spark.createDataFrame([(1, "t2", 1.0, "m"), (1, "t1", 1.0, "m")], "photo_id long, tag string, confidence double, source string")
    I.export_csv(photos, tags, f"{tmp_path}/csv", strip_gps=True)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert {(r.photo_id, r.tags, r.gps_lat) for r in back.collect()} == {("1", "t1; t2", None), ("2", None, None)}
    I.export_documents(photos, tags).write.json(f"{tmp_path}/json")
    assert {r.photo_id: r.gps and r.gps.lat for r in spark.read.json(f"{tmp_path}/json").collect()} == {1: None, 2: 1.0}
    I.export_markdown(photos, tags, f"{tmp_path}/md")
    assert "### y.jpg" in [r.value for r in spark.read.text(f"{tmp_path}/md").collect()]


@pytest.mark.parametrize("limit", [1 << 25, 64])
def test_best_of_each_group(spark, monkeypatch, limit):
    monkeypatch.setattr(V, "BROADCAST_BYTES", limit)
    m = unit(np.random.default_rng(6), 90, 6)
    df = vectors(spark, m).repartition(3)
    refs = df.withColumn("person_id", (F.col("face_id") % 4).cast("long"))
    sims = m.astype(float) @ m.astype(float).T
    got = {(r.face_id, r.person_id): (round(r.top, 6), r.sup) for r in V.similarity_groups(df, refs, 0.1, 0.4).collect()}
    want = {(i, g): (round(sims[i, g::4].max(), 6), int((sims[i, g::4] >= 0.4).sum())) for i in range(90) for g in range(4) if sims[i, g::4].max() >= 0.1}
    assert got == want
    two = V.similarity_groups(df, df.withColumnRenamed("face_id", "person_id"), -1.5, keep=2).collect()
    best = {i: {j for j in sorted(range(90), key=lambda j: (-sims[i, j], j))[:2]} for i in range(90)}
    found = {}
    for r in two:
        found.setdefault(r.face_id, set()).add(r.person_id)
    assert all(best[i] <= found[i] for i in best) and max(map(len, found.values())) <= 4


def test_few_tiles_meet_and_no_pair_is_lost(spark):
    m = unit(np.random.default_rng(7), 3000, 24, groups=40, noise=0.05)
    pivots = V.choose_pivots(m[:: len(m) // 500])
    tiles = V.Tiles(m, pivots, 64)
    meets = tiles.meets(tiles, 0.8)
    sims = m.astype(float) @ m.astype(float).T
    a, b = np.nonzero(sims >= 0.8)
    place = np.empty(len(m), int)
    place[tiles.order] = np.repeat(np.arange(len(tiles.heads)), tiles.ends - tiles.heads)
    assert meets[place[a], place[b]].all() and meets.mean() < 0.2
    df = vectors(spark, m)
    got = {(r.face_id, r.ref_id) for r in V.similarity_pairs(df.repartition(3), df.withColumnRenamed("face_id", "ref_id"), 0.8).collect()}
    assert got == set(zip(a.tolist(), b.tolist(), strict=True))


def test_positions_of_keys_that_lie_together(spark):
    keys = [*range(1000), *(10**12 + 10**9 * i for i in range(100))]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    for down in (False, True):
        got = {r.k: r["rank"] for r in dense_positions(df, "k", down).collect()}
        assert got == {k: i + 1 for i, k in enumerate(sorted(keys, reverse=down))}
    sizes = [r["count"] for r in ranges(df, "k").groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 1.5 * len(keys) / 4


def test_letters_of_their_own_do_not_fold(spark):
    texts = spark.createDataFrame([(1, "über ßchber"), (2, "SCHBÉR"), (3, "søk"), (4, "sok łodz")], "photo_id long, description string")
    asked = spark.createDataFrame([(1, "schber"), (2, "sok"), (3, "lodz")], "query_id long, text string")
    got = H.search_description(texts, asked).collect()
    assert {(r.query_id, r.photo_id) for r in got} == {(1, 2), (2, 4)}


@pytest.mark.parametrize("name", ["perceptual_hash", "blur_metrics", "dominant_colours"])
def test_pixels_of_one_small_table_are_made_by_many_tasks(spark, name):
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 2 * 1500 / len(parts)


def test_pixel_kernels_equal_plain_ones():
    rng = np.random.default_rng(7)
    for h, w in ((6, 6), (7, 9), (33, 100), (256, 256), (2100, 20)):
        for grey in (rng.integers(0, 256, (3, h, w), np.uint8), rng.integers(0, 2, (3, h, w), np.uint8) * np.uint8(255)):
            got = P.blur(grey)
            g = grey.astype(float)
            lap = g[:, :-2, 1:-1] + g[:, 2:, 1:-1] + g[:, 1:-1, :-2] + g[:, 1:-1, 2:] - 4 * g[:, 1:-1, 1:-1]
            y, x, n, m = int((h - 2) * 0.3), int((w - 2) * 0.3), h - 2, w - 2
            patches = [lap[:, n * i // 4 : n * (i + 1) // 4, m * j // 4 : m * (j + 1) // 4].var(axis=(1, 2)) for i in range(4) for j in range(4)]
            assert np.allclose(got["overall"], lap.var(axis=(1, 2))) and np.allclose(got["patch_max"], np.max(patches, axis=0))
            assert np.allclose(got["center"], lap[:, y : n - y, x : m - x].var(axis=(1, 2)))
    for shape in ((5, 1, 1, 3), (5, 2, 2, 3), (4, 9, 17, 3), (3, 48, 48, 3)):
        for rgb in (rng.integers(0, 256, shape, np.uint8), rng.integers(0, 2, shape, np.uint8), np.full(shape, 9, np.uint8)):
            want = []
            for image in rgb:
                p = image.reshape(-1, 3).astype(float)
                k = min(5, len(p))
                centre = p[np.arange(k) * len(p) // k]
                for _ in range(4):
                    near = ((p[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
                    centre = np.array([p[near == i].mean(axis=0) if (near == i).any() else centre[i] for i in range(k)])
                order = sorted(range(k), key=lambda i: -(near == i).sum())
                want.append(["#%02x%02x%02x" % tuple(int(v + 1e-9) for v in centre[i]) for i in order if (near == i).any()])
            assert P.dominants(rgb) == want


def test_repeated_search_texts_are_parsed_once(spark):
    said = [(i, f"t{i}", ["cats Or dog before:2weeks", "beach* -old", None, ""][i % 4]) for i in range(40)]
    rows = spark.createDataFrame(said, "query_id long, photo_id string, text string")
    plain = {r.query_id: r for r in H.parse_searches(rows, F.lit("2024-03-31")).collect()}
    got = {r.query_id: r for r in H.parse_repeated(rows, F.lit("2024-03-31")).collect()}
    assert len(got) == 40 and all(got[i].asDict(True) == plain[i].asDict(True) for i in plain) and got[3].photo_id == "t3"


def below_explode(df):
    """The part of the plan that runs before rows are taken apart."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)[1]


def test_watched_folders_meet_each_folder_once(spark):
    photos = spark.createDataFrame([("/a/b",)] * 5 + [("/a",), ("/ab",), (None,)], "folder string").repartition(2)
    out = L.watch_folder_counts(spark.createDataFrame([("/a",), ("/a/b/",), ("/c",)], "path string"), photos)
    assert {r.path: r.n for r in out.collect()} == {"/a": 6, "/a/b/": 5, "/c": 0} and "Aggregate" in below_explode(out)


def test_phrases_meet_each_tag_once(spark):
    tags = spark.createDataFrame([(1, "hot red plate"), (1, "red plate"), (2, "red hot plate"), (3, "Red-Plate"), (4, None)], "photo_id long, tag string").repartition(2)
    out = H.search_tags_phrase(tags, spark.createDataFrame([(1, "red plate"), (2, "plate"), (3, "")], "query_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)] and "Aggregate" in below_explode(out)


def test_terms_of_each_text_are_looked_up_once(spark):
    d = spark.createDataFrame([("red car", "kızıl araba", None), ("red", "kırmızı", None), ("bank", "kıyı", ["River"]), ("bank", "banka", None)], "source string, target string, context array<string>")
    said = ["Red Car", "car red", "river bank red", "bank", "car", None, "", " red car ", "Red"] * 3
    out = H.translate_terms(spark.createDataFrame(list(enumerate(said)), "query_id long, text string").repartition(3), d)
    want = {"Red Car": ["kızıl araba"], " red car ": ["kızıl araba"], "car red": ["kırmızı"], "Red": ["kırmızı"], "river bank red": ["kıyı", "kırmızı"], "bank": ["banka"]}
    assert {r.query_id: r.terms for r in out.collect()} == {i: want[t] for i, t in enumerate(said) if t in want} and "Aggregate" in below_explode(out)


def test_best_rows_of_many_queries_in_blocks():
    rng = np.random.default_rng(3)
    queries, rows = rng.integers(-2, 3, (600, 4)).astype(float), rng.integers(-2, 3, (700, 4)).astype(float)  # many ties
    names = rng.permutation(700)
    best = V.Best(600, 7, -3.0)
    for lo in range(0, 700, 90):
        best.take(queries, rows[lo : lo + 90], names[lo : lo + 90])
        assert sum(len(q) for q, _, _ in best.rows()) <= 600 * 7
    got = [(int(q), int(r), float(s)) for block in best.rows() for q, r, s in zip(*block, strict=True)]
    sims = queries @ rows.T
    assert got == [(i, b, -a) for i in range(600) for a, b in sorted((-s, n) for s, n in zip(sims[i], names, strict=True) if s >= -3)[:7]]


def test_one_task_gives_k_rows_a_query(spark):
    m = np.random.default_rng(4).normal(size=(5000, 4))
    rows = vectors(spark, m).coalesce(1)
    out = V.topk_per_query(rows, rows.filter("face_id < 3").withColumnRenamed("face_id", "query_id"), 2)
    assert [[r.face_id for r in sorted(out.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in range(3)] == [np.argsort(-(m @ m[q]))[:2].tolist() for q in range(3)]
    assert V.topk_per_query(rows, rows.filter("false").withColumnRenamed("face_id", "query_id"), 2).count() == 0


def test_tiles_keep_vectors_as_they_came():
    m = np.random.default_rng(2).normal(size=(5000, 8)).astype(np.float32)
    tiles = V.Tiles(m, V.choose_pivots(m[:500]))
    assert tiles.vectors.dtype == np.float32 and tiles.tile(0).dtype == np.float64
    assert np.array_equal(np.concatenate([tiles.tile(i) for i in range(len(tiles.heads))]), m[tiles.order].astype(float)) and sorted(tiles.order) == list(range(5000))


def test_search_computes_the_summaries_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, ["red plate"], 1, f"/lib/{i}.jpg", None, "image", False, 3, False, None) for i in range(20)]
    photos = spark.createDataFrame(rows, "photo_id long, tags array<string>, tag_count long, path string, description string, media_type string, favorite boolean, rating int, private boolean, date_taken date")
    tags = photos.select("photo_id", F.explode("tags").alias("tag"))
    asked = spark.createDataFrame([(1, "red plate"), (2, "rating:3"), (3, "redplate")], "query_id long, text string")
    found = H.search(asked, photos.mapInArrow(counted, photos.schema), tags, spark.createDataFrame([], "group_id int, term string")).collect()
    assert {r.query_id for r in found} == {1, 2, 3} and made.value == 20


def test_ascii_and_other_texts_fold_alike(spark):
    texts = ["PLATE 7", "İSTANBUL", "Kırmızı ÇAY", "ÅNGSTRÖM ßa", "", None, "áΩ"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    was = F.translate(F.lower(F.translate("t", X.DOTTED, "i")), X.ACCENTED, X.PLAIN)
    assert all(r.a == r.b for r in frame.select(X.fold(F.col("t")).alias("a"), was.alias("b")).collect())


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_tags_looks_at_every_tag(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abç") for _ in range(rng.randrange(13))) for _ in range(500)}
    for _ in range(400):  # terms with up to three edits
        word = list(rng.choice(["abcab", "abçabca", "abcabcab", "çabbacabca"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word))
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "ç"])
        words.add("".join(word))
    uses = {w: 1 + rng.randrange(2) for w in sorted(words)}
    tags = spark.createDataFrame([(i, w.upper() if i else w) for w, n in uses.items() for i in range(n)] + [(0, None)], "photo_id long, tag string")
    terms = [(i, w) for i, w in enumerate(["", "ab", "abca", "abcab", "Abçabca", "abcabcab", "çabbacabca", "cab", "bbbbbbbbbbbb", "cab"])] + [(99, None)]
    found = H.fuzzy_tags(tags, spark.createDataFrame(terms, "query_id long, term string")).collect()
    budget = lambda w: 0 if len(w) <= 4 else 1 if len(w) <= 7 else 2
    want = {(i, w, t, _edits(w.lower(), t), n) for i, w in terms if w is not None for t, n in uses.items() if _edits(w.lower(), t) <= budget(w)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert max(sum(x[0] == i for x in want) for i, _ in terms) > 30


def test_search_finds_near_tags_beside_many_used_ones(spark):
    named = [(i, f"used {i % 250}") for i in range(500)] + [(1000 + i, f"redplat{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(40)]
    rows = [(i, [t], 1, f"/lib/{i}.jpg", None, "image", False, 3, False, None) for i, t in named]
    photos = spark.createDataFrame(rows, "photo_id long, tags array<string>, tag_count long, path string, description string, media_type string, favorite boolean, rating int, private boolean, date_taken date")
    tags = photos.select("photo_id", F.explode("tags").alias("tag"))
    asked = spark.createDataFrame([(1, "redplatte")], "query_id long, text string")
    found = H.search(asked, photos, tags, spark.createDataFrame([], "group_id int, term string")).collect()
    assert {r.photo_id for r in found} == {i for i, t in named if _edits("redplatte", t) <= 2} and len(found) == 40


def test_pixels_are_decoded_where_they_are_looked_at(spark):
    rows = [(i, 48, 48, b"%d" % i) for i in range(5)] + [(7, 48, 48, b"none"), (8, 48, 48, b"short"), (9, 48, 48, None)]
    files = spark.createDataFrame(rows, "photo_id long, width int, height int, pixels binary")
    image = lambda name, n: np.random.default_rng(int(name)).integers(0, 256, n, np.uint8).tobytes()
    decode = lambda n: lambda b: {b"none": None, b"short": b"xyz"}[bytes(b)] if b[:1].isalpha() else image(b, n)
    raw = lambda n: spark.createDataFrame([(*r[:3], image(r[3], n)) for r in rows[:5]], files.schema)
    for of, n in ((P.blur_metrics, 48 * 48), (P.dominant_colours, 48 * 48 * 3)):
        got = sorted(map(tuple, of(files, decode=decode(n)).collect()))
        assert got == sorted(map(tuple, of(raw(n)).collect())) and [r[0] for r in got] == list(range(5))


@pytest.mark.parametrize("name", ["perceptual_hash", "blur_metrics", "dominant_colours"])
def test_pixel_queries_pass_python_once(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "sha2" not in plan.lower()


def test_colours_of_near_ties_are_those_of_double_precision():
    rgb = np.zeros((3, 1, 7, 3), np.uint8)
    rgb[1, 0, :, 0] = [10, 200, 90, 90, 170, 105, 104]  # 105 is as near to 10 as to 200
    rgb[2, 0, :, 1] = np.arange(7)
    for k in (2, 3, 5):
        for image, got in zip(rgb, P.dominants(rgb, k), strict=True):
            p = image.reshape(-1, 3).astype(float)
            centre = p[np.arange(k) * 7 // k]
            for _ in range(4):
                near = ((p[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
                centre = np.array([p[near == i].mean(axis=0) if (near == i).any() else centre[i] for i in range(k)])
            order = sorted(range(k), key=lambda i: -(near == i).sum())
            assert got == ["#%02x%02x%02x" % tuple(int(v + 1e-9) for v in centre[i]) for i in order if (near == i).any()]
