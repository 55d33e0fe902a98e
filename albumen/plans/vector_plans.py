"""Vector search and faces. The fixture vectors are nearly random, so thresholds are low."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import faces as A
from ..operators import vectors as V
from .registry import query

DOT = "list_dot_product(CAST({}.embedding AS DOUBLE[]), CAST({}.embedding AS DOUBLE[]))"
AB = DOT.format("a", "b")
NAMED = "n AS (SELECT face_id, person_id, embedding FROM faces WHERE assignment = 'named'), u AS (SELECT face_id, embedding FROM faces WHERE assignment = 'unassigned'), sk AS (SELECT face_id, embedding FROM faces WHERE assignment = 'skipped')"
SIM = f"{NAMED}, s AS (SELECT a.face_id, b.person_id, {AB} AS sim FROM u a, n b)"


@query("cosine_pairs", "SELECT a.face_id, b.face_id AS ref_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim FROM faces a JOIN faces b ON b.face_id = a.face_id + 1", ("faces",))
def _(lib):
    f = lib.faces.select("face_id", "embedding")
    g = f.select((F.col("face_id") - 1).alias("face_id"), F.col("face_id").alias("ref_id"), F.col("embedding").alias("e2"))
    return f.join(g, "face_id").select("face_id", "ref_id", F.round(V.cosine("embedding", "e2"), 5).alias("sim"))


@query("similarity_join", f"SELECT a.face_id, b.face_id AS ref_id, round({AB}, 5) AS sim FROM faces a JOIN faces b ON b.assignment = 'named' WHERE {AB} >= 0.3", ("faces",))
def _(lib):
    f = lib.faces
    return V.similarity_pairs(f, f.filter("assignment = 'named'").select(F.col("face_id").alias("ref_id"), "embedding"), 0.3).select("face_id", "ref_id", F.round("sim", 5).alias("sim"))


@query("vector_norms", "SELECT face_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM faces", ("faces",))
def _(lib):
    blobs = lib.faces.select("face_id", V.encode_vectors().alias("blob"))
    return V.decode_vectors(blobs, "blob").select("face_id", F.round(V.norm("embedding"), 5).alias("norm"))


TOP = "SELECT q.face_id AS query_id, f.face_id, round({0}, 5) AS sim, row_number() OVER (PARTITION BY q.face_id ORDER BY {0} DESC, f.face_id) AS rank FROM faces q, faces f WHERE q.face_id % 25 = 0"
QF = DOT.format("q", "f")


@query("topk_per_query", f"SELECT * FROM ({TOP.format(QF)}) WHERE rank <= 5", ("faces",))
def _(lib):
    f = lib.faces
    q = f.filter("face_id % 25 = 0").select(F.col("face_id").alias("query_id"), "embedding")
    return V.topk_per_query(f, q, 5).select("query_id", "face_id", F.round("sim", 5).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("semantic_search", f"SELECT query_id, face_id, sim FROM ({TOP.format(QF)}) WHERE rank <= 20 AND sim >= 0.2", ("faces",))
def _(lib):
    f = lib.faces
    q = f.filter("face_id % 25 = 0").select(F.col("face_id").alias("query_id"), "embedding")
    return V.semantic_search(f, q, 20).select("query_id", "face_id", F.round("sim", 5).alias("sim"))


@query("find_similar", f"SELECT query_id, face_id, rank FROM ({TOP.format(QF)} AND q.face_id <> f.face_id) WHERE rank <= 3", ("faces",))
def _(lib):
    return V.find_similar(lib.faces, lib.faces.filter("face_id % 25 = 0"), 3).select("query_id", "face_id", F.col("rank").cast("long").alias("rank"))


MEAN = "m AS (SELECT list(x ORDER BY p) AS embedding FROM (SELECT p, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM faces WHERE {}) GROUP BY p))"


@query("flag_sensitive", f", {MEAN.format('face_id < 5')} SELECT face_id, round({DOT.format('f', 'm')}, 5) AS score, {DOT.format('f', 'm')} >= 0.1 AS flagged FROM faces f, m", ("faces",))
def _(lib):
    return V.flag_sensitive(lib.faces, lib.faces.filter("face_id < 5"), 0.1).select("face_id", F.round("nsfw_score", 5).alias("score"), "flagged")


@query("zero_shot_filter", f"SELECT face_id, round(g, 5) AS gap FROM (SELECT f.face_id, max({DOT.format('f', 'p')}) FILTER (p.face_id > 0) - max({DOT.format('f', 'p')}) FILTER (p.face_id = 0) AS g FROM faces f, faces p WHERE p.face_id < 4 GROUP BY 1) WHERE g < 0.035", ("faces",))
def _(lib):
    p = lib.faces.filter("face_id < 4").select(F.col("face_id").alias("ord"), "embedding")
    return V.zero_shot_filter(lib.faces, p).select("face_id", F.round("gap", 5).alias("gap"))


@query("robust_centroids")
def _(lib):
    c = V.robust_centroid(lib.faces.filter("assignment = 'named'"), "person_id")
    return c.select("person_id", "n", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


@query("recognise_faces", f""", {SIM}, p AS (SELECT face_id, person_id, max(sim) top, count(*) FILTER (sim >= 0.25) sup FROM s GROUP BY 1, 2), z AS (SELECT person_id, count(*) AS size FROM n GROUP BY 1),
r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(top) OVER w, 0) AS nxt FROM p JOIN z USING (person_id) WHERE top >= 0 WINDOW w AS (PARTITION BY face_id ORDER BY top DESC, person_id))
SELECT face_id, person_id, round(top, 5) AS confidence FROM r WHERE r = 1 AND top >= 0.3 AND top - nxt >= 0.02 AND (size < 3 OR sup >= 2)""", ("faces",))
def _(lib):
    return A.recognise_faces(lib.faces, 0.3, 0.02, 0.25).select("face_id", "person_id", F.round("confidence", 5).alias("confidence"))


@query("suggest_matches", f", {SIM} SELECT face_id, person_id, round(sim, 5) AS sim, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY sim DESC, person_id) r FROM (SELECT face_id, person_id, max(sim) AS sim FROM s WHERE sim >= 0.25 GROUP BY 1, 2)) WHERE r <= 3", ("faces",))
def _(lib):
    return A.suggest_matches(lib.faces, 3, 0.25).select("face_id", "person_id", F.round("sim", 5).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("propagate_name", f""", {NAMED}, seeds AS (SELECT face_id, CAST(face_id % 4 + 1 AS BIGINT) person_id, embedding FROM u WHERE face_id % 20 = 1), hit AS (SELECT face_id, arg_max(person_id, (sim, -person_id)) person_id FROM (SELECT a.face_id, b.person_id, {AB} AS sim FROM u a, seeds b WHERE a.face_id NOT IN (SELECT face_id FROM seeds)) WHERE sim >= 0.28 GROUP BY 1)
SELECT face_id, coalesce(s.person_id, h.person_id, f.person_id) AS person_id FROM faces f LEFT JOIN (SELECT face_id, person_id FROM seeds) s USING (face_id) LEFT JOIN hit h USING (face_id)""", ("faces",))
def _(lib):
    seeds = lib.faces.filter("assignment = 'unassigned' and face_id % 20 = 1").select("face_id", (F.col("face_id") % 4 + 1).alias("person_id"))
    return A.propagate_name(lib.faces, seeds, 0.28).select("face_id", "person_id")


@query("propagate_skip", f""", {NAMED}, seeds AS (SELECT face_id, embedding FROM faces WHERE face_id % 20 = 2 AND assignment <> 'named') SELECT face_id, CASE WHEN face_id IN (SELECT face_id FROM seeds) OR face_id IN (SELECT a.face_id FROM u a, seeds b WHERE {AB} >= 0.28) THEN 'skipped' ELSE assignment END AS assignment FROM faces""", ("faces",))
def _(lib):
    return A.propagate_skip(lib.faces, lib.faces.filter("face_id % 20 = 2"), 0.28).select("face_id", "assignment")


@query("skip_on_insert", f", {NAMED} SELECT a.face_id, CASE WHEN max({AB}) >= 0.25 THEN 'skipped' ELSE 'unassigned' END AS assignment FROM n a, sk b GROUP BY 1", ("faces",))
def _(lib):
    none = lib.spark.createDataFrame([], "cluster_id long, n long, embedding array<float>")
    return A.skip_on_insert(lib.faces.filter("assignment = 'named'").drop("assignment"), lib.faces, none).select("face_id", "assignment")


@query("triage_unknown")
def _(lib):
    return A.triage_unknown(lib.faces, lib.faces.filter("face_id % 10 = 1").select("face_id"), 0.3, 0.02, 0.2)


@query("cluster_faces")
def _(lib):
    return A.cluster_faces(lib.faces, eps=1.2, absorb=1.25)


@query("largest_clusters")
def _(lib):
    c = A.cluster_faces(lib.faces, eps=1.2, absorb=1.25)
    return c.select("cluster_id", "size", "representative").distinct().orderBy(F.desc("size"), "cluster_id").limit(20)


@query("assign_to_clusters")
def _(lib):
    c = V.robust_centroid(lib.faces.filter("assignment = 'named'"), "person_id").select(F.col("person_id").alias("cluster_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return A.assign_to_clusters(lib.faces.filter("assignment = 'unassigned'"), c, 1.25, eps=1.2)


@query("nms_boxes", """, b AS (SELECT photo_id // 30 AS photo_id, face_id, x1, y1, x2, y2, face_id * 7919 % 1000 / 1000.0E0 AS score FROM faces), r AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, face_id) AS n FROM b),
k AS (SELECT photo_id, n, [{'face_id': face_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}] AS kept FROM r WHERE n = 1
UNION ALL SELECT r.photo_id, r.n, CASE WHEN len(list_filter(list_transform(k.kept, lambda q: {'i': greatest(0, least(q.x2, r.x2) - greatest(q.x1, r.x1)) * greatest(0, least(q.y2, r.y2) - greatest(q.y1, r.y1)), 'a': (q.x2 - q.x1) * (q.y2 - q.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)}), lambda o: o.i / greatest(o.a - o.i, 1e-9) > 0.4)) > 0 THEN k.kept ELSE list_append(k.kept, {'face_id': r.face_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'score': r.score}) END FROM k JOIN r ON r.photo_id = k.photo_id AND r.n = k.n + 1)
SELECT photo_id, q.face_id, q.x1, q.y1, q.x2, q.y2, q.score FROM (SELECT photo_id, unnest(arg_max(kept, n)) AS q FROM k GROUP BY 1)""", ("faces",))
def _(lib):
    f = lib.faces.select((F.col("photo_id") / 30).cast("long").alias("photo_id"), "face_id", "x1", "y1", "x2", "y2", (F.col("face_id") * 7919 % 1000 / 1000.0).alias("score"))
    return A.nms(f)


@query("embed_batch", "SELECT photo_id, CAST(length(description) % 97 AS DOUBLE) AS first, 'base' AS tier FROM descriptions WHERE description IS NOT NULL", ("descriptions",))
def _(lib):
    def encode(texts):
        return [None if t is None else [float(len(t) % 97), 1.0] for t in texts]

    return V.embed_batch(lib.descriptions.select("photo_id", F.col("description").alias("input")), encode, "base").select("photo_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), "tier")
