"""Media-library tables as views over the raw tables; each view's SQL runs on Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ("orders", "lineitem", "part", "events", "embeddings", "documents")

VIEWS: dict[str, str] = {
    "photos": """SELECT o_orderkey AS photo_id,
  '/lib/' || o_orderpriority || '/IMG_' || lpad(CAST(o_orderkey AS STRING), 7, '0') || CASE WHEN o_orderkey % 11 = 0 THEN '.cr2' WHEN o_orderkey % 11 = 1 THEN '.heic' WHEN o_orderkey % 11 = 2 THEN '.png' WHEN o_orderkey % 11 = 3 THEN '.mp4' WHEN o_orderkey % 11 = 4 THEN '.tif' ELSE '.jpg' END AS path,
  '/lib/' || o_orderpriority AS folder,
  md5(CAST(o_orderkey AS STRING)) AS hash,
  CAST(floor(o_totalprice) AS BIGINT) AS size,
  CAST(640 + (o_orderkey * 37) % 5000 AS INT) AS width,
  CAST(480 + (o_orderkey * 53) % 4000 AS INT) AS height,
  CASE WHEN o_orderkey % 11 = 0 THEN 'raw' WHEN o_orderkey % 11 = 3 THEN 'video' ELSE 'image' END AS media_type,
  CASE o_orderstatus WHEN 'F' THEN 'tagged' WHEN 'O' THEN 'pending' ELSE 'error' END AS status,
  CAST('2002-01-01' AS DATE) + CAST(o_orderkey % 365 AS INT) AS created_at,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date_taken,
  CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE md5(CAST(o_custkey AS STRING) || '|' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)) END AS phash,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE ((o_orderkey * 7919) % 20000) / 10.0E0 END AS blur_score,
  CAST(o_orderkey % 7 - 1 AS INT) AS rating,
  o_orderkey % 13 = 0 AS favorite,
  o_orderkey % 17 = 0 AS private,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 36.0E0 + (o_orderkey % 40) * 0.15E0 + (o_custkey % 9) * 0.002E0 END AS gps_lat,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 26.0E0 + (o_orderkey % 40) * 0.3E0 + (o_custkey % 7) * 0.002E0 END AS gps_lon
FROM {orders}""",
    "tags": """SELECT l.l_orderkey AS photo_id, p.p_name AS tag, max(l.l_discount * 10) AS confidence, min(CASE l.l_returnflag WHEN 'A' THEN 'manual' WHEN 'N' THEN 'p1' ELSE 'p2' END) AS source
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey, p.p_name""",
    "persons": "SELECT DISTINCT CAST(label AS BIGINT) + 1 AS person_id, 'Person ' || CAST(label AS STRING) AS name FROM {embeddings}",
    "faces": """SELECT vec_id AS face_id, vec_id * 3 AS photo_id, CAST(vec_id % 50 AS INT) AS x1, CAST(vec_id % 40 AS INT) AS y1, CAST(vec_id % 50 + 20 + vec_id % 30 AS INT) AS x2, CAST(vec_id % 40 + 24 + vec_id % 20 AS INT) AS y2,
  CASE WHEN vec_id % 3 = 0 THEN 'named' WHEN vec_id % 3 = 1 AND label >= 8 THEN 'skipped' ELSE 'unassigned' END AS assignment,
  CASE WHEN vec_id % 3 = 0 THEN CAST(label AS BIGINT) + 1 END AS person_id, embedding
FROM {embeddings}""",
    "provider_usage": "SELECT 'p' || CAST(user_id % 4 AS STRING) AS provider, event_id AS photo_id, event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 0.0E0 ELSE value / 1000000 END AS cost_usd, ts AS created_at FROM {events}",
    "collection_photos": "SELECT CAST(o_custkey % 5 AS BIGINT) AS collection_id, o_orderkey AS photo_id FROM {orders} WHERE o_orderkey % 8 = 0",
    "descriptions": "SELECT doc_id AS photo_id, text AS description FROM {documents}",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in RAW if "{%s}" % t in sql})


class Library:
    """The views of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)


def ctes(*names: str) -> str:
    """`WITH` clauses of the named views for DuckDB; all where none is named."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in RAW})})" for n in names or VIEWS)
