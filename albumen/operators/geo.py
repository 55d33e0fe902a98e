"""Distance and clustering of coordinates."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import components, cut
from .stats import taken, visible

RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * RADIUS_KM)


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS_KM * math.asin(min(1.0, math.sqrt(a)))


class Centres:
    """Cluster centres of one connected set, in a grid of cells that a circle of the radius spans at most three by three of."""

    def __init__(self, radius: float):
        self.radius, self.angle = radius, radius / RADIUS_KM
        self.side = math.degrees(self.angle) * 1.01
        self.centres: list[tuple[float, float, int, int]] = []  # lat, lon, members, name
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.columns: dict[int, int] = {}

    def _columns(self, row: int) -> int:
        """How many cells a row has: as many as fit while neighbouring ones cover the radius, one next to a pole."""
        if row not in self.columns:
            edge = max(abs(row), abs(row + 1)) * self.side + self.side
            reach = math.sin(self.angle / 2) / math.cos(math.radians(edge)) if edge < 89 else 1.0
            self.columns[row] = max(1, int(360 / math.degrees(2.02 * math.asin(reach)))) if reach < 0.9 else 1
        return self.columns[row]

    def _cell(self, lat: float, lon: float, row: int) -> int:
        n = self._columns(row)
        return int((lon + 180) % 360 / 360 * n) % n

    def join(self, lat: float, lon: float, n: int, name: int) -> int:
        """The name of the cluster that n points at a place join: the nearest centre within the radius, else a new one."""
        row = math.floor(lat / self.side)
        best, at = (self.radius, math.inf), None
        for r in (row - 1, row, row + 1):
            columns, c = self._columns(r), self._cell(lat, lon, r)
            for x in {(c - 1) % columns, c, (c + 1) % columns}:
                for i in self.cells.get((r, x), ()):
                    found = (_km(lat, lon, *self.centres[i][:2]), i)
                    if found <= best:
                        best, at = found, i
        if at is None:
            at = len(self.centres)
            self.centres.append((lat, lon, n, name))
            self.cells.setdefault((row, self._cell(lat, lon, row)), set()).add(at)
            return name
        a, b, c, name = self.centres[at]
        moved = (a + (lat - a) * n / (c + n), b + (lon - b) * n / (c + n))
        self.centres[at] = (*moved, c + n, name)
        was, now = ((r, self._cell(y, x, r)) for y, x in ((a, b), moved) for r in (math.floor(y / self.side),))
        if was != now:
            self.cells[was].discard(at)
            self.cells.setdefault(now, set()).add(at)
        return name


def gps_clusters(photos: DataFrame, radius: float = 1.5, least: int = 3) -> DataFrame:
    """(photo_id, cluster_id) of visible photos with coordinates, in clusters of at least `least`; cluster_id is the first photo's.

    Photos join, in order of their ids, the nearest cluster centre within the radius; photos of equal coordinates join
    together, at the place of the first. Points that could ever meet lie in connected cells of a grid of 2.1 radii, so
    each connected set is worked through by itself, at any size by the same rule: its coordinates pass through a task as a
    stream in order, and what the task holds is the set's centres. Every step depends on the centres that the steps before
    have moved, so a set is one task's time, some ten microseconds a coordinate.
    """
    side = 2.1 * radius / (RADIUS_KM * math.pi / 180)  # degrees of latitude
    p = visible(photos).filter("gps_lat is not null and gps_lon is not null").select("photo_id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    band = F.floor(F.col("lat") / side)
    # columns as narrow as the row of cells nearest to the pole allows, the same for three neighbouring rows' sake
    edge = F.least(F.lit(89.0), F.greatest(F.abs(F.floor(band / 8) * 8 * side), F.abs((F.floor(band / 8) * 8 + 8) * side)))
    p = p.withColumn("cy", band).withColumn("wide", F.lit(side) / F.cos(F.radians(edge))).withColumn("cx", F.floor(F.col("lon") / F.col("wide")))
    cell = lambda y, x: F.xxhash64(y, x)
    p = cut(p.withColumn("cell", cell(F.col("cy"), F.col("cx"))).withColumn("zone", F.floor(F.col("cy") / 8)))
    cells = p.groupBy("cell", "cy", "cx", "zone", "wide").agg(F.count(F.lit(1)).alias("n"))
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    around = cells.select("cell", "zone", step.alias("s"), "cy", "cx").select(F.col("cell").alias("a"), "zone", (F.col("cy") + F.col("s.dy")).alias("cy"), (F.col("cx") + F.col("s.dx")).alias("cx"))
    same = around.join(cells.select(F.col("cell").alias("b"), "zone", "cy", "cx"), ["zone", "cy", "cx"]).select("a", "b")
    # across a change of column width, rows of cells meet by overlap in longitude, a step to either side
    low = cells.filter(F.pmod("cy", F.lit(8)) == 7)
    high = cells.filter(F.pmod("cy", F.lit(8)) == 0)
    span = lambda c, w: F.sequence(F.floor((F.col(c) - 1) * F.col("wide") / w), F.floor((F.col(c) + 2) * F.col("wide") / w))
    widths = cells.groupBy("zone").agg(F.max("wide").alias("w2"))
    up = low.join(widths.select((F.col("zone") - 1).alias("zone"), "w2"), "zone").select(F.col("cell").alias("a"), (F.col("cy") + 1).alias("cy"), F.explode(span("cx", F.col("w2"))).alias("cx"))
    across = up.join(high.select(F.col("cell").alias("b"), "cy", "cx"), ["cy", "cx"]).select("a", "b")
    edges = same.unionByName(across).unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    sets = components(edges, cells.select(F.col("cell").alias("node")).distinct()).select(F.col("node").alias("cell"), F.col("label").alias("set"))

    points = p.groupBy("cell", "cy", "zone", "wide", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.min("photo_id").alias("photo_id"))
    points = points.join(sets, "cell")

    def run(batches):
        held, centres = None, None
        for batch in batches:
            names = []
            for label, photo, lat, lon, n in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if label != held:
                    held, centres = label, Centres(radius)
                names.append(centres.join(lat, lon, n, photo))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (2, 3, 4)), pa.array(names, pa.int64())], ["lat", "lon", "n", "cluster_id"])

    dealt = points.select("set", "photo_id", "lat", "lon", "n").repartition("set").sortWithinPartitions("set", "photo_id")
    found = cut(dealt.mapInArrow(run, "lat double, lon double, n long, cluster_id long"))
    keep = found.groupBy("cluster_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("cluster_id")
    kept = cut(found.join(keep, "cluster_id", "left_semi").select("lat", "lon", "cluster_id"))
    return p.join(kept, ["lat", "lon"]).select("photo_id", "cluster_id")


def list_clusters(photos: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, n, lat, lon, first_day, last_day) of members (photo_id, cluster_id)."""
    rows = photos.join(clusters, "photo_id").withColumn("_d", taken())
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gps_lat").alias("lat"), F.avg("gps_lon").alias("lon"), F.min("_d").alias("first_day"), F.max("_d").alias("last_day"))


def clusters_to_collections(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """members with a collection for each cluster, numbered from the highest there is; a number for each cluster, not for each photo."""
    top = members.agg(F.coalesce(F.max("collection_id"), F.lit(0)).alias("_top"))
    ids = clusters.select("cluster_id").distinct().withColumn("_i", F.row_number().over(Window.orderBy("cluster_id")))
    new = clusters.join(ids, "cluster_id").crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_i")).cast("long").alias("collection_id"), "photo_id")
    return members.select("collection_id", "photo_id").unionByName(new)
