"""Similarity over embedding vectors.

Pairs of rows and references are scored as matrix products: rows stay where they are, references come in bounded blocks.
A small reference side (its size is checked) is sent to every task; a larger one is cut into blocks and each block meets
each cut of the rows once, by an equi-join on block numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of reference vectors that are sent to every task.
BROADCAST_BYTES = 32 << 20
#: Vectors in a block of the blocked form.
BLOCK = 2048


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str, b: str) -> Column:
    """Full cosine within -1 and 1; 0 for other lengths or a tiny norm."""
    size = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (size > 1e-12)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.when(ok, size)))).otherwise(0.0)


def l2_normalise(df: DataFrame, col: str = "embedding") -> DataFrame:
    n = norm(col)
    return df.withColumn(col, F.when(n > 0, F.transform(col, lambda x: (x / n).cast("float"))).otherwise(F.col(col)))


def euclidean(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def decode_vectors(df: DataFrame, col: str, out: str = "embedding") -> DataFrame:
    """Binary little-endian float32 to array<float>; other lengths than whole floats give null."""

    def run(batches):
        for batch in batches:
            blobs = batch.column(batch.schema.get_field_index(col)).to_pylist()
            values = [None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist() for b in blobs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float32()))], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<float>")


def encode_vectors(col: str = "embedding") -> Column:
    """array<float> to binary little-endian float32, by way of the bits of each value."""

    @F.pandas_udf("binary")
    def pack(v):
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(F.col(col))


def quality_gate(df: DataFrame, least: float, col: str = "embedding") -> DataFrame:
    return df.withColumn(col, F.when(norm(col) >= least, F.col(col)))


def matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten(), np.float32)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


#: Vectors that pivots are chosen from, how many pivots, and rows of a block that is multiplied.
SAMPLE, PIVOTS, TILE = 4096, 32, 512


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample that lie far from one another: each next one is the farthest from all before."""
    if not len(sample):
        return sample.astype(np.float64)
    m = sample.astype(np.float64)
    at = [0]
    far = np.linalg.norm(m - m[0], axis=1)
    while len(at) < min(n, len(m)) and far.max() > 1e-9:
        at.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(m - m[at[-1]], axis=1))
    return m[at]


def distances(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of vectors to pivots, and the vectors' squares."""
    m = m.astype(np.float64)
    squares = (m * m).sum(1)
    return np.sqrt(np.maximum(0, squares[:, None] + (pivots * pivots).sum(1)[None] - 2 * m @ pivots.T)), squares


class Tiles:
    """Vectors in order of their nearest pivot, cut into tiles, each with the range of its distances to every pivot."""

    def __init__(self, m: np.ndarray, pivots: np.ndarray, size: int = TILE):
        blocks = [m[lo : lo + BLOCK] for lo in range(0, len(m), BLOCK)]
        cell = np.concatenate([distances(x, pivots)[0].argmin(1) for x in blocks]) if len(m) else np.zeros(0, np.int64)
        self.order = np.argsort(cell, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(cell[self.order]) > 0]) if len(m) else np.zeros(0, np.int64)
        ends = np.r_[heads[1:], len(m)]
        self.heads = np.array([x for a, b in zip(heads, ends, strict=True) for x in range(a, b, size)], np.int64)
        self.ends = np.r_[self.heads[1:], len(m)][: len(self.heads)]
        self.vectors = m[self.order]  # as they came; a tile is widened when it is multiplied
        if len(m):
            far = [distances(self.vectors[a:b], pivots) for a, b in zip(self.heads, self.ends, strict=True)]
            self.low, self.high = (np.array([f(d, axis=0) for d, _ in far]) for f in (np.min, np.max))
            self.squares = np.array([q.max() for _, q in far])

    def tile(self, i: int) -> np.ndarray:
        return self.vectors[self.heads[i] : self.ends[i]].astype(np.float64)

    def meets(self, other: Tiles, least: float) -> np.ndarray:
        """Which tiles of other can hold a vector whose product with one of a tile is `least`: by the triangle inequality,
        distances of such two to any pivot differ by no more than their own distance."""
        if not len(self.heads) or not len(other.heads):
            return np.zeros((len(self.heads), len(other.heads)), bool)
        eps = np.sqrt(np.maximum(0, self.squares[:, None] + other.squares[None] - 2 * least)) + 1e-5
        gap = np.maximum(other.low[None] - self.high[:, None], self.low[:, None] - other.high[None]).max(2)
        return gap <= eps


def similarity_pairs(rows: DataFrame, refs: DataFrame, least: float, row_id: str = "face_id", ref_id: str = "ref_id", col: str = "embedding") -> DataFrame:
    """(row_id, ref_id, sim): every pair of unit vectors whose product is at least `least`. Rows without a vector take no part.

    Pivots are chosen from a sample of SAMPLE references; they decide which tiles are multiplied, never the result. Each
    block of rows and of references is put in order of its nearest pivots, and only tiles that can hold a pair meet.
    """
    sample = refs.select(col).filter(F.col(col).isNotNull()).orderBy(F.xxhash64(col)).limit(SAMPLE).toArrow()
    pivots = choose_pivots(matrix(sample[col]))
    held: list = [None, None]  # the references that a task was sent last, and their tiles

    def hits(ids, vectors, ref_ids, ref_vectors):
        if not len(pivots) or vectors.shape[1] != pivots.shape[1]:
            return
        if held[0] is not ref_vectors:
            held[:] = ref_vectors, Tiles(ref_vectors, pivots)
        mine, theirs = Tiles(vectors, pivots), held[1]
        for a, b in zip(*np.nonzero(mine.meets(theirs, least)), strict=True):
            x, y = slice(mine.heads[a], mine.ends[a]), slice(theirs.heads[b], theirs.ends[b])
            sims = mine.tile(a) @ theirs.tile(b).T
            i, j = np.nonzero(sims >= least)
            if len(i):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine.order[x][i])), ref_ids.take(pa.array(theirs.order[y][j])), pa.array(sims[i, j])], [row_id, ref_id, "sim"])

    return _products(rows, refs, row_id, ref_id, col, hits, "sim double")


def similarity_groups(rows: DataFrame, refs: DataFrame, least: float, support: float = 2.0, row_id: str = "face_id", group: str = "person_id", col: str = "embedding", keep: int | None = None) -> DataFrame:
    """(row_id, group, top, sup): for each row and group of references the greatest product, from `least` on, and how many
    reach `support`. The kernel brings a block of references down to its groups before anything leaves the task, and these
    states are merged by key.

    keep: only the best groups of each row matter; where every group is one reference, a block sends no more than those.
    """

    def hits(ids, vectors, keys, ref_vectors):
        names = keys.to_numpy(zero_copy_only=False)
        order = np.argsort(names, kind="stable")
        for lo in range(0, len(order), BLOCK):
            at = order[lo : lo + BLOCK]
            first = np.flatnonzero(np.r_[True, names[at[1:]] != names[at[:-1]]])
            sims = vectors.astype(np.float64) @ ref_vectors[at].astype(np.float64).T
            top = np.maximum.reduceat(sims, first, axis=1)
            sup = np.add.reduceat((sims >= support).astype(np.int64), first, axis=1)
            ok = top >= least
            if keep is not None and top.shape[1] > keep:
                best = np.argsort(-top, axis=1, kind="stable")[:, :keep]  # equal ones by the group's order
                among = np.zeros_like(ok)
                np.put_along_axis(among, best, True, axis=1)
                ok &= among
            i, j = np.nonzero(ok)
            if len(i):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), keys.take(pa.array(at[first[j]])), pa.array(top[i, j]), pa.array(sup[i, j])], [row_id, group, "top", "sup"])

    states = _products(rows, refs, row_id, group, col, hits, "top double, sup long")
    return states.groupBy(row_id, group).agg(F.max("top").alias("top"), F.sum("sup").alias("sup"))


def similarity_counts(rows: DataFrame, refs: DataFrame, least: float, row_id: str = "face_id", ref_id: str = "ref_id", col: str = "embedding") -> DataFrame:
    """(row_id, n): for each row and block of references, how many of another id reach `least`."""

    def hits(ids, vectors, keys, ref_vectors):
        own, names = (x.to_numpy(zero_copy_only=False) for x in (ids, keys))
        n = np.zeros(len(own), np.int64)
        for lo in range(0, len(names), BLOCK):
            near = vectors.astype(np.float64) @ ref_vectors[lo : lo + BLOCK].astype(np.float64).T >= least
            n += (near & (own[:, None] != names[None, lo : lo + BLOCK])).sum(1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), keys.take(pa.array(np.zeros(len(some), np.int64))), pa.array(n[some])], [row_id, ref_id, "n"])

    return _products(rows, refs, row_id, ref_id, col, hits, "n long").select(row_id, "n")


def similarity_least(rows: DataFrame, refs: DataFrame, least: float, row_id: str = "face_id", key: str = "label", col: str = "embedding") -> DataFrame:
    """(row_id, key): for each row and block of references, the smallest key of those that reach `least`."""

    def hits(ids, vectors, keys, ref_vectors):
        names = keys.to_numpy(zero_copy_only=False)
        order = np.argsort(names, kind="stable")
        first = np.full(len(vectors), -1)
        for lo in range(0, len(order), BLOCK):
            left = np.flatnonzero(first < 0)
            near = vectors[left].astype(np.float64) @ ref_vectors[order[lo : lo + BLOCK]].astype(np.float64).T >= least
            some = near.any(1)
            first[left[some]] = order[lo + near[some].argmax(1)]
        met = np.flatnonzero(first >= 0)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(met)), keys.take(pa.array(first[met]))], [row_id, key])

    return _products(rows, refs, row_id, key, col, hits, "").select(row_id, key)


def _products(rows: DataFrame, refs: DataFrame, row_id: str, key: str, col: str, hits, found: str) -> DataFrame:
    """What hits(row ids, row vectors, reference keys, reference vectors) gives for blocks of rows and references, all with all."""
    rows, refs = rows.select(row_id, col).filter(F.col(col).isNotNull()), refs.select(key, F.col(col)).filter(F.col(col).isNotNull())
    kinds = f"{row_id} {rows.schema[row_id].dataType.simpleString()}, {key} {refs.schema[key].dataType.simpleString()}{', ' * bool(found)}{found}"
    about = refs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(col)), F.lit(0)).alias("d")).first()

    def met(ids, vectors, keys, ref_vectors):
        if len(vectors) and len(ref_vectors) and vectors.shape[1] == ref_vectors.shape[1]:
            yield from hits(ids, vectors, keys, ref_vectors)

    if about.n * about.d * 4 <= BROADCAST_BYTES:
        table = refs.toArrow().combine_chunks()
        blob = rows.sparkSession.sparkContext.broadcast((table[key].combine_chunks() if len(table) else pa.array([], pa.int64()), matrix(table[col])))

        def run(batches):
            keys, ref_vectors = blob.value
            for batch in batches:
                for lo in range(0, len(batch), BLOCK):
                    part = batch.slice(lo, BLOCK)
                    yield from met(part.column(0), matrix(part.column(1)), keys, ref_vectors)

        return rows.mapInArrow(run, kinds)

    n = rows.agg(F.count(F.lit(1)).alias("n")).first().n
    row_cuts, ref_cuts = max(1, -(-n // BLOCK)), max(1, -(-about.n // BLOCK))
    left = rows.withColumn("rc", F.pmod(F.xxhash64(row_id), F.lit(row_cuts)).cast("int")).groupBy("rc").agg(F.collect_list(F.struct(F.col(row_id).alias("i"), F.col(col).alias("v"))).alias("l"))
    # by the vector, so that a group of any size is spread
    right = refs.withColumn("fc", F.pmod(F.xxhash64(key, col), F.lit(ref_cuts)).cast("int")).groupBy("fc").agg(F.collect_list(F.struct(F.col(key).alias("i"), F.col(col).alias("v"))).alias("r"))
    # each cut of the rows goes to each block of references: (cuts x blocks) tasks' worth of products
    both = left.withColumn("fc", F.explode(F.sequence(F.lit(0), F.lit(ref_cuts - 1)))).repartition(row_cuts * ref_cuts if row_cuts * ref_cuts < 10_000 else 10_000, "rc", "fc").join(right, "fc").select("l", "r")

    def blocks(batches):
        for batch in batches:
            for k in range(len(batch)):
                left, right = batch.column(0)[k].values, batch.column(1)[k].values
                yield from met(left.field("i"), matrix(left.field("v")), right.field("i"), matrix(right.field("v")))

    return both.mapInArrow(blocks, kinds)


#: Queries that meet a block of rows at once.
QUERY_BLOCK = 256


class Best:
    """The k rows nearest to each query so far, ties to the lower id. Queries meet a block of rows QUERY_BLOCK at a time, and
    only rows that reach a query's k-th best are ordered, so what is held is k rows a query and one product of two blocks."""

    def __init__(self, n: int, k: int, least: float):
        self.k, self.worst = k, np.full(n, least, np.float64)
        self.held: list = [None] * -(-n // QUERY_BLOCK)  # (query, row, sim) of each block of queries, in order

    def take(self, queries: np.ndarray, m: np.ndarray, names: np.ndarray) -> None:
        for b, lo in enumerate(range(0, len(queries), QUERY_BLOCK)):
            sims = queries[lo : lo + QUERY_BLOCK].astype(np.float64) @ m.T
            q, r = np.nonzero(sims >= self.worst[lo : lo + QUERY_BLOCK, None])
            if len(q):
                self._merge(b, lo, (q + lo, names[r], sims[q, r]))

    def _merge(self, b: int, lo: int, new: tuple) -> None:
        q, r, s = new if self.held[b] is None else (np.concatenate(x) for x in zip(self.held[b], new, strict=True))
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        kept = place < self.k
        self.held[b] = q[kept], r[kept], s[kept]
        last = place == self.k - 1
        self.worst[q[last]] = s[last]

    def rows(self):
        return (h for h in self.held if h is not None)


def topk_per_query(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "face_id", query_id: str = "query_id", col: str = "embedding", least: float = -2.0, group: str | None = None) -> DataFrame:
    """(query_id, row_id, sim, rank): the k rows nearest to each query, ties to the lower id.

    Each task keeps its own k best of each query, so what is ranked is k rows a query and task. Queries are a bounded
    set: they are sent to every task after a check of their size.
    """
    q = queries.select(query_id, F.col(col)).filter(F.col(col).isNotNull())
    about = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(col)), F.lit(0)).alias("d")).first()
    rows = rows.select(row_id, col).filter(F.col(col).isNotNull())
    if about.n * about.d * 4 > BROADCAST_BYTES:  # too many for every task: part by part
        parts = -(-about.n * about.d * 4 // BROADCAST_BYTES)
        out = None
        for i in range(parts):
            part = topk_per_query(rows, q.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == i), k, row_id, query_id, col, least)
            out = part if out is None else out.unionByName(part)
        return out
    table = q.toArrow().combine_chunks()
    blob = rows.sparkSession.sparkContext.broadcast((table[query_id].combine_chunks() if len(table) else pa.array([], pa.int64()), matrix(table[col])))

    def run(batches):
        ids, vectors = blob.value
        best, row_kind = Best(len(ids), k, least), None
        for batch in batches:
            row_kind = batch.schema.field(0).type
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                m = matrix(part.column(1)).astype(np.float64)
                if len(ids) and len(m) and m.shape[1] == vectors.shape[1]:
                    best.take(vectors, m, np.asarray(part.column(0)))
        for qi, ri, sims in best.rows():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(qi)), pa.array(ri, row_kind), pa.array(sims)], [query_id, row_id, "sim"])

    kinds = f"{query_id} {q.schema[query_id].dataType.simpleString()}, {row_id} {rows.schema[row_id].dataType.simpleString()}, sim double"
    best = rows.mapInArrow(run, kinds)
    w = Window.partitionBy(query_id).orderBy(F.desc("sim"), row_id)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def semantic_search(rows: DataFrame, queries: DataFrame, k: int = 200, least: float = 0.20, **names) -> DataFrame:
    """Of each query the k nearest rows of at least `least`."""
    return topk_per_query(rows, queries, k, **names).filter(F.col("sim") >= least)


def find_similar(rows: DataFrame, ids: DataFrame, k: int, row_id: str = "face_id") -> DataFrame:
    """The k nearest other rows of each of ids(row_id)."""
    queries = rows.join(ids.select(row_id), row_id, "left_semi").select(F.col(row_id).alias("query_id"), "embedding")
    near = topk_per_query(rows, queries, k + 1, row_id=row_id).filter(F.col("query_id") != F.col(row_id))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), row_id)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mean_vector(rows: DataFrame, keys: list[str], col: str = "embedding") -> DataFrame:
    """keys and the mean vector: positions are averaged apart, so a large group is no large task."""
    each = rows.select(*keys, F.posexplode(col).alias("_p", "_x")).groupBy(*keys, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(col))


def flag_sensitive(rows: DataFrame, prompts: DataFrame, least: float) -> DataFrame:
    """rows with nsfw_score, the product with the prompts' mean vector, and flagged."""
    centre = mean_vector(prompts.withColumn("_g", F.lit(1)), ["_g"]).select(F.col("embedding").alias("_c"))
    return rows.crossJoin(F.broadcast(centre)).withColumn("nsfw_score", dot("embedding", "_c")).withColumn("flagged", F.col("nsfw_score") >= least).drop("_c")  # one row


def zero_shot_filter(rows: DataFrame, prompts: DataFrame, margin: float = 0.035) -> DataFrame:
    """rows kept unless another prompt beats the first (ord 0) by the margin or more."""
    p = prompts.agg(F.sort_array(F.collect_list(F.struct("ord", "embedding"))).alias("_p"))  # a handful of prompts
    scored = rows.crossJoin(F.broadcast(p)).withColumn("_s", F.transform("_p", lambda x: dot(F.col("embedding"), x["embedding"])))
    return scored.withColumn("gap", F.array_max(F.slice("_s", 2, 1_000_000)) - F.get("_s", F.lit(0))).filter(F.col("gap") < margin).drop("_p", "_s")


def robust_centroid(rows: DataFrame, key: str, col: str = "embedding") -> DataFrame:
    """(key, n, embedding): the unit mean of each group, made again without members far from it.

    With four members or more, those below mean - 1.5 deviations of similarity go, unless fewer than max(2, half) stay.
    Built from sums by position, so groups of any size are fine.
    """

    def unit(df: DataFrame) -> DataFrame:
        sized = df.withColumn("_n", norm(col))
        return sized.withColumn(col, F.when(F.col("_n") > 0, F.transform(col, lambda x: x / F.col("_n"))).otherwise(F.col(col))).drop("_n")

    first = unit(mean_vector(rows, [key], col)).withColumnRenamed(col, "_c")
    sized = rows.join(first, key).withColumn("_s", dot(col, "_c"))
    stats = sized.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.avg("_s") - 1.5 * F.stddev_pop("_s")).alias("_low"))
    marked = sized.join(stats, key).withColumn("_in", (F.col("n") < 4) | (F.col("_s") >= F.col("_low")))
    kept = marked.groupBy(key).agg(F.count_if("_in").alias("_k"))
    used = marked.join(kept, key).filter(F.col("_in") | (F.col("_k") < F.greatest(F.lit(2), F.floor(F.col("n") / 2))))
    return unit(mean_vector(used, [key], col)).join(stats.select(key, "n"), key)


def embed_batch(rows: DataFrame, encode, tier: str, id_col: str = "photo_id", input_col: str = "input") -> DataFrame:
    """(id, embedding, tier) of rows by a caller's batch encoder (list of inputs -> list of vectors or None); failures are left out."""

    def run(batches):
        for batch in batches:
            vectors = encode(batch.column(1).to_pylist())
            ok = [i for i, v in enumerate(vectors) if v is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok, pa.int64())), pa.array([list(map(float, vectors[i])) for i in ok], pa.list_(pa.float32())), pa.array([tier] * len(ok), pa.string())], [id_col, "embedding", "tier"])

    return rows.select(id_col, input_col).mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, embedding array<float>, tier string")
