"""Nearest neighbours by an inverted multi-index.

Both halves of the vectors, less the sample's mean, are quantised by their own codebook; a row's cell is its pair of
nearest centroids. A query takes cells in ascending summed distance, found with a heap over the two sorted lists of
centroid distances, until the cells hold a wanted number of rows, and these are reranked by exact distance in double
precision.

Codebooks are fitted on a bounded sample (`sample` rows, lowest hashes); every row is indexed. How many rows a query
must take is measured against brute force on the whole index: at most PROBES queries (lowest hashes) meet all rows once,
and `recall` of their true neighbours must lie in the cells taken. So a query's work follows from where neighbours lie,
not from a share of the table, and all queries' work grows with their number.

Cells are cut into blocks of about `BLOCK` rows by a hash, so a cell with a third of all rows is many blocks; queries
come in blocks too, and a block of queries meets a block of rows in one task as two small matrices. Rows that rounding
could hide are kept by a margin relative to the lengths, and ranked exactly. A query's best of each block go to one
last ranking, which Spark limits before it shuffles.

Null, zero and non-finite vectors and null ids take no part. Ties go to the smaller id. Fewer candidates than k give
fewer rows. Repeated ids are rows of their own. Vectors of another length than the sample's most common one take
no part. Empty tables give no rows; labels and further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import store
from wavelake.llm.embed_dedup import matrix, usable

SAMPLE, BLOCK, QUERIES, MOST_CENTROIDS, ROWS_A_CELL = 20_000, 2048, 512, 1024, 200
#: Queries that are compared with every row, to measure how many rows a query must take.
PROBES = 100


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: float):
    """Cells (as i * k + j) in ascending d1[i] + d2[j] until they hold `wanted` rows: a pair enters the heap when its predecessors in both lists have left it."""
    k = len(d2)
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    heap, got = [(float(d1[o1[0]] + d2[o2[0]]), 0, 0)], 0
    depth = np.zeros(len(d1), np.int64)  # pairs taken of each first half, in its rank
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * k + int(o2[j])
        depth[i] = j + 1
        if counts[cell]:
            got += int(counts[cell])
            yield cell
        if i + 1 < len(d1) and (depth[i + 1] == j):
            heapq.heappush(heap, (float(d1[o1[i + 1]] + d2[o2[j]]), i + 1, j))
        if j + 1 < k and (i == 0 or depth[i - 1] > j + 1):
            heapq.heappush(heap, (float(d1[o1[i]] + d2[o2[j + 1]]), i, j + 1))


def fit(v: DataFrame, n: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean and both codebooks of the centred halves."""
    rows = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    lists = rows.column(0).to_pylist()
    size = max(set(map(len, lists)), key=lambda s: (sum(len(x) == s for x in lists[:1000]), s))
    x = np.array([a for a in lists if len(a) == size], float)
    mean = x.mean(axis=0)
    x -= mean
    half = max(1, size // 2)
    k = int(np.clip((n / ROWS_A_CELL) ** 0.5, 1, min(MOST_CENTROIDS, len(x))))
    return mean, kmeans(x[:, :half], k), kmeans(x[:, half:], k)


def closest(x: np.ndarray, y: np.ndarray, own: np.ndarray, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in y, exact distances) of the m rows nearest to x that aren't its own, ties to smaller ids; `own` holds approximate squared distances."""
    m = min(m, int(np.isfinite(own).sum()))
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0)
    margin = 1e-12 * (float(x @ x) + float((y * y).sum(1).max()))
    near = np.flatnonzero(own <= np.partition(own, m - 1)[m - 1] + margin)
    exact = np.sqrt(((y[near] - x) ** 2).sum(1))
    best = np.lexsort((ids[near], exact))[:m]
    return near[best], exact[best]


def rows_needed(indexed: DataFrame, asked: DataFrame, mean, c1, c2, counts: np.ndarray, k: int, recall: float) -> int:
    """Rows that a query must take, by the measure above."""
    half, size, k2 = c1.shape[1], len(mean), len(c2)
    rows = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).collect()
    if not rows:
        return 0
    names, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float).reshape(len(rows), size) - mean

    def best(batches):
        found = [[] for _ in names]
        for b in batches:
            ids, y, cells = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy()
            if not len(ids):
                continue
            y = y - mean
            d = distances(x, y)
            d[names[:, None] == ids[None, :]] = np.inf
            for i, own in enumerate(d):
                near, exact = closest(x[i], y, own, ids, k)
                found[i] = sorted(found[i] + list(zip(exact.tolist(), ids[near].tolist(), cells[near].tolist(), strict=True)))[:k]
        flat = [(i, *r) for i, own in enumerate(found) for r in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), [pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], names=["q", "score", "vec_id", "cell"])

    w = Window.partitionBy("q").orderBy("score", "vec_id")
    every = indexed.mapInArrow(best, "q long, score double, vec_id long, cell long")
    true: dict[int, set] = {}
    hits: list[tuple[int, int]] = [(r[0], r[1]) for r in every.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "cell").collect()]
    for q, cell in hits:
        true.setdefault(q, set()).add(cell)
    at: dict[tuple[int, int], int] = {}
    for q, cells in true.items():
        seen, left = 0, set(cells)
        for cell in traverse(distances(x[q : q + 1, :half], c1)[0], distances(x[q : q + 1, half:], c2)[0], counts, np.inf):
            seen += int(counts[cell])
            if cell in left:
                at[q, cell] = seen
                left.discard(cell)
                if not left:
                    break
    need = sorted(at[h] for h in hits)
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))))] if need else 0


def search(vectors: DataFrame, queries: DataFrame | None = None, every: int = 100, k: int = 10, recall: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found. Queries are vectors whose id `every` divides, or the given ones."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    v = store(usable(vectors), "index-rows")
    n = v.count()
    if not n:
        return spark.createDataFrame([], schema)
    mean, c1, c2 = fit(v, n, sample)
    half, size, k2 = c1.shape[1], len(mean), len(c2)
    element = v.schema["embedding"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            x = matrix(b.column(1))
            x = x - mean if len(x) else x
            cells = nearest(x[:, :half], c1) * k2 + nearest(x[:, half:], c2) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.astype(np.int64))], names=["vec_id", "embedding", "cell"])

    indexed = store(v.where(F.size("embedding") == size).mapInArrow(assign, f"vec_id long, embedding {element}, cell long"), "index")
    counts = np.zeros(len(c1) * k2, np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most as many rows as there are cells, a fixed bound
        counts[r[0]] = r[1]
    q = usable(queries).select("vec_id", F.col("embedding").cast(element).alias("embedding")) if queries is not None else v.where(F.pmod("vec_id", F.lit(every)) == 0)
    q = q.where(F.size("embedding") == size)
    wanted = rows_needed(indexed, q, mean, c1, c2, counts, k, recall)

    def route(batches):
        for b in batches:
            x = matrix(b.column(1))
            ids, cells, at = b.column(0).to_pylist(), [], []
            if len(x):
                x = x - mean
                d1, d2 = distances(x[:, :half], c1), distances(x[:, half:], c2)
                for i in range(len(x)):
                    own = list(traverse(d1[i], d2[i], counts, wanted))
                    cells += own
                    at += [i] * len(own)
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(took), b.column(1).take(took), pa.array(cells, pa.int64())], names=["vec_id", "embedding", "cell"])

    routed = q.select("vec_id", "embedding").mapInArrow(route, f"vec_id long, embedding {element}, cell long")
    n_queries = max(1, -(-q.count() // QUERIES))
    held = F.struct("vec_id", "embedding")
    asked = routed.groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).alias("qb")).agg(F.collect_list(held).alias("q"))
    per_cell = indexed.groupBy("cell").agg(F.count("*").alias("n"))
    blocks = indexed.join(per_cell, "cell").groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BLOCK)).alias("rb")).agg(F.collect_list(held).alias("r"))

    def rank(batches):
        for b in batches:
            out = ([], [], [])
            for a, c in zip(b.column(0), b.column(1), strict=True):
                qi, x = _unpack(a.values)
                ri, y = _unpack(c.values)
                x0, y0 = x - mean, y - mean
                d = distances(x0, y0)
                d[qi[:, None] == ri[None, :]] = np.inf
                for i in range(len(qi)):
                    near, _ = closest(x0[i], y0, d[i], ri, k)
                    exact = np.sqrt(((y[near] - x[i]) ** 2).sum(1))
                    out[0].extend([int(qi[i])] * len(near))
                    out[1].extend(ri[near].tolist())
                    out[2].extend(exact.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = asked.join(blocks, "cell").select("q", "r").mapInArrow(rank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpack(structs) -> tuple[np.ndarray, np.ndarray]:
    return structs.field("vec_id").to_numpy(), matrix(structs.field("embedding"))
