"""Near-duplicate vectors by cross-polytope hashing.

Vectors are rotated by rounds of random signs and fast Hadamard transforms; a hash is the axis, with its sign, that a
rotated vector comes closest to, and a table's key joins a few hashes. Each vector has its home bucket in every
table and probes the buckets it nearly fell into. Every candidate pair is verified by its cosine in double precision.
Buckets grow with the number of vectors: their keys have two bits more than its logarithm, the last hash of a key taking
only as many axes as are left. How many tables that needs follows from the share of random pairs at the threshold that
meet in one table, measured before the search, so that `recall` of them meet in some table at any length and size.

Groups of near copies would make all pairs of a bucket, so buckets first give cores: a vector joins the core of the
smallest pivot (the smallest id of a bucket) within half the threshold's angle. Any two vectors of one core are then
linked by the triangle inequality and are counted, not paired; only pairs across cores are verified one by one. All
joins are equi-joins that adaptive execution splits, and no group is gathered in a task.

Null, zero and non-finite vectors, and null ids, link with nothing and stay as rows. Ids repeated count as one vector
for links, the smallest of theirs, and the rows come back as often as they came. Lengths may be as large as doubles go. Vectors of another length than the most common one
are compared with their own length only. Labels and further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from wavelake.llm.common import connected_components, cross_pairs, store

#: Share of pairs at the threshold that must meet, bits of a key beyond the logarithm of the number of vectors, and rounds of a rotation.
RECALL, SPARE_BITS, ROUNDS = 0.995, 2, 3
#: Random pairs that the number of tables is measured on.
MEASURED = 1_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that no square overflows or vanishes."""
    return x / np.abs(x).max(axis=1, keepdims=True) if x.size else x


def keys_of(x: np.ndarray, tables: int, bits: int, probes: int, seed: int = 7) -> np.ndarray:
    """Keys (rows, tables, 1 + probes) of `bits` bits: the home bucket first, then those whose penalty is least."""
    n, d0 = x.shape
    d = 1 << max(1, (d0 - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - d0)))
    sizes = [min(d.bit_length(), bits - i) for i in range(0, bits, d.bit_length())]  # an axis and its sign take log2(2 d) bits
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        best, gap = [], []
        for h, own in enumerate(sizes):
            rng = np.random.default_rng((seed, t, h))
            z = x
            for _ in range(ROUNDS):
                z = hadamard(z * rng.choice([-1.0, 1.0], d))
            z = z[:, : 1 << (own - 1)]
            top = np.argsort(-np.abs(z), axis=1, kind="stable")[:, : probes + 1]
            v = np.take_along_axis(z, top, 1)
            best.append(2 * top + (v < 0))
            gap.append((np.abs(v[:, :1]) - np.abs(v)) ** 2)
        weights = [1 << sum(sizes[h + 1 :]) for h in range(len(sizes))]
        home = sum(b[:, 0] * w for b, w in zip(best, weights, strict=True))
        out[:, t, :] = home[:, None]
        # a probe replaces one hash by its next axes; the smallest losses first
        other = np.concatenate([home[:, None] + (b[:, 1:] - b[:, :1]) * w for b, w in zip(best, weights, strict=True)], axis=1)
        loss = np.concatenate([g[:, 1:] for g in gap], axis=1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, 1 : 1 + pick.shape[1]] = np.take_along_axis(other, pick, 1)
    return out


def plan(n: int, size: int, threshold: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(tables, bits, probes) for n vectors of a length: as many tables as let `recall` of pairs at the threshold meet."""
    bits = min(62, max(4, (max(n, 2) - 1).bit_length() + SPARE_BITS))
    probes = max(3, bits // 4)
    if size == 1:
        return 1, bits, probes
    rng = np.random.default_rng(size)
    x, y = rng.normal(size=(2, MEASURED, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    few = 4
    k = keys_of(np.vstack([x, y]), few, bits, probes)
    a, b = k[:MEASURED], k[MEASURED:]
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).mean()
    met = min(max(float(met), 0.01), 0.999)
    return max(few, math.ceil(math.log(1 - recall) / math.log(1 - met))), bits, probes


def matrix(column) -> np.ndarray:
    """A list column of equal lengths without nulls as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(x, y, ...) with cos, in double precision."""
    left = vectors.select(F.col("vec_id").alias("x"), F.col("embedding").alias("ex"))
    right = vectors.select(F.col("vec_id").alias("y"), F.col("embedding").alias("ey"))

    def run(batches):
        for b in batches:
            p, q = scaled(matrix(b.column(2))), scaled(matrix(b.column(3)))
            c = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q)) if len(p) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c, pa.float64())], names=["x", "y", "cos"])

    joined = pairs.select("x", "y").join(left, "x").join(right, "y").where(F.size("ex") == F.size("ey"))
    return joined.select("x", "y", "ex", "ey").mapInArrow(_by_length(run, 2), "x long, y long, cos double")


def _by_length(run, at: int):
    """run over batches whose vectors, in column `at`, have one length."""
    import pyarrow.compute as pc

    def parts(batches):
        for b in batches:
            sizes = pc.list_value_length(b.column(at))
            for n in pc.unique(sizes).to_pylist():
                yield b.filter(pc.equal(sizes, n))

    return lambda batches: run(parts(batches))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part; floats stay floats, which halves what is shuffled, and become doubles where they are used."""
    given = vectors.schema["embedding"].dataType
    e = F.col("embedding") if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine)


def links(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Cores (vec_id, core) of all usable vectors, and linked pairs (x, y) across cores."""
    v = store(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    # one row for each length of vectors that occurs
    plans = {size: plan(n, size, threshold, recall) for size, n in v.groupBy(F.size("embedding")).count().collect()}

    def hashed(batches):
        for b in batches:
            x = scaled(matrix(b.column(1)))
            if not len(x):
                continue
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            tables, bits, probes = plans[x.shape[1]]
            k = keys_of(x, tables, bits, probes)
            n, width = len(x), tables * (1 + probes)
            size = x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(b.column(0).to_numpy(), width)),
                    pa.array(np.tile(np.repeat(np.arange(tables), 1 + probes), n) + 1000 * size),
                    pa.array(k.reshape(-1)),
                    pa.array(np.tile(np.arange(1 + probes) == 0, n * tables)),
                ],
                names=["id", "tab", "key", "home"],
            )

    rows = store(v.select("vec_id", "embedding").mapInArrow(_by_length(hashed, 1), "id long, tab long, key long, home boolean"), "buckets")
    home = rows.where("home")
    pivots = home.groupBy("tab", "key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = home.join(pivots, ["tab", "key"]).where("id <> pivot").select(F.col("id").alias("x"), F.col("pivot").alias("y")).distinct()
    half = math.sqrt((1 + threshold) / 2) + 1e-9
    inside = cosine(near, v).where(F.col("cos") >= half).select(F.col("x").alias("vec_id"), F.col("y").alias("core"))
    pivots_own = pivots.select(F.col("pivot").alias("vec_id")).distinct().withColumn("core", F.col("vec_id"))
    core = inside.unionByName(pivots_own).groupBy("vec_id").agg(F.min("core").alias("core"))
    cores = store(v.select("vec_id").join(core, "vec_id", "left").select("vec_id", F.coalesce("core", "vec_id").alias("core")), "cores")
    own = rows.join(cores.select(F.col("vec_id").alias("id"), F.col("core").alias("grp")), "id")
    pairs = cross_pairs(own, ["tab", "key"], "a.home or b.home")
    return cores, store(cosine(pairs, v).where(F.col("cos") >= threshold).select("x", "y"), "links")


def dedup(vectors: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are those of the same core and those found across cores."""
    cores, found = links(vectors, threshold, **options)
    sizes = cores.groupBy("core").agg((F.count("*") - 1).alias("within")).where("within > 0")
    across = found.select(F.col("x").alias("vec_id")).unionByName(found.select(F.col("y").alias("vec_id"))).groupBy("vec_id").agg(F.count("*").alias("across"))
    counts = cores.join(sizes, "core", "left").join(across, "vec_id", "left")
    counts = counts.select("vec_id", "core", (F.coalesce("within", F.lit(0)) + F.coalesce("across", F.lit(0))).cast("long").alias("n_links"))
    # a core hangs below its smallest member, so that its id names one
    least = cores.groupBy("core").agg(F.min("vec_id").alias("least"))
    edges = cores.join(least, "core").where("vec_id <> least").select(F.col("vec_id").alias("a"), F.col("least").alias("b")).unionByName(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    comps = connected_components(edges)
    done = counts.join(comps.withColumnRenamed("id", "vec_id"), "vec_id", "left").select(F.col("vec_id").alias("k"), "n_links", "component")
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = all_rows.join(done, all_rows["vec_id"] == done["k"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
