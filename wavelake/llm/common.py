"""Shared pieces: the shared work folder, stored intermediates, hashing of rows, connected components."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts can be long, so batches stay small.
BATCH_ROWS = 512


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "wavelake-checkpoints"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get()
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, as whole texts are handed to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release_memory() -> None:
    """Hand freed memory back to the system: workers are reused, and what their allocators keep adds up over the stages of a job."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run):
    """run, a function over batches, after which its worker keeps no freed memory."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return held


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Paths of the tables stored in scratches that are open, the innermost last.
_SCRATCH: list[list[str]] = []


def store(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a written table: it survives lost executors and is read as often as needed."""
    path = new_path(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored within are removed at its end, but those that the function it gives was called on; these belong to the scratch around it, if there is one."""
    own: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(p for p in own if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in df.inputFiles()))
        return df

    _SCRATCH.append(own)
    try:
        yield keep
    finally:
        _SCRATCH.pop()
        for p in own:
            if p in kept:
                if _SCRATCH:
                    _SCRATCH[-1].append(p)
                continue
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, equals 0; a null id counts as held out, so it never trains."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def training_ids(labels: DataFrame, label: str, limit: int) -> tuple[list[tuple[int, int]], float]:
    """(doc_id, label) of at most `limit` training rows of each class, lowest hashes first, and what the bound did to the log odds.

    The second is to be added to the intercept of a logistic fit on these rows: the log odds of the classes over all
    training labels less those over the chosen ones, so 0 where the bound cut nothing or a class is missing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).distinct()
    ids = [[(r[0], r[1]) for r in known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()] for k in (0, 1)]
    if not ids[0] or not ids[1]:
        return [*ids[0], *ids[1]], 0.0
    if max(map(len, ids)) < limit:
        return [*ids[0], *ids[1]], 0.0
    total = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    return [*ids[0], *ids[1]], math.log(total[1] / len(ids[1])) - math.log(total[0] / len(ids[0]))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges(a, b): the smallest id reachable.

    Alternates large-star and small-star passes until the edge set stands still. Each pass is a partial
    aggregate and an equi-join (which adaptive execution splits where one hub is hot), and is stored, so
    that a lost executor costs one pass and nothing is gathered on the driver but one checksum.
    """
    with scratch(edges.sparkSession) as keep:
        e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
        mark = _checksum(e)
        while mark[0]:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
            large = both.join(low, both["u"] == low["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
            # every u keeps its smallest neighbour, and its other neighbours are hung below that one
            kept = low.select(F.col("k").alias("u"), F.col("m").alias("v"))
            moved = large.join(low, large["u"] == low["k"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = store(kept.unionByName(moved).distinct(), "cc")
            now = _checksum(e)
            if now == mark:
                break
            mark = now
        keep(e)
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def _checksum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.coalesce(F.expr("sum(cast(pmod(xxhash64(v, u), 1000003) as bigint))"), F.lit(0))).first())


def cross_pairs(rows: DataFrame, keys: list[str], keep: str = "") -> DataFrame:
    """(x, y), x < y, distinct: ids that share a key and are of different groups; rows have the keys, id and grp.

    In each key the group of the smallest id leads; only the other groups' rows are paired, with the leading
    group's rows and among themselves. So a key that one group fills, however large, makes no pairs within it.
    `keep` is a further condition on the two sides, named a and b.
    """
    lead = rows.groupBy(*keys).agg(F.min_by("grp", "id").alias("lead"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").drop("lo", "hi")
    mixed = rows.join(lead, keys)
    a, b = mixed.where("grp <> lead").alias("a"), mixed.alias("b")
    met = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    met += [F.expr("a.grp <> b.grp and (b.grp = b.lead or a.id < b.id)"), *([F.expr(keep)] if keep else [])]
    return a.join(b, met).select(F.least("a.id", "b.id").alias("x"), F.greatest("a.id", "b.id").alias("y")).distinct()
