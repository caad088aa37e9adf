"""Transactions put together from records: by id, across blocks, with attributes, metadata, links and streams.

Records are the data source's: (keys, block, seq, tag, stream_inst_id, txn_type_id, txn_id, start_time, end_time,
parent_txn_id, attrs, link_type, target_txn_id, label, key, value). All aggregates combine before their shuffle; none
gathers a transaction's records in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.session import stored

PLACE = ("block", "seq")


def assembled(records: DataFrame, keys: tuple[str, ...] = ("trace",)) -> DataFrame:
    """One row for each transaction that begins: stream, type, start, end (null while open), duration, parent, and how many attributes, metadata entries and links it has. Of several beginnings the first counts, of several ends the last."""
    place = F.struct(*PLACE)
    begins = F.col("tag").isin("FULL", "BEGIN")
    out = records.groupBy(*keys, "txn_id").agg(
        F.min_by(F.struct("stream_inst_id", "txn_type_id", "start_time", "parent_txn_id"), F.when(begins, place)).alias("_b"),
        F.max_by(F.col("end_time"), F.when(F.col("tag").isin("FULL", "END"), place)).alias("end_time"),
        F.sum(F.coalesce(F.size("attrs"), F.lit(0))).cast("long").alias("n_attrs"),
        F.count(F.when(F.col("tag") == "META", 1)).alias("n_meta"),
        F.count(F.when(F.col("tag") == "LINK", 1)).alias("n_links"),
    )
    out = out.where("_b is not null").select(*keys, "txn_id", *[F.col(f"_b.{c}").alias(c) for c in ("stream_inst_id", "txn_type_id", "start_time", "parent_txn_id")], "end_time", "n_attrs", "n_meta", "n_links")
    return out.withColumn("duration", F.col("end_time") - F.col("start_time"))


def attributes(records: DataFrame, keys: tuple[str, ...] = ("trace",)) -> DataFrame:
    """All attributes, one a row, in their order: (keys, txn_id, block, seq, pos, field_idx, field_type, v_*)."""
    own = records.where("attrs is not null").select(*keys, "txn_id", *PLACE, F.posexplode("attrs").alias("pos", "a"))
    return own.select(*keys, "txn_id", *PLACE, "pos", "a.*")


def last_attributes(records: DataFrame, keys: tuple[str, ...] = ("trace",)) -> DataFrame:
    """The last value of each field of each transaction."""
    a = attributes(records, keys)
    held = F.struct(*[c for c in a.columns if c.startswith("v_") or c in ("field_type", "bit_width")])
    return a.groupBy(*keys, "txn_id", "field_idx").agg(F.max_by(held, F.struct(*PLACE, "pos")).alias("_a")).select(*keys, "txn_id", "field_idx", "_a.*")


def last_metadata(records: DataFrame, keys: tuple[str, ...] = ("trace",)) -> DataFrame:
    """The last value of each key of each transaction, with how many there were."""
    m = records.where("tag = 'META'")
    return m.groupBy(*keys, "txn_id", "key").agg(F.max_by("value", F.struct(*PLACE)).alias("value"), F.count("*").alias("n"))


def with_streams(records: DataFrame, keys: tuple[str, ...] = ("trace",)) -> DataFrame:
    """Records with the stream of their transaction also where they carry none themselves (ends, attributes, links, metadata), so that a stream can be filtered without records of others."""
    begun = records.where("stream_inst_id is not null").groupBy(*keys, "txn_id").agg(F.min_by("stream_inst_id", F.struct(*PLACE)).alias("_s"))
    return records.join(begun, [*keys, "txn_id"], "left").withColumn("stream_inst_id", F.coalesce("stream_inst_id", "_s")).drop("_s").select(*records.columns)


def in_stream(records: DataFrame, stream: int, start: int | None = None, end: int | None = None, keys: tuple[str, ...] = ("trace",), overlapping: bool = False) -> DataFrame:
    """Beginnings (FULL, BEGIN) of a stream that start between two inclusive times; with `overlapping`, transactions that touch them."""
    if overlapping:
        t = assembled(records, keys).where(F.col("stream_inst_id") == stream)
        if start is not None:
            t = t.where(F.col("end_time").isNull() | (F.col("end_time") >= start))
        return t if end is None else t.where(F.col("start_time") <= end)
    own = records.where((F.col("stream_inst_id") == stream) & F.col("tag").isin("FULL", "BEGIN"))
    if start is not None:
        own = own.where(F.col("start_time") >= start)
    return own if end is None else own.where(F.col("start_time") <= end)


def ancestry(edges: DataFrame, keys: tuple[str, ...] = (), node: str = "id", parent: str = "parent") -> DataFrame:
    """(keys, node, root, depth) by following parents, where a null one, or one that is no node, ends the walk.

    Each pass doubles how far a node sees, so a chain of n nodes takes log2(n) joins, whose sides are stored; a
    cycle is a ValueError.
    """
    e = edges.select(*keys, F.col(node).alias("_n"), F.col(parent).alias("_p"))
    known = e.select(*keys, F.col("_n").alias("_p")).distinct().withColumn("_ok", F.lit(True))
    e = e.join(known, [*keys, "_p"], "left").select(*keys, "_n", F.when(F.col("_ok"), F.col("_p")).alias("_p"))
    now = stored(e.select(*keys, "_n", F.coalesce("_p", "_n").alias("_up"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("_d")), "ancestry")
    n = now.count()
    while True:
        above = now.select(*keys, F.col("_n").alias("_up"), F.col("_up").alias("_up2"), F.col("_d").alias("_d2"))
        after = stored(now.join(above, [*keys, "_up"]).select(*keys, "_n", F.col("_up2").alias("_up"), (F.col("_d") + F.col("_d2")).alias("_d"), (F.col("_d2") > 0).alias("_moved")), "ancestry")
        moved, deepest = after.agg(F.coalesce(F.max("_moved"), F.lit(False)), F.coalesce(F.max("_d"), F.lit(0))).first()
        if deepest > n:
            raise ValueError("parents form a cycle")
        if not moved:
            return after.select(*keys, F.col("_n").alias(node), F.col("_up").alias("root"), F.col("_d").alias("depth"))
        now = after.drop("_moved")
