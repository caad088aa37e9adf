"""Token ids as length-delimited binary records in shards, with a separate offset index.

A shard is a run of frames in ascending document order. A frame is: u64 length of the payload, u32 masked crc32 of
those eight bytes, the payload, u32 masked crc32 of the payload, one line end. A payload is: u8 1 if the document
has an id, i64 id (0 without one), u8 bytes in a token (2 or 4), then the ids; all little-endian. The mask rotates
a checksum right by 15 bits and adds a constant, so that a checksum of data that holds checksums stays useful.

Documents are dealt by ranges of their ids, so shard order is document order, and every task writes one bounded
shard through Spark's own committer: a lost executor costs its open shards only. The index is made by reading the
shards back, checking both checksums of each frame; it holds shard, place and length of each record, so records
can be read in any order without touching the rest of a shard.

Nulls: a null text is empty (one end id); null ids come first. Repeated ids keep their rows. Empty tables give
empty shards and an empty index. Further columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavelake.llm.common import new_path, small_batches, store

#: Added to a rotated checksum (fixed value of the masking rule).
MASK = 0xA282EAD8
#: Characters of text in a shard, about.
SHARD_CHARS = 24_000_000

HEAD = struct.Struct("<QI")
OWN = struct.Struct("<BqB")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes):
    """(offset, payload) of each frame of a shard; a damaged one is an error."""
    at, end = 0, len(data)
    while at < end:
        size, check = HEAD.unpack_from(data, at)
        if check != masked(data[at : at + 8]):
            raise ValueError(f"length checksum differs at {at}")
        payload = data[at + 12 : at + 12 + size]
        if len(payload) < size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
            raise ValueError(f"data checksum differs at {at}")
        yield at, payload
        at += 12 + size + 4 + 1


def payload_at(data: bytes, at: int) -> bytes:
    """The payload of the frame at a place that the index gave."""
    size, check = HEAD.unpack_from(data, at)
    payload = data[at + 12 : at + 12 + size]
    if check != masked(data[at : at + 8]) or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"checksum differs at {at}")
    return payload


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return OWN.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = OWN.unpack_from(payload)
    return doc_id if has else None, np.frombuffer(payload, f"<u{width}", offset=OWN.size).astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, shard_chars: int = SHARD_CHARS) -> None:
    """Encode each document, append end_id and write the shards."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_chars))
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4

    def encode(batches):
        from wavelake.llm.tokens import encoder

        enc = encoder(tokenizer)
        for b in batches:
            ids, starts = enc.encode(b.column(1))
            out = [frame(payload_of(doc, np.append(ids[x:y], np.uint32(end_id)), width)) for doc, x, y in zip(b.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    dealt = d.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, offset, size, ordinal, n_tokens, ids_crc32) of every record, read from the shards."""
    small_batches(spark)

    def scan(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for k, (at, payload) in enumerate(frames(data.as_py())):
                    doc, ids = parse(payload)
                    rows.append((doc, name, at, len(payload), k, len(ids), zlib.crc32(ids.tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), *[pa.int64()] * 5], strict=True)], names=["doc_id", "shard", "offset", "size", "ordinal", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(scan, "doc_id long, shard string, offset long, size long, ordinal long, n_tokens long, ids_crc32 long")


def shard_number(name: Column) -> Column:
    """The partition number in a shard's file name, as a number: from 100,000 on it has more digits than names are padded to, so names as text are out of order."""
    return F.regexp_extract(name, "^part-([0-9]+)", 1).cast("long")


def with_starts(idx: DataFrame) -> DataFrame:
    """The index with `start`, the ids of all records before: a running sum in each shard, and one over the shards' totals, of which there is one row a shard."""
    before = Window.orderBy(shard_number(F.col("s")), "s").rowsBetween(Window.unboundedPreceding, -1)
    totals = idx.groupBy(F.col("shard").alias("s")).agg(F.sum("n_tokens").alias("total"))
    totals = totals.select("s", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    own = idx.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(totals, own["shard"] == totals["s"]).drop("s").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def write_and_index(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, path: str | None = None) -> tuple[str, DataFrame]:
    """Write shards and their stored index; returns the shards' folder and the index with starts."""
    spark = docs.sparkSession
    path = path or new_path(spark, "records")
    write(docs, path, tokenizer, end_id, vocabulary)
    return path, with_starts(store(index(spark, path), "record-index"))


def read(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the records that `wanted`, rows of the index, names: each shard is opened once and only the frames named are parsed."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    places = wanted.groupBy("shard").agg(F.collect_list("offset").alias("places"))

    def pick(batches):
        for b in batches:
            for data, places in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw, rows = data.as_py(), []
                for at in places:
                    payload = payload_at(raw, at)
                    doc, ids = parse(payload)
                    rows.append((doc, ids.tolist()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.join(places, files["name"] == places["shard"]).select("content", "places").mapInArrow(pick, "doc_id long, ids array<long>")
