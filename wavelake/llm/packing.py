"""Best-fit packing by sum of squares: documents become fixed-length token sequences.

Each document is encoded and closed with an end id; only one longer than a sequence is cut. Full pieces are
sequences of their own. Every other piece goes, longest first, where the sum over gaps of the squared number
of open sequences with that gap becomes smallest. The state is one count for each gap, so a placement costs
one vector operation and the memory is bounded by the sequence length and the open sequences of a group.

Pieces are dealt to groups of about `group` pieces by a hash; a group wastes less than a sequence or so, and
every group packs alone, so the work is linear and one task holds one bounded group.

Nulls: a null text is empty and is packed as its end id; a null id is kept as a row. Empty tables give no rows.
Repeated rows are packed as often as they come: pieces of rows with one id are told apart by their own order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wavelake.llm.common import small_batches, store, trimmed

LIMIT = 4096
GROUP = 200_000
#: Pieces a worker remembers: fewer than elsewhere, as in a pipeline its memory is shared with other stages' workers.
MEMO = 300_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def cut(batches):
        from wavelake.llm.tokens import encoder

        enc = encoder(tokenizer)
        enc.limit = MEMO
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        n = 6 if keep_ids else 5
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            ids, starts = enc.encode(b.column(1))
            for doc, x, y in zip(b.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = ids[x:y].tobytes() + end
                for k, at in enumerate(range(0, len(own), 4 * limit)):
                    part = own[at : at + 4 * limit]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[:n])
            cols = list(zip(*rows, strict=True)) or [[]] * n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names[:n])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(cut), schema)


def place(lengths, limit: int):
    """(bin, offset) of each length, in the order given, by the sum-of-squares rule; bins count from 0."""
    counts = np.zeros(limit + 1, dtype=np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made, never = 0, np.iinfo(np.int64).max
    for i, size in enumerate(np.asarray(lengths).tolist()):
        here = counts[size:]
        # moving a bin from gap g to g - size changes the sum by 2 (n[g - size] - n[g] + 1), filling one by 1 - 2 n[g]
        change = 2 * (counts[: limit + 1 - size] - here + 1)
        change[0] = 1 - 2 * here[0]
        change[here == 0] = never
        k = int(change.argmin())
        if here[k]:  # a new sequence only if the piece fits in no open one, as few are wanted
            gap = size + k
            b = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, b, made = limit, made, made + 1
        bins[i], offsets[i] = b, limit - gap
        left = gap - size
        if left:
            counts[left] += 1
            stacks[left].append(b)
    return bins, offsets


def pack(cut: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """cut(doc_id, piece, start, length, ...) with sequence_id and offset; further columns are kept.

    The number of groups follows the number of pieces; a group is one task's.
    """
    n = max(1, -(-cut.count() // group))
    schema = StructType([*cut.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    keys = [F.col(c) for c in ("doc_id", "piece", "ids_crc32") if c in cut.columns]

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            bins, offsets = place(t.column("length").to_numpy(), limit)
            t = t.append_column("sequence_id", pa.array(bins + (TaskContext.get().partitionId() << 40)))
            yield from t.append_column("offset", pa.array(offsets)).to_batches()

    dealt = cut.repartition(n, F.pmod(F.xxhash64(*keys), F.lit(1 << 30))) if n > 1 else cut.coalesce(1)
    return dealt.sortWithinPartitions(F.desc("length"), *keys).mapInArrow(trimmed(run), schema)


def best_fit(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT, keep_ids: bool = False, group: int = GROUP) -> DataFrame:
    """Every piece of every document with its sequence and its place there. The pieces are stored once, so that encoding isn't repeated."""
    return pack(store(pieces(docs, tokenizer, end_id, limit, keep_ids), "pieces"), limit, group)
