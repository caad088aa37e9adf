"""Byte planes: the n-th bytes of all numbers of an array side by side, which compress better than the numbers.

Whole Arrow batches are turned at once, over their flat buffers. Null arrays stay null, empty ones are empty; arrays may
have any lengths. Only the keys and the array are kept, and a key may not have the target's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element types with their Arrow and byte widths.
KINDS = {"float": (pa.float32(), "<f4"), "double": (pa.float64(), "<f8"), "int": (pa.int32(), "<i4"), "bigint": (pa.int64(), "<i8")}


def _places(sizes: np.ndarray, width: int) -> np.ndarray:
    """Where, in planes, each byte of each number goes: (numbers, width)."""
    starts = np.cumsum(sizes) - sizes
    own, n = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    inside = np.arange(int(sizes.sum())) - own
    return (width * own + inside)[:, None] + n[:, None] * np.arange(width)


def _mapped(df: DataFrame, keys: tuple[str, ...], source: str, target: str, kind: str, run) -> DataFrame:
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"`{target}` {kind}"])

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], run(b.column(len(keys)))], names=[*keys, target])

    return df.select(*keys, F.col(source)).mapInArrow(each, schema)


def _nulls(column) -> pa.Array:
    return pa.array(np.asarray(column.is_null().to_numpy(zero_copy_only=False)))


def split(df: DataFrame, source: str, target: str = "planes", keys: tuple[str, ...] = ()) -> DataFrame:
    """An array of numbers of a fixed size as planes of little-endian bytes. No shuffle."""
    _, form = KINDS[df.schema[source].dataType.elementType.simpleString()]
    width = int(form[2])

    def run(column):
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(form)).view(np.uint8).reshape(-1, width)
        out = np.empty(flat.size, np.uint8)
        out[_places(sizes, width)] = flat
        ends = np.r_[0, np.cumsum(sizes) * width].astype(np.int64)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])
        return pc.if_else(_nulls(column), pa.scalar(None, pa.large_binary()), made).cast(pa.binary())

    return _mapped(df, keys, source, target, "binary", run)


def unsplit(df: DataFrame, source: str = "planes", target: str = "values", keys: tuple[str, ...] = (), element: str = "float") -> DataFrame:
    """The array that `split` was given; a length that the width doesn't divide is an error."""
    kind, form = KINDS[element]
    width = int(form[2])

    def run(column):
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
        if (lengths % width).any():
            raise ValueError(f"{int(lengths[lengths % width > 0][0])} bytes aren't {width} planes")
        sizes = lengths // width
        raw = np.frombuffer(b"".join(pc.fill_null(column, b"").to_pylist()), np.uint8)
        values = raw[_places(sizes, width)].reshape(-1, width).copy().view(form).ravel()
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[np.asarray(column.is_null().to_numpy(zero_copy_only=False)), False])
        return pa.ListArray.from_arrays(offsets, pa.array(values, kind))

    return _mapped(df, keys, source, target, f"array<{element}>", run)
