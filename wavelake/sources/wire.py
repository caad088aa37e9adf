"""Numbers, strings and typed values as bytes: variable-length integers, transaction fields, metadata values."""

from __future__ import annotations

import struct

import numpy as np

#: Field types of transactions, in the order of their codes from 0 (fixed values of the format).
FIELDS = ("U8", "U16", "U32", "U64", "I8", "I16", "I32", "I64", "F32", "F64", "BOOL", "STRING", "BITVEC", "BYTES", "TIME", "ENUM")
#: How struct writes those of a fixed size (fixed values of the format).
FIXED = {"U8": "<B", "U16": "<H", "U32": "<I", "U64": "<Q", "I8": "<b", "I16": "<h", "I32": "<i", "I64": "<q", "F32": "<f", "F64": "<d", "BOOL": "<B", "TIME": "<Q"}
#: Types of metadata values by code, and the bit that makes an array of them (fixed values of the format).
BOOL, I64, U64, F64, STR, ARRAY = 0, 1, 2, 3, 4, 0x40


def uvarint(n: int) -> bytes:
    """Seven bits a byte, low bits first; the high bit says that more follow."""
    if n < 0:
        raise ValueError(f"{n} is negative")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def svarint(n: int) -> bytes:
    """Signs folded into the low bit."""
    return uvarint(n << 1 if n >= 0 else (-n << 1) - 1)


class Cursor:
    """A place in bytes; reading beyond their end is a ValueError."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def more(self) -> bool:
        return self.at < len(self.data)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def fixed(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def uvarint(self) -> int:
        n = shift = 0
        while True:
            b = self.u8()
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    def svarint(self) -> int:
        n = self.uvarint()
        return n >> 1 if n & 1 == 0 else -((n + 1) >> 1)

    def text(self) -> str:
        return self.take(self.uvarint()).decode("utf-8")

    def uvarints(self, n: int) -> np.ndarray | list[int]:
        """The next n integers at once: an array, or a list where one has more than 63 bits."""
        raw = np.frombuffer(self.data, np.uint8, offset=self.at)[: 9 * n]
        ends = np.flatnonzero(raw < 0x80)[:n]
        if len(ends) < n:  # cut off, or wider than nine bytes
            return [self.uvarint() for _ in range(n)]
        starts = np.r_[0, ends[:-1] + 1] if n else ends
        sizes = ends - starts + 1
        if n and sizes.max() > 9:
            return [self.uvarint() for _ in range(n)]
        out = np.zeros(n, np.int64)
        for k in range(int(sizes.max()) if n else 0):
            own = sizes > k
            out[own] |= (raw[starts[own] + k].astype(np.int64) & 0x7F) << (7 * k)
        self.at += int(ends[-1]) + 1 if n else 0
        return out


def many_uvarints(values) -> bytes:
    """All values, one after another; arrays of numbers below 2^63 at once."""
    a = np.asarray(values)
    if a.dtype == object or not len(a):
        return b"".join(map(uvarint, values))
    if a.min() < 0:
        raise ValueError("a value is negative")
    a = a.astype(np.uint64)
    sizes = np.ones(len(a), np.int64)
    for k in range(1, 10):
        sizes += a >= (np.uint64(1) << np.uint64(7 * k)) if k < 9 else (a >> np.uint64(63)) > 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(sizes.max())):
        own = sizes > k
        more = np.where(sizes[own] > k + 1, 0x80, 0).astype(np.uint8)
        out[(ends - sizes)[own] + k] = ((a[own] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | more
    return out.tobytes()


def field(kind: str, value) -> bytes:
    """One transaction field. BITVEC is a pair of width and number; out-of-range numbers are struct.error."""
    if kind in FIXED:
        return struct.pack(FIXED[kind], int(bool(value)) if kind == "BOOL" else value)
    if kind == "ENUM":
        return uvarint(value)
    if kind == "BITVEC":
        width, number = value
        return uvarint(width) + number.to_bytes((width + 7) // 8, "big")
    raw = value.encode("utf-8") if isinstance(value, str) else bytes(value)
    return uvarint(len(raw)) + raw


def read_field(kind: str, c: Cursor):
    if kind in FIXED:
        value = c.fixed(FIXED[kind])
        return bool(value) if kind == "BOOL" else value
    if kind == "ENUM":
        return c.uvarint()
    if kind == "BITVEC":
        width = c.uvarint()
        return width, int.from_bytes(c.take((width + 7) // 8), "big")
    return c.text() if kind == "STRING" else c.take(c.uvarint())


def type_of(value) -> int:
    """The metadata type that a value has of its own; an empty list is one of strings."""
    if isinstance(value, (list, tuple)):
        return ARRAY | (type_of(value[0]) if value else STR)
    for kind, code in ((bool, BOOL), (int, U64), (float, F64), (str, STR)):
        if isinstance(value, kind):
            return I64 if code == U64 and value < 0 else code
    raise TypeError(f"no metadata type for {type(value).__name__}")


def typed(code: int, value, intern) -> bytes:
    """A metadata value; strings are written as ids that `intern` gives."""
    if code & ARRAY:
        return uvarint(len(value)) + b"".join(typed(code ^ ARRAY, v, intern) for v in value)
    if code == STR:
        return uvarint(intern(value))
    if code == F64:
        return struct.pack("<d", value)
    if code == BOOL:
        return bytes([bool(value)])
    return {I64: svarint, U64: uvarint}[code](int(value))


def read_typed(code: int, c: Cursor, lookup):
    if code & ARRAY:
        return [read_typed(code ^ ARRAY, c, lookup) for _ in range(c.uvarint())]
    if code == STR:
        return lookup(c.uvarint())
    if code == F64:
        return c.fixed("<d")
    if code == BOOL:
        return c.u8() != 0
    if code == I64:
        return c.svarint()
    if code == U64:
        return c.uvarint()
    raise ValueError(f"no metadata type {code:#x}")
