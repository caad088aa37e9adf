"""Value changes as blocks: one sorted table of times, and for each signal a wave of places in it with values.

Values in Python: integers for two-state signals, strings of state symbols from the highest bit down for four and nine
states, floats and strings. A wave that is all numbers of at most 63 bits is encoded and decoded as arrays.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

from wavelake.sources.wire import Cursor, many_uvarints, uvarint

#: Signal encodings in the order of their codes from 0 (fixed values of the format).
ENCODINGS = ("2STATE", "4STATE", "9STATE", "REAL", "STRING", "BITVEC", "ANALOG")
#: State symbols in the order of their codes from 0; four-state signals use the first four (fixed values of the format).
STATES = "01XZHUWL-"
#: Flags of a block (fixed values of the format).
WHOLE, ZSTD, TIMES_ZLIB, WAVES_LZ4, XOR_RUNS, WAVES_ZLIB, SEEKABLE, STRUCTURED = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20, 0x40, 0x80

DEFAULT = ("2STATE", 1)


def pack(data: bytes, compressor: str | None) -> tuple[bytes, int]:
    """data, compressed whole if a compressor is named, and the flags that say so."""
    if not compressor:
        return data, 0
    if compressor == "zlib":
        return zlib.compress(data), WHOLE
    if compressor == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data), WHOLE | ZSTD
    raise ValueError(f"no compressor {compressor}")


def unpack(data: bytes, flags: int) -> bytes:
    if not flags & WHOLE:
        return bytes(data)
    if flags & ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zlib.decompress(data)


def _size(bits: int) -> int:
    return max(1, (bits + 7) // 8)


def _codes(value, width: int) -> list[int]:
    """State codes of a value; missing high bits are 0."""
    if isinstance(value, int):
        return [value >> i & 1 for i in range(width - 1, -1, -1)]
    own = [STATES.index(str(s).upper()) for s in value]
    return [0] * (width - len(own)) + own


def _packed(codes: list[int], bits: int) -> bytes:
    """Codes of so many bits, the first in the highest bits of the first byte."""
    per = 8 // bits
    out = bytearray(max(1, -(-len(codes) // per)))
    for i, c in enumerate(codes):
        out[i // per] |= c << (8 - bits * (i % per + 1))
    return bytes(out)


def _unpacked(raw: bytes, width: int, bits: int) -> str:
    per = 8 // bits
    return "".join(STATES[min(raw[i // per] >> (8 - bits * (i % per + 1)) & (1 << bits) - 1, 8)] for i in range(width))


def _plain(value, width: int) -> int | None:
    """The number that a value of states is, None if it has others than 0 and 1."""
    if isinstance(value, int):
        return value
    own = "".join(map(str, value)).upper()
    return int(own or "0", 2) if set(own) <= {"0", "1"} else None


STATE_BITS = {"4STATE": 2, "9STATE": 4}


def one(encoding: str, width: int, value) -> bytes:
    """An initial value."""
    if encoding in ("REAL", "ANALOG"):
        return struct.pack("<d", float(value or 0))
    if encoding == "STRING":
        raw = (value or "").encode("utf-8")
        return uvarint(len(raw)) + raw
    if encoding in STATE_BITS:
        return uvarint(width) + _packed(_codes(value or 0, width), STATE_BITS[encoding]).ljust(1, b"\0")
    return uvarint(width) + int(value or 0).to_bytes(_size(width), "big")


def read_one(encoding: str, c: Cursor):
    if encoding in ("REAL", "ANALOG"):
        return c.fixed("<d")
    if encoding == "STRING":
        return c.text()
    width = c.uvarint()
    if encoding in STATE_BITS:
        bits = STATE_BITS[encoding]
        return _unpacked(c.take(_size(width * bits) if bits == 2 else max(1, (width + 1) // 2)), width, bits)
    return int.from_bytes(c.take(_size(width)), "big")


def wave(encoding: str, width: int, places: np.ndarray, values: list) -> bytes:
    """Changes of one signal: `places` in the table of times, ascending and distinct."""
    steps = np.diff(places, prepend=-1) - 1
    if len(steps) and steps.min() < 0:
        raise ValueError("two changes at one time: settle them first")
    n = uvarint(len(values))
    if encoding == "2STATE" and width == 1:
        return n + many_uvarints((steps << 2) | (np.array([int(v) & 1 for v in values], np.int64) << 1) | 1)
    if encoding == "2STATE":
        numbers, before = list(map(int, values)), 0
        turned = []
        for v in numbers:
            turned.append(v ^ before)
            before = v
        if max(turned, default=0) < 1 << 63:
            x = np.array(turned, np.int64)
            first = np.flatnonzero(np.r_[True, (steps[1:] != steps[:-1]) | (x[1:] != x[:-1])]) if len(x) else np.zeros(0, np.int64)
            groups = np.stack([(steps[first] << 1) | 1, x[first], np.diff(np.r_[first, len(x)]) - 1], axis=1) if len(x) else np.zeros((0, 3), np.int64)
            return uvarint(len(first)) + many_uvarints(groups.ravel())
        groups = []
        for s, t in zip(steps.tolist(), turned, strict=True):
            if groups and groups[-1][:2] == [s, t]:
                groups[-1][2] += 1
            else:
                groups.append([s, t, 0])
        return uvarint(len(groups)) + b"".join(uvarint(s << 1 | 1) + uvarint(t) + uvarint(more) for s, t, more in groups)
    out = bytearray(n)
    for s, v in zip(steps.tolist(), values, strict=True):
        if encoding in ("REAL", "ANALOG"):
            out += uvarint(s) + struct.pack("<d", float(v))
        elif encoding == "STRING":
            raw = (v or "").encode("utf-8")
            out += uvarint(s) + uvarint(len(raw)) + raw
        elif encoding == "4STATE" and width == 1:
            out += uvarint(s << 3 | _codes(v, 1)[-1] << 1 | 1)
        else:
            number = _plain(v, width)
            out += uvarint(s << 1 | (number is not None))
            out += _packed(_codes(v, width), STATE_BITS[encoding]) if number is None else number.to_bytes(_size(width), "big")
    return bytes(out)


def read_wave(encoding: str, width: int, c: Cursor, runs: bool) -> tuple[np.ndarray, list | np.ndarray]:
    """(places, values) of a wave."""
    n = c.uvarint()
    if encoding == "2STATE" and width == 1:
        heads = np.asarray(c.uvarints(n), np.int64)
        return np.cumsum((heads >> 2) + 1) - 1, heads >> 1 & 1
    if encoding == "2STATE" and runs:
        got = c.uvarints(3 * n)
        if isinstance(got, np.ndarray):
            steps, turned, more = got.reshape(-1, 3).T
            times = more + 1
            return np.cumsum(np.repeat((steps >> 1) + 1, times)) - 1, np.bitwise_xor.accumulate(np.repeat(turned, times)) if n else np.zeros(0, np.int64)
        places, values, at, v = [], [], -1, 0
        for i in range(0, 3 * n, 3):
            for _ in range(got[i + 2] + 1):
                at, v = at + 1 + (got[i] >> 1), v ^ got[i + 1]
                places.append(at)
                values.append(v)
        return np.array(places, np.int64), values
    places, values, at = [], [], -1
    for _ in range(n):
        head = c.uvarint()
        if encoding in ("REAL", "ANALOG"):
            step, v = head, c.fixed("<d")
        elif encoding == "STRING":
            step, v = head, c.text()
        elif encoding == "4STATE" and width == 1:
            step, v = head >> 3, STATES[head >> 1 & 3]
        else:
            step = head >> 1
            if encoding in STATE_BITS and not head & 1:
                bits = STATE_BITS[encoding]
                v = _unpacked(c.take(_size(width * 2) if bits == 2 else max(1, (width + 1) // 2)), width, bits)
            else:
                v = int.from_bytes(c.take(_size(width)), "big")
                v = format(v, f"0{width}b") if encoding in STATE_BITS else v
        at += 1 + step
        places.append(at)
        values.append(v)
    return np.array(places, np.int64), values


def _stored(raw: bytes, kind: str) -> bytes:
    """A wave compressed alone, if that makes it smaller."""
    if kind == "zlib":
        small = zlib.compress(raw)
    else:
        try:
            import lz4.block
        except ImportError:  # not on every machine: the wave stays as it is
            return b"\0" + raw
        small = lz4.block.compress(raw, store_size=False)
    return b"\1" + uvarint(len(raw)) + uvarint(len(small)) + small if len(small) + 2 < len(raw) else b"\0" + raw


def encode(start: int, changes: dict[int, list], initial: dict[int, object], types: dict[int, tuple[str, int]], compressor: str | None = None, times_zlib: bool = False, waves: str | None = None, seekable: bool = False) -> tuple[bytes, int, int]:
    """(payload, flags, end time) of a block. `changes` has (time, value) lists in any order; `waves` is zlib, lz4 or None. Equal waves are stored once."""
    flags = XOR_RUNS
    if not compressor:
        flags |= TIMES_ZLIB * times_zlib | {"zlib": WAVES_ZLIB, "lz4": WAVES_LZ4, None: 0}[waves] | SEEKABLE * seekable
    times = np.array(sorted({t for own in changes.values() for t, _ in own}), np.int64)
    end = max(start, int(times[-1])) if len(times) else start
    if len(times) and times[0] < start:
        raise ValueError(f"a change at {times[0]} lies before the block's start {start}")
    names = sorted({*changes, *initial})
    parts, known, at = [], {}, 0
    places, values = [], bytearray()
    for var in names:
        kind, width = types.get(var, DEFAULT)
        own = sorted(changes.get(var, ()), key=lambda x: x[0])
        raw = wave(kind, width, np.searchsorted(times, np.array([t for t, _ in own], np.int64)), [v for _, v in own])
        values += uvarint(var) + one(kind, width, initial.get(var, own[0][1] if own else None))
        mark = hashlib.sha256(raw).digest()
        if mark not in known:
            known[mark] = at
            parts.append(_stored(raw, waves) if flags & (WAVES_ZLIB | WAVES_LZ4) else raw)
            at += len(parts[-1])
        places.append(known[mark])
    deltas = many_uvarints(np.diff(times, prepend=start))
    if flags & TIMES_ZLIB and len(times):
        deltas = zlib.compress(deltas)
        deltas = uvarint(len(deltas)) + deltas
    out = bytearray(struct.pack("<QQ", start, end) + uvarint(len(times)) + deltas + uvarint(len(names)) + values)
    table = len(out)
    wide = at >= 1 << 32
    out += bytes([8 if wide else 4]) + np.array(places, "<u8" if wide else "<u4").tobytes() + uvarint(at) + b"".join(parts)
    if flags & SEEKABLE:
        out += struct.pack("<Q", table)
    data, more = pack(bytes(out), compressor)
    return data, flags | more, end


def decode(payload: bytes, flags: int, types: dict[int, tuple[str, int]], wanted: set[int] | None = None):
    """(var, encoding, width, times, values, is it only the initial value) of each signal, or of the `wanted` ones: other waves aren't decoded."""
    data = unpack(payload, flags)
    if flags & WHOLE:
        flags &= XOR_RUNS
    c = Cursor(data[:-8] if flags & SEEKABLE else data)
    start = c.fixed("<Q")
    c.fixed("<Q")
    n = c.uvarint()
    if flags & TIMES_ZLIB and n:
        deltas = Cursor(zlib.decompress(c.take(c.uvarint()))).uvarints(n)
    else:
        deltas = c.uvarints(n)
    times = start + np.cumsum(np.asarray(deltas, np.int64))
    names, initial = [], {}
    for _ in range(c.uvarint()):
        var = c.uvarint()
        names.append(var)
        initial[var] = read_one(types.get(var, DEFAULT)[0], c)
    size = c.u8()
    places = np.frombuffer(c.take(size * len(names)), f"<u{size}").tolist()
    waves = c.take(c.uvarint())
    for var, at in zip(names, places, strict=True):
        if wanted is not None and var not in wanted:
            continue
        kind, width = types.get(var, DEFAULT)
        w = Cursor(waves, at)
        if waves and flags & (WAVES_ZLIB | WAVES_LZ4) and w.u8():
            full = w.uvarint()
            raw = w.take(w.uvarint())
            if flags & WAVES_ZLIB:
                raw = zlib.decompress(raw)
            else:
                import lz4.block

                raw = lz4.block.decompress(raw, uncompressed_size=full)
            w = Cursor(raw)
        own, values = read_wave(kind, width, w, bool(flags & XOR_RUNS)) if waves else (np.zeros(0, np.int64), [])
        if len(own):
            yield var, kind, width, times[own], values, False
        else:
            yield var, kind, width, np.array([start], np.int64), [initial[var]], True
