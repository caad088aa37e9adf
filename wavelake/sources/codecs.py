"""Codecs of value-change blocks by id: what a block whose payload isn't of the plain form is read and written with.

An id is lower-case segments joined by dots. Built-in codecs are known by their last two segments, whatever comes before,
so that files written under any prefix are read.
"""

from __future__ import annotations

import enum
import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from wavelake.sources.wire import Cursor, many_uvarints, uvarint


class Capability(enum.IntFlag):
    """What a codec can do (fixed values of the format)."""

    NONE = 0
    RANDOM_ACCESS = 1
    NEEDS_INPUT_STREAMS = 2
    HAS_RAW_FALLBACK = 4
    LOSSLESS = 8
    MATERIALIZED = 16


class Session:
    """A codec's work in one file: encode for each block, then finalize, while descriptions can still be written, then close. `store` is the file's writer: intern, write_aux, add_trace_metadata."""

    def __init__(self, codec: Codec, store):
        self.codec, self.store = codec, store

    def encode(self, start: int, changes: dict[int, list], types: dict[int, tuple[str, int]]) -> bytes:
        return self.codec.encode(start, changes, types)

    def finalize(self) -> None:
        """After the last block; sessions are finalized in the reverse order of their beginning."""

    def close(self) -> None:
        """At the end of the file."""


@dataclass(frozen=True)
class Codec:
    """encode(start, changes, types) -> payload; decode(payload) -> (var, kind, width, times, values) of each signal. Either may be missing. A codec that keeps something over a file's blocks gives its own `session`, a class or function of (codec, store)."""

    name: str
    version: int = 1
    capabilities: Capability = Capability.LOSSLESS
    encode: Callable | None = None
    decode: Callable | None = None
    session: Callable = Session

    def writes(self) -> bool:
        return self.encode is not None or self.session is not Session


REGISTRY: dict[str, Codec] = {}
ID = re.compile(r"[a-z0-9]+(\.[a-z0-9-]+)+")


def checked(name: str) -> str:
    if not ID.fullmatch(name):
        raise ValueError(f"{name!r} is no codec id")
    return name


def register(codec: Codec) -> Codec:
    """Add a codec; one of the same id is replaced. Executors get those that were registered when a scan was planned."""
    REGISTRY[checked(codec.name)] = codec
    return codec


def found(name: str, registry: dict[str, Codec] | None = None) -> Codec | None:
    """By its whole id, else a built-in one by the last two segments."""
    own = REGISTRY if registry is None else registry
    return own.get(name) or own.get(".".join(name.split(".")[-2:]))


def split(raw: bytes, width: int) -> bytes:
    """The n-th bytes of all numbers side by side; a length that the width doesn't divide is an error."""
    if width < 2:
        return bytes(raw)
    if len(raw) % width:
        raise ValueError(f"{len(raw)} bytes aren't numbers of {width}")
    return np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes()


def unsplit(raw: bytes, width: int) -> bytes:
    if width < 2:
        return bytes(raw)
    if len(raw) % width:
        raise ValueError(f"{len(raw)} bytes aren't {width} planes")
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.tobytes()


def encode_planes(start: int, changes: dict[int, list], types: dict[int, tuple[str, int]]) -> bytes:
    """Fixed-width numbers in byte planes, then compressed; changes of a signal must come in order of time."""
    body = bytearray(uvarint(start) + uvarint(len(changes)))
    for var in sorted(changes):
        kind, width = types.get(var, ("2STATE", 1))
        if kind not in ("REAL", "2STATE"):
            raise ValueError(f"byte planes don't hold {kind}")
        size = 8 if kind == "REAL" else (max(1, width) + 7) // 8
        times = [t for t, _ in changes[var]]
        raw = struct.pack(f"<{len(times)}d", *[float(v) for _, v in changes[var]]) if kind == "REAL" else b"".join(int(v).to_bytes(size, "little") for _, v in changes[var])
        body += uvarint(var) + bytes([kind == "REAL"]) + uvarint(size) + uvarint(len(times)) + many_uvarints(np.diff(np.array(times, np.int64), prepend=0)) + split(raw, size)
    return uvarint(1) + zlib.compress(bytes(body))


def decode_planes(payload: bytes):
    c = Cursor(payload)
    if c.uvarint() & 1:
        c = Cursor(zlib.decompress(payload[c.at :]))
    c.uvarint()
    for _ in range(c.uvarint()):
        var, real, size, n = c.uvarint(), c.u8(), c.uvarint(), c.uvarint()
        times = np.cumsum(np.asarray(c.uvarints(n), np.int64))
        raw = unsplit(c.take(n * size), size)
        values = list(struct.unpack(f"<{n}d", raw)) if real else [int.from_bytes(raw[i : i + size], "little") for i in range(0, len(raw), size)]
        yield var, "REAL" if real else "2STATE", 64 if real else 8 * size, times, values


register(Codec("core.valuechange", capabilities=Capability.LOSSLESS | Capability.RANDOM_ACCESS))
register(Codec("core.record"))
register(Codec("core.bytesplit", encode=encode_planes, decode=decode_planes))
register(Codec("core.derived", capabilities=Capability.NEEDS_INPUT_STREAMS | Capability.LOSSLESS))
