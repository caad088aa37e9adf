"""Calls and returns in a trace file: signatures as a blob of one stream, events of another as an extension block.

An event refers back to a frame (function and arguments) met within a window of the last ones; other whole-number
arguments are differences from those of the function's last frame. Calls that fit no signature become transactions.
"""

from __future__ import annotations

import json
import struct

from wavelake.sources.container import TraceFile
from wavelake.sources.waves import unpack
from wavelake.sources.wire import Cursor, svarint, uvarint

#: Types of arguments and results by code; block type, key of signatures and event bits (fixed values of the format).
ARGUMENTS = ("NONE", "UINT", "INT", "REAL", "STR")
EXT_TYPE, KEY = b"TRCR", 0
ENTER, BACK, RESULT = 1, 2, 4


class Window:
    """The last frames; a frame is referred to by how many came after it."""

    def __init__(self, size: int):
        self.size, self.frames = size, []

    def back(self, frame) -> int | None:
        return len(self.frames) - 1 - self.frames.index(frame) if frame in self.frames else None

    def push(self, frame) -> None:
        self.frames = [*self.frames, frame][-self.size :] if self.size else []


class CallWriter:
    """enter and exit over a TraceWriter; `signatures` are (function id, name, argument types[, result type])."""

    def __init__(self, writer, call_stream: int, sig_stream: int, signatures: list[tuple], window: int = 64):
        self.w, self.streams, self.window = writer, (call_stream, sig_stream), window
        self.signatures = {s[0]: (s[1], list(s[2]), s[3] if len(s) > 3 else "NONE") for s in signatures}
        self.events, self.raw = [], []

    def enter(self, func: int, args=(), time: int = 0) -> None:
        if func not in self.signatures or len(args) != len(self.signatures[func][1]):
            raise ValueError(f"call of {func} fits no signature: enter_raw takes it")
        self.events.append((True, time, func, tuple(args)))

    def exit(self, ret: int | None = None, time: int = 0) -> None:
        self.events.append((False, time, ret, ()))

    def enter_raw(self, func: int, args, start: int, end: int) -> None:
        self.raw.append((func, list(args), start, end))

    def close(self) -> None:
        call, sig = self.streams
        table = uvarint(len(self.signatures)) + b"".join(uvarint(i) + uvarint(self.w.intern(name)) + uvarint(len(kinds)) + bytes(ARGUMENTS.index(k) for k in [*kinds, ret]) for i, (name, kinds, ret) in self.signatures.items())
        self.w.write_aux(sig, KEY, table)
        self.w.declare_dependencies(call, [sig])
        if self.events:
            self.w.write_ext(EXT_TYPE, 1, self._encoded())
        if self.raw:  # with types of their own, so that negative arguments are kept
            with self.w.txn_block(0) as b:
                for i, (func, args, start, end) in enumerate(self.raw):
                    b.full(call, func, i, start, end)
                    b.attr(i, [(k, "I64", v) for k, v in enumerate(args)])

    def _encoded(self) -> bytes:
        out = bytearray(b"".join(map(uvarint, (*self.streams, self.window, len(self.events)))))
        before, last, window = 0, {}, Window(self.window)
        for entered, time, what, args in self.events:
            step, before = svarint(time - before), time
            if not entered:
                out += bytes([RESULT if what is not None else 0]) + step + (svarint(what) if what is not None else b"")
                continue
            back = window.back((what, args))
            kinds = self.signatures[what][1]
            if back is not None:
                out += bytes([ENTER | BACK]) + uvarint(back) + step
            else:
                out += bytes([ENTER]) + uvarint(what)
                for kind, v, old in zip(kinds, args, last.get(what, [0] * len(kinds)), strict=True):
                    if kind in ("UINT", "INT"):
                        out += svarint(v - old)
                    elif kind == "REAL":
                        out += struct.pack("<d", v)
                    elif kind == "STR":
                        out += uvarint(self.w.intern(v))
                out += step
                window.push((what, args))
            last[what] = list(args)
        return bytes(out)


def signatures(t: TraceFile, stream: int) -> dict[int, tuple[str, list[str], str]]:
    """Of all blobs of a signature stream; the last of a function counts."""
    out = {}
    for raw in t.read_blobs(stream, KEY):
        c = Cursor(raw)
        for _ in range(c.uvarint()):
            i, name = c.uvarint(), t.strings.lookup(c.uvarint())
            kinds = [ARGUMENTS[k] for k in c.take(c.uvarint())]
            out[i] = (name, kinds, ARGUMENTS[c.u8()])
    return out


def _event_blocks(t: TraceFile):
    """(offset, cursor after the heads, call stream, signature stream) of each block of events."""
    for kind, _, at, _ in t.blocks:
        if kind == "EXT":
            flags, raw = t.payload(at)
            raw = unpack(raw, flags)
            if raw[:4] == EXT_TYPE:
                c = Cursor(raw, 6)
                yield at, c, c.uvarint(), c.uvarint()


def signature_rows(t: TraceFile):
    """Of the streams that blocks of events name."""
    return [(s, i, *x) for s in sorted({b[3] for b in _event_blocks(t)}) for i, x in signatures(t, s).items()]


def event_rows(t: TraceFile):
    """Events of all blocks, in file order."""
    for at, c, call, sig in _event_blocks(t):
        window, count = c.uvarint(), c.uvarint()
        known, frames, last, time = signatures(t, sig), Window(window), {}, 0
        for seq in range(count):
            tag = c.u8()
            if not tag & ENTER:
                time += c.svarint()
                yield call, at, seq, False, time, None, None, None, c.svarint() if tag & RESULT else None
                continue
            if tag & BACK:
                func, args = frames.frames[-1 - c.uvarint()]
            else:
                func = c.uvarint()
                kinds, args = known[func][1], []
                for kind, old in zip(kinds, last.get(func, [0] * len(kinds)), strict=True):
                    if kind in ("UINT", "INT"):
                        args.append(old + c.svarint())
                    elif kind == "REAL":
                        args.append(c.fixed("<d"))
                    else:
                        args.append(t.strings.lookup(c.uvarint()) if kind == "STR" else None)
                args = tuple(args)
                frames.push((func, args))
            last[func] = list(args)
            time += c.svarint()
            yield call, at, seq, True, time, func, known[func][0] if func in known else "", json.dumps(args), None
