"""Writing one trace file: descriptions in memory, data blocks as they come, index and header last."""

from __future__ import annotations

import os
import struct
from contextlib import contextmanager

from wavelake.functions.bytecode import compile_bytes, evaluate
from wavelake.plans.graph import find_cycle
from wavelake.sources import codecs, txns, waves
from wavelake.sources.container import DERIVED_BASE, DERIVED_OWNER, INDEX_AT, MAGIC, MIXED, VERSION, Index, Strings, Tree, Types, attributes, block, stream_type
from wavelake.sources.wire import ARRAY, STR, type_of, uvarint

LAYOUTS = ("row", "column", "auto", "adaptive")


class VcBlock:
    """Changes of a block, in any order; an initial value of its own may be set for a signal."""

    def __init__(self, start: int):
        self.start, self.changes, self.initial = start, {}, {}

    def add_change(self, var: int, time: int, value) -> None:
        self.changes.setdefault(var, []).append((time, value))

    def set_initial(self, var: int, value) -> None:
        self.initial[var] = value


class TxnBlock:
    """Records of a block, in the order they come."""

    def __init__(self, intern, prefix: str = ""):
        self.records, self.intern, self.prefix = [], intern, prefix

    def full(self, stream: int, record: int, txn: int, start: int, end: int, parent: int = 0, attrs=(), origin: dict | None = None) -> None:
        """A whole transaction; `attrs` are (field number, field type, value). Origin entries (file, line, component) become META records."""
        self.records.append({"tag": "FULL", "stream": stream, "type": record, "id": txn, "start": start, "end": end, "parent": parent, "attrs": list(attrs)})
        self._origin(txn, origin)

    def begin(self, stream: int, record: int, txn: int, start: int, parent: int = 0, origin: dict | None = None) -> None:
        self.records.append({"tag": "BEGIN", "stream": stream, "type": record, "id": txn, "start": start, "parent": parent})
        self._origin(txn, origin)

    def attr(self, txn: int, attrs) -> None:
        self.records.append({"tag": "ATTR", "id": txn, "attrs": list(attrs)})

    def end(self, txn: int, end: int) -> None:
        self.records.append({"tag": "END", "id": txn, "end": end})

    def link(self, source: int, target: int, kind: str = "RELATED", label: str = "") -> None:
        self.records.append({"tag": "LINK", "link": kind, "id": source, "target": target, "label": self.intern(label) if label else 0})

    def meta(self, txn: int, key: str, value: str) -> None:
        self.records.append({"tag": "META", "id": txn, "key": self.intern(key), "value": self.intern(value)})

    def _origin(self, txn: int, origin: dict | None) -> None:
        for k, v in (origin or {}).items():
            if v not in ("", None):
                self.meta(txn, f"{self.prefix}origin.{k}", str(v))


class TraceWriter:
    """A trace file. `compressor` (zlib, zstd) compresses whole blocks; without it, `compress_time_table`, `compress_waves`
    (zlib, lz4) and `seekable` work inside value-change blocks. `scope_grouped` writes one block for each scope. `path`
    may be an open binary file; one that can't seek gets no index offset, and readers then walk its blocks. Built-in codec ids
    and well-known keys (of files, lines, origins and profiles) get `prefix`, such as a reversed domain, before them."""

    def __init__(self, path, timescale_exp: int = -9, timezero: int = 0, compressor: str | None = None, compress_time_table: bool = False, compress_waves: str | None = None, seekable: bool = False, scope_grouped: bool = False, column_layout: str = "row", delta: bool = True, prefix: str = ""):
        if column_layout not in LAYOUTS:
            raise ValueError(f"no layout {column_layout}")
        self.f, self.owned = (path, False) if hasattr(path, "write") else (open(path, "wb"), True)
        self.compressor, self.layout, self.delta, self.grouped = compressor, column_layout, delta, scope_grouped
        self.sections = {"times_zlib": compress_time_table, "waves": compress_waves, "seekable": seekable}
        self.prefix = f"{prefix}." if prefix else ""
        self.strings, self.types, self.index, self.metadata = Strings(), Types(), Index(), []
        self.vars: dict[int, tuple[str, int]] = {}
        self.scopes: dict[int, int] = {}
        self.scope_count = 0
        self.ordinals: dict[tuple[int, int], int] = {}
        self.inputs: dict[int, list[int]] = {}
        self.sessions: dict[str, codecs.Session] = {}
        self.at, self.closed = 0, False
        payload = MAGIC + bytes(VERSION) + struct.pack("<bqI", timescale_exp, timezero, 0) + uvarint(0) * 2 + struct.pack("<Q", 0) + bytes(16)
        self._write(block("HEADER", 0, payload))

    def _write(self, data: bytes) -> int:
        at = self.at
        self.f.write(data)
        self.at += len(data)
        return at

    def intern(self, s: str) -> int:
        return self.strings.intern(s)

    def add_signal_type(self, encoding: str, width: int = 1, radix: str = "HEX") -> int:
        """One id for each encoding, width and radix."""
        known = {x: i for i, x in self.types.signals.items()}
        return known.get((encoding, width, radix)) or self._added(self.types.signals, (encoding, width, radix))

    def add_txn_schema(self, name: str, fields: list[tuple]) -> int:
        """Fields are (name, field type[, radix[, enumeration]])."""
        return self._added(self.types.records, (name, [(*f, "HEX", 0)[:3] + ((f[3],) if len(f) > 3 else (0,)) if len(f) > 2 else (f[0], f[1], "HEX", 0) for f in fields]))

    def add_enum_type(self, name: str, values: list[tuple[int, str]]) -> int:
        return self._added(self.types.enums, (name, list(values)))

    def add_stream_type(self, name: str, kind: str | None = None, record: int = 0, codec: str | None = None, version: int = 0, params: bytes = b"") -> int:
        return self._added(self.types.streams, stream_type(name, kind, record, codec and codecs.checked(codec), version, params))

    @staticmethod
    def _added(table: dict, value) -> int:
        table[len(table) + 1] = value
        return len(table)

    @contextmanager
    def hierarchy(self, number: int = 1, kind: str = "DESIGN", name: str = ""):
        """A tree to fill; written at the end of the block."""
        tree = Tree(number, kind, name, self.prefix)
        yield tree
        places = {i: self.scope_count + k for k, i in enumerate([i for i, n in enumerate(tree.nodes) if n.node == "scope"], 1)}
        self.scope_count += len(places)
        for n in tree.nodes:
            if n.node == "var":
                self.vars[n.own["id"]] = self.types.signals.get(n.own["type"], ("2STATE", 1))[:2]
                self.scopes[n.own["id"]] = places.get(n.parent, 0)
        inner = tree.encode(self.strings)
        data, flags = waves.pack(inner, self.compressor)
        self.index.trees.append(self._write(block("HIERARCHY", flags, (struct.pack("<Q", len(inner)) if flags else b"") + data)))

    def signal_types(self) -> dict[int, tuple[str, int]]:
        return {i: x[:2] for i, x in self.types.signals.items()} | self.vars

    @contextmanager
    def vc_block(self, start: int, codec: str | None = None):
        """Value changes from `start` on; an unknown codec is a ValueError."""
        own = codec and codecs.found(codec)
        if codec and not (own and own.writes()):
            raise ValueError(f"no codec {codec} that writes")
        b = VcBlock(start)
        yield b
        if own:
            changes = {v: ([(start, b.initial[v])] if v in b.initial else []) + sorted(b.changes.get(v, []), key=lambda x: x[0]) for v in {*b.changes, *b.initial}}
            name = self.prefix + codec if codec.startswith("core.") else codec
            if own.name not in self.sessions:
                self.sessions[own.name] = own.session(own, self)
            payload = uvarint(self.intern(name)) + self.sessions[own.name].encode(start, changes, self.signal_types())
            end = max([start, *(t for c in changes.values() for t, _ in c)])
            self.index.vc.append((start, end, self._write(block("VC", waves.STRUCTURED, payload))))
            return
        groups: dict[int, list[int]] = {}
        for v in sorted({*b.changes, *b.initial}):
            groups.setdefault(self.scopes.get(v, 0) if self.grouped else 0, []).append(v)
        for _, names in sorted(groups.items()) if groups else [(0, [])]:
            changes, initial = ({v: d[v] for v in names if v in d} for d in (b.changes, b.initial))
            payload, flags, end = waves.encode(start, changes, initial, self.signal_types(), self.compressor, **self.sections)
            self.index.vc.append((start, end, self._write(block("VC", flags, payload))))

    @contextmanager
    def txn_block(self, start: int, stream: int | None = None):
        b = TxnBlock(self.intern, self.prefix)
        yield b
        schemas = {i: [f[1] for f in fields] for i, (_, fields) in self.types.records.items()}
        payload, flags, end = txns.encode(start, b.records, schemas, self.layout, self.compressor, self.delta)
        low = min([start, *(r["start"] for r in b.records if "start" in r)])
        self.index.txn.append((low, end, self._write(block("TXN", flags, payload)), MIXED if stream is None else stream))

    def write_ext(self, kind: bytes, version: int = 0, payload: bytes = b"") -> None:
        if len(kind) != 4:
            raise ValueError("an extension type has four bytes")
        self._write(block("EXT", 0, kind + struct.pack("<H", version) + payload))

    def write_aux(self, owner: int, key: int, payload: bytes, compressor: str | None = None) -> int:
        """A blob; returns its ordinal, which counts from 0 for each owner and key."""
        n = self.ordinals.get((owner, key), 0)
        self.ordinals[owner, key] = n + 1
        data, flags = waves.pack(payload, compressor or self.compressor)
        made = block("AUX", flags, data)
        self.index.blobs.append((owner, key, n, self._write(made), len(made)))
        return n

    def add_trace_metadata(self, key: str, value, kind: int | None = None) -> None:
        self.metadata.append((key, type_of(value) if kind is None else kind, value))

    def add_stream_metadata(self, stream: int, key: str, value, kind: int | None = None) -> None:
        self.types.streams[stream]["metadata"].append((key, type_of(value) if kind is None else kind, value))

    def add_stream_profile(self, stream: int, profile: str) -> None:
        own = self.types.streams[stream]["metadata"]
        for k, t, v in own:
            if k == f"{self.prefix}profile" and t & ARRAY:
                v.append(profile)
                return
        own.append((f"{self.prefix}profile", ARRAY | STR, [profile]))

    def declare_dependencies(self, stream: int, inputs: list[int]) -> None:
        """A cycle is a ValueError and nothing is declared then."""
        edges = {i: x["inputs"] for i, x in self.types.streams.items()} | {stream: list(inputs)}
        if cycle := find_cycle(edges):
            raise ValueError(f"cycle: {cycle}")
        self.types.streams[stream]["inputs"] = list(inputs)

    def add_derived_signal(self, name: str, expression, inputs: list[int], width: int, input_changes: dict[int, list] | None = None) -> int:
        """Define a signal by an expression over others; with the inputs' changes, its own are written too. Returns its id."""
        code, var = expression if isinstance(expression, bytes) else compile_bytes(expression), DERIVED_BASE + len(self.inputs)
        if cycle := find_cycle(self.inputs | {var: list(inputs)}):
            raise ValueError(f"cycle: {cycle}")
        self.inputs[var] = list(inputs)
        self.vars[var] = ("2STATE", width)
        body = uvarint(self.intern(name)) + uvarint(int(input_changes is not None)) + uvarint(width) + uvarint(len(inputs)) + b"".join(map(uvarint, inputs)) + uvarint(len(code)) + code
        n = self.ordinals.get((DERIVED_OWNER, var), 0)
        self.ordinals[DERIVED_OWNER, var] = n + 1
        made = block("AUX", 0, body)
        self.index.blobs.append((DERIVED_OWNER, var, n, self._write(made), len(made)))
        if input_changes is not None:
            changes = evaluate(code, [input_changes[i] for i in inputs], width)
            with self.vc_block(changes[0][0] if changes else 0) as b:
                for t, v in changes:
                    b.add_change(var, t, v)
        return var

    def close(self) -> None:
        if self.closed:
            return
        self.closed = True
        for session in reversed(self.sessions.values()):
            session.finalize()
        for session in self.sessions.values():
            session.close()
        if self.metadata:
            data, flags = waves.pack(attributes(self.metadata, self.strings), self.compressor)
            self.index.meta = self._write(block("META", flags, data))
        types = self.types.encode(self.strings)  # first, as it names strings
        for kind, raw in (("STRINGS", self.strings.encode()), ("TYPES", types)):
            data, flags = waves.pack(raw, self.compressor)
            at = self._write(block(kind, flags, data))
            self.index.strings, self.index.types = (at, self.index.types) if kind == "STRINGS" else (self.index.strings, at)
        at = self._write(block("INDEX", 0, self.index.encode()))
        try:
            self.f.seek(INDEX_AT)
            self.f.write(struct.pack("<Q", at))
            self.f.seek(0, os.SEEK_END)
        except (OSError, AttributeError, ValueError):
            pass  # a pipe: the blocks are found by walking
        if self.owned:
            self.f.close()

    def __enter__(self):
        return self

    def __exit__(self, *error) -> None:
        self.close()
