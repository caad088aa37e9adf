"""The trace file: framed blocks, the tables that describe their contents, and the index at its end.

`TraceFile` opens a file by header and index, or, without an index, by walking the frames; only descriptions are read,
data blocks are left where they are. Times, ids and offsets are numbers; strings are resolved through the string table.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from wavelake.sources.waves import ENCODINGS, unpack
from wavelake.sources.wire import FIELDS, Cursor, read_typed, typed, uvarint

#: Block types (fixed values of the format).
BLOCKS = {"HEADER": 0x00, "STRINGS": 0x01, "TYPES": 0x02, "HIERARCHY": 0x03, "META": 0x04, "VC": 0x10, "TXN": 0x11, "AUX": 0x12, "EXT": 0x20, "INDEX": 0xFE, "SKIP": 0xFF}
BLOCK_NAMES = {v: k for k, v in BLOCKS.items()}
#: First bytes of a header, its version, and where in a file the index offset stands (fixed values of the format).
MAGIC, VERSION, INDEX_AT = b"TRL\0\0\0\1\0", (2, 1), 35
#: Kinds of scope, of hierarchy, of signal direction and of display by code (fixed values of the format).
SCOPES = {0: "MODULE", 1: "TASK", 2: "FUNCTION", 3: "BLOCK", 4: "FORK", 5: "GENERATE", 6: "STRUCT", 7: "UNION", 8: "INTERFACE", 9: "PACKAGE", 10: "PROGRAM", 11: "VHDL_ARCH", 12: "VHDL_PROC", 255: "ANONYMOUS"}
TREES = {0: "DESIGN", 1: "BEHAVIORAL", 2: "SW", 255: "CUSTOM"}
DIRECTIONS = ("NONE", "IN", "OUT", "INOUT", "BUFFER")
RADIXES = ("HEX", "DEC", "OCT", "BIN", "UDEC", "SIGNED", "REAL", "STRING", "TIME")
#: Stream of a transaction block that mixes streams; owner of derived definitions, and their first id (fixed values of the format).
MIXED, DERIVED_OWNER, DERIVED_BASE = 0xFFFFFFFF, 0xFFFFFFFE, 0x40000000
HEAD = struct.Struct("<BBQ")


def block(kind: str, flags: int, payload: bytes) -> bytes:
    return HEAD.pack(BLOCKS[kind], flags, HEAD.size + len(payload)) + payload


def code(table: dict, name: str) -> int:
    return next(k for k, v in table.items() if v == name)


class Strings:
    """Dense ids from 1 by first use; 0 is none. An unknown id is a KeyError."""

    def __init__(self):
        self.of, self.ids = [None], {}

    def intern(self, s: str) -> int:
        if s not in self.ids:
            self.ids[s] = len(self.of)
            self.of.append(s)
        return self.ids[s]

    def lookup(self, i: int) -> str | None:
        if not 0 <= i < len(self.of):
            raise KeyError(i)
        return self.of[i]

    def encode(self) -> bytes:
        return uvarint(len(self.of) - 1) + b"".join(uvarint(len(r)) + r for r in (s.encode("utf-8") for s in self.of[1:]))

    def decode(self, data: bytes) -> None:
        c = Cursor(data)
        for _ in range(c.uvarint()):
            s = c.text()
            self.ids.setdefault(s, len(self.of))
            self.of.append(s)


@dataclass
class Types:
    """Signal types (encoding, width, radix), record types (name, fields), enumerations and stream types, each by id from 1."""

    signals: dict[int, tuple[str, int, str]] = field(default_factory=dict)
    records: dict[int, tuple[str, list[tuple[str, str, str, int]]]] = field(default_factory=dict)
    enums: dict[int, tuple[str, list[tuple[int, str]]]] = field(default_factory=dict)
    streams: dict[int, dict] = field(default_factory=dict)

    def encode(self, s: Strings) -> bytes:
        parts = []
        for i, (encoding, width, radix) in self.signals.items():
            parts.append(bytes([1]) + uvarint(i) + bytes([ENCODINGS.index(encoding)]) + uvarint(width) + bytes([RADIXES.index(radix)]))
        for i, (name, fields) in self.records.items():
            own = b"".join(uvarint(s.intern(n)) + bytes([FIELDS.index(kind), RADIXES.index(radix)]) + uvarint(enum) for n, kind, radix, enum in fields)
            parts.append(bytes([2]) + uvarint(i) + uvarint(s.intern(name)) + uvarint(len(fields)) + own)
        for i, (name, values) in self.enums.items():
            own = b"".join(uvarint(v << 1 if v >= 0 else (-v << 1) - 1) + uvarint(s.intern(label)) for v, label in values)
            parts.append(bytes([3]) + uvarint(i) + uvarint(s.intern(name)) + uvarint(len(values)) + own)
        for i, x in self.streams.items():
            head = uvarint(i) + uvarint(s.intern(x["name"])) + uvarint(s.intern(x["kind"]) if x["kind"] else 0) + uvarint(x["type"])
            if not (x["codec"] or x["metadata"] or x["inputs"]):
                parts.append(bytes([4]) + head)
                continue
            body = head + uvarint(s.intern(x["codec"]) if x["codec"] else 0) + uvarint(x["version"]) + uvarint(len(x["params"])) + x["params"]
            body += attributes(x["metadata"], s) + uvarint(len(x["inputs"])) + b"".join(map(uvarint, x["inputs"]))
            parts.append(bytes([5]) + uvarint(len(body)) + body)
        return uvarint(len(parts)) + b"".join(parts)

    def decode(self, data: bytes, s: Strings) -> None:
        c = Cursor(data)
        text = lambda: s.lookup(c.uvarint())
        for _ in range(c.uvarint()):
            tag = c.u8()
            if tag == 1:
                i = c.uvarint()
                self.signals[i] = (ENCODINGS[c.u8()], c.uvarint(), RADIXES[c.u8()])
            elif tag == 2:
                i = c.uvarint()
                if i in self.records:
                    raise ValueError(f"record type {i} comes twice")
                name = text()
                self.records[i] = (name, [(text(), FIELDS[c.u8()], RADIXES[c.u8()], c.uvarint()) for _ in range(c.uvarint())])
            elif tag == 3:
                i, name = c.uvarint(), text()
                self.enums[i] = (name, [(c.svarint(), text()) for _ in range(c.uvarint())])
            elif tag == 4:
                i = c.uvarint()
                self.streams[i] = stream_type(text(), text(), c.uvarint())
            elif tag == 5:
                size = c.uvarint()
                end = c.at + size
                i = c.uvarint()
                x = stream_type(text(), text(), c.uvarint(), text(), c.uvarint(), c.take(c.uvarint()))
                x["metadata"] = read_attributes(c, s) if c.at < end else []
                x["inputs"] = [c.uvarint() for _ in range(c.uvarint())] if c.at < end else []
                self.streams[i], c.at = x, end
            elif tag > 5:  # from here on entries tell their length, so that unknown ones can be passed over
                c.take(c.uvarint())
            else:
                return


def stream_type(name: str, kind: str | None = None, record: int = 0, codec: str | None = None, version: int = 0, params: bytes = b"") -> dict:
    return {"name": name, "kind": kind, "type": record, "codec": codec, "version": version, "params": params, "metadata": [], "inputs": []}


def attributes(values: list[tuple[str, int, object]], s: Strings) -> bytes:
    return uvarint(len(values)) + b"".join(uvarint(s.intern(k)) + bytes([t]) + typed(t, v, s.intern) for k, t, v in values)


def read_attributes(c: Cursor, s: Strings) -> list[tuple[str, int, object]]:
    out = []
    for _ in range(c.uvarint()):
        k, t = s.lookup(c.uvarint()), c.u8()
        out.append((k, t, read_typed(t, c, s.lookup)))
    return out


def last_wins(values: list[tuple[str, int, object]]) -> dict:
    return {k: v for k, _, v in values}


@dataclass
class Node:
    """A scope, variable or stream of a hierarchy; `parent` is its place in the list, -1 at the top."""

    node: str
    name: str
    parent: int = -1
    own: dict = field(default_factory=dict)
    attrs: list[tuple[str, int, object]] = field(default_factory=list)


class Tree:
    """A hierarchy: nodes in depth-first order. Ids of variables and streams count from 1 in each tree."""

    def __init__(self, number: int = 1, kind: str = "DESIGN", name: str = "", prefix: str = ""):
        self.number, self.kind, self.name, self.prefix = number, kind, name, prefix
        self.nodes: list[Node] = []
        self.open: list[int] = []
        self.count = {"var": 0, "stream": 0}

    def _add(self, node: str, name: str, own: dict) -> int:
        self.nodes.append(Node(node, name, self.open[-1] if self.open else -1, own))
        return len(self.nodes) - 1

    def begin_scope(self, name: str, kind: str = "MODULE", component: str = "", file: str = "", line: int = 0) -> int:
        self.open.append(self._add("scope", name, {"kind": kind, "component": component, "file": file, "line": line}))
        return self.open[-1]

    def end_scope(self) -> None:
        if not self.open:
            raise ValueError("no scope is open")
        self.open.pop()

    def add_var(self, name: str, signal_type: int, direction: str = "IN", alias: int = 0, file: str = "", line: int = 0, driver: tuple[str, int] | None = None) -> int:
        self.count["var"] += 1
        self._add("var", name, {"id": self.count["var"], "type": signal_type, "direction": direction, "alias": alias, "file": file, "line": line})
        for k, v in zip(("driver.file", "driver.line"), driver or (), strict=False):
            self.add_attr(self.prefix + k, str(v))
        return self.count["var"]

    def add_stream(self, stream: int, name: str, file: str = "", line: int = 0) -> int:
        self.count["stream"] += 1
        self._add("stream", name, {"id": self.count["stream"], "type": stream})
        if file:
            self.add_attr(self.prefix + "src.file", file)
            self.add_attr(self.prefix + "src.line", str(line))
        return self.count["stream"]

    def add_attr(self, key: str, value, kind: int | None = None) -> None:
        """To the node declared last. Without a kind: as text."""
        if not self.nodes:
            raise ValueError("no node to attach to")
        self.nodes[-1].attrs.append((key, -1, str(value)) if kind is None else (key, kind, value))

    def encode(self, s: Strings) -> bytes:
        text = lambda x: uvarint(s.intern(x) if x else 0)
        out = bytearray(uvarint(self.number) + bytes([code(TREES, self.kind)]) + text(self.name))
        depth: list[int] = []
        for i, n in enumerate(self.nodes):
            while depth and depth[-1] != n.parent:
                out.append(2)
                depth.pop()
            x = n.own
            if n.node == "scope":
                out += bytes([1, code(SCOPES, x["kind"])]) + text(n.name) + text(x["component"]) + text(x["file"]) + uvarint(x["line"])
                depth.append(i)
            elif n.node == "var":
                out += bytes([3]) + uvarint(x["id"]) + text(n.name) + uvarint(x["type"]) + bytes([DIRECTIONS.index(x["direction"])]) + uvarint(x["alias"]) + text(x["file"]) + uvarint(x["line"])
            else:
                out += bytes([4]) + uvarint(x["id"]) + uvarint(x["type"]) + text(n.name)
            for k, t, v in n.attrs:
                out += bytes([5]) + text(k) + text(v) if t < 0 else bytes([6]) + text(k) + bytes([t]) + typed(t, v, s.intern)
        return bytes(out) + b"\2" * len(depth)

    @classmethod
    def decode(cls, data: bytes, s: Strings, headed: bool = True) -> Tree:
        c, tree = Cursor(data), cls()
        text = lambda: s.lookup(c.uvarint()) or ""
        if headed:
            tree.number, tree.kind, tree.name = c.uvarint(), TREES[c.u8()], text()
        while c.more():
            tag = c.u8()
            if tag == 1:
                kind = SCOPES[c.u8()]
                tree.begin_scope(text(), kind, text(), text(), c.uvarint())
            elif tag == 2:
                tree.end_scope()
            elif tag == 3:
                i = c.uvarint()
                tree._add("var", text(), {"id": i, "type": c.uvarint(), "direction": DIRECTIONS[c.u8()], "alias": c.uvarint(), "file": text(), "line": c.uvarint()})
            elif tag == 4:
                i, kind = c.uvarint(), c.uvarint()
                tree._add("stream", text(), {"id": i, "type": kind})
            elif tag == 5:
                tree.add_attr(text(), text())
            elif tag == 6:
                k, t = text(), c.u8()
                tree.add_attr(k, read_typed(t, c, s.lookup), t)
            else:  # unknown, and of unknown length
                break
        return tree

    def paths(self) -> list[str]:
        out: list[str] = []
        for n in self.nodes:
            out.append(n.name if n.parent < 0 else f"{out[n.parent]}.{n.name}")
        return out


@dataclass
class Index:
    """Where blocks are: (start, end, offset[, stream]) of data, offsets of descriptions, (owner, key, ordinal, offset, length) of blobs."""

    vc: list[tuple] = field(default_factory=list)
    txn: list[tuple] = field(default_factory=list)
    ranges: list[tuple] = field(default_factory=list)
    strings: int = 0
    types: int = 0
    trees: list[int] = field(default_factory=list)
    meta: int = 0
    blobs: list[tuple] = field(default_factory=list)

    def encode(self) -> bytes:
        q = lambda *x: struct.pack(f"<{len(x)}Q", *x)
        out = uvarint(len(self.vc)) + b"".join(q(*x) for x in self.vc) + uvarint(len(self.txn)) + b"".join(q(*x[:3]) for x in self.txn)
        out += uvarint(len(self.ranges)) + b"".join(uvarint(v) + q(a, b) for v, a, b in self.ranges)
        out += b"\1" + q(self.strings, self.types) + uvarint(len(self.trees)) + b"".join(map(q, self.trees))
        if any(x[3] != MIXED for x in self.txn):
            out += b"\2" + uvarint(len(self.txn)) + b"".join(uvarint(x[3]) + q(*x[:3]) for x in self.txn)
        if self.meta:
            out += b"\3" + q(self.meta)
        if self.blobs:
            out += b"\4" + uvarint(len(self.blobs)) + b"".join(uvarint(o) + uvarint(k) + uvarint(n) + q(at, size) for o, k, n, at, size in self.blobs)
        return out

    @classmethod
    def decode(cls, data: bytes) -> Index:
        c, i = Cursor(data), cls()
        q = lambda n: struct.unpack(f"<{n}Q", c.take(8 * n))
        i.vc = [q(3) for _ in range(c.uvarint())]
        i.txn = [(*q(3), MIXED) for _ in range(c.uvarint())]
        i.ranges = [(c.uvarint(), *q(2)) for _ in range(c.uvarint())]
        while c.more():
            section = c.u8()
            if section == 1:
                i.strings, i.types = q(2)
                i.trees = [q(1)[0] for _ in range(c.uvarint())]
            elif section == 2:
                i.txn = [(*x[1:], x[0]) for x in ((c.uvarint(), *q(3)) for _ in range(c.uvarint()))]
            elif section == 3:
                i.meta = q(1)[0]
            elif section == 4:
                i.blobs = [(c.uvarint(), c.uvarint(), c.uvarint(), *q(2)) for _ in range(c.uvarint())]
            else:
                break
        return i


def opened(path: str):
    """A file to read from: local or shared folders, and what Arrow's file systems know by their scheme."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    system, own = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return system.open_input_file(own)


class TraceFile:
    """A file's descriptions and the places of its data blocks."""

    def __init__(self, path: str):
        self.path, self.strings, self.types, self.trees, self.metadata = path, Strings(), Types(), [], []
        self.index: Index | None = None
        with opened(path) as f:
            first = self._frame(f, 0)
            if first is None or BLOCK_NAMES.get(first[0]) != "HEADER":
                raise ValueError(f"{path} doesn't begin with a header")
            c = Cursor(first[2])
            if c.take(len(MAGIC)) != MAGIC:
                raise ValueError(f"{path} is no trace")
            self.version = (c.u8(), c.u8())
            if self.version[0] not in (1, 2):
                raise ValueError(f"{path} has version {self.version[0]}")
            self.timescale_exp, self.timezero = c.fixed("<b"), c.fixed("<q")
            c.fixed("<I")
            c.uvarint(), c.uvarint()
            at = c.fixed("<Q")
            found = self._frame(f, at) if at else None
            if found and BLOCK_NAMES.get(found[0]) == "INDEX":
                self.index = Index.decode(found[2])
            self.blocks = list(self._walk(f))
            # strings first, as every other description refers to them
            order = ("STRINGS", "TYPES", "META", "HIERARCHY")
            for kind, flags, at, _ in sorted((b for b in self.blocks if b[0] in order), key=lambda b: (order.index(b[0]), b[2])):
                raw = self._frame(f, at)[2]
                if kind == "STRINGS":
                    self.strings.decode(unpack(raw, flags))
                elif kind == "TYPES":
                    self.types.decode(unpack(raw, flags), self.strings)
                elif kind == "META":
                    self.metadata += read_attributes(Cursor(unpack(raw, flags)), self.strings)
                else:  # a compressed tree has its size before it
                    self.trees.append(Tree.decode(unpack(raw[8:] if flags & 1 else raw, flags), self.strings, self.version[0] > 1))

    @staticmethod
    def _frame(f, at: int) -> tuple[int, int, bytes] | None:
        f.seek(0, 2)
        total = f.tell()
        if at + HEAD.size > total:
            return None
        f.seek(at)
        kind, flags, size = HEAD.unpack(f.read(HEAD.size))
        return (kind, flags, f.read(size - HEAD.size)) if HEAD.size <= size <= total - at else None

    def _walk(self, f):
        """(kind, flags, offset, length) of each whole block, read by its frame alone; a cut-off end ends the file, unknown kinds are passed over."""
        f.seek(0, 2)
        total, at = f.tell(), 0
        while at + HEAD.size <= total:
            f.seek(at)
            kind, flags, size = HEAD.unpack(f.read(HEAD.size))
            if size < HEAD.size or at + size > total:
                return
            if kind in BLOCK_NAMES:
                yield BLOCK_NAMES[kind], flags, at, size
            at += size

    def payload(self, at: int) -> tuple[int, bytes]:
        """(flags, payload) of the block at an offset."""
        with opened(self.path) as f:
            found = self._frame(f, at)
        if found is None:
            raise ValueError(f"no whole block at {at}")
        return found[1], found[2]

    def signal_types(self) -> dict[int, tuple[str, int]]:
        """Encoding and width by variable: from the trees, and where they don't tell, by taking the id for a signal type's."""
        out = {i: x[:2] for i, x in self.types.signals.items()}
        for tree in self.trees:
            out.update({n.own["id"]: self.types.signals[n.own["type"]][:2] for n in tree.nodes if n.node == "var" and n.own["type"] in self.types.signals})
        for x in self.derived():
            out[x["var_id"]] = ("2STATE", x["bit_width"])
        return out

    def schemas(self) -> dict[int, list[str]]:
        return {i: [kind for _, kind, _, _ in fields] for i, (_, fields) in self.types.records.items()}

    def blobs(self, owner: int | None = None) -> list[tuple]:
        return [b for b in (self.index.blobs if self.index else []) if owner is None or b[0] == owner]

    def read_blobs(self, owner: int, key: int) -> list[bytes]:
        """In order of their ordinals; none is an empty list."""
        own = sorted((b for b in self.blobs(owner) if b[1] == key), key=lambda b: b[2])
        return [unpack(raw, flags) for flags, raw in (self.payload(b[3]) for b in own)]

    def derived(self) -> list[dict]:
        """Definitions of derived signals: (var_id, name, bit_width, inputs, code, materialized)."""
        out = []
        for _, key, _, at, _ in self.blobs(DERIVED_OWNER):
            flags, raw = self.payload(at)
            c = Cursor(unpack(raw, flags))
            name, bits = self.strings.lookup(c.uvarint()), c.uvarint()
            out.append({"var_id": key, "name": name, "materialized": bool(bits & 1), "bit_width": c.uvarint(), "inputs": [c.uvarint() for _ in range(c.uvarint())], "code": c.take(c.uvarint())})
        return out

    def seek(self, time: int) -> int:
        """The offset of the earliest value-change block that starts at or after a time."""
        found = sorted(x for x in (self.index.vc if self.index else []) if x[0] >= time)
        if not found:
            raise ValueError(f"no block starts at {time} or later")
        return found[0][2]

    def dependencies(self) -> dict[int, list[int]]:
        return {i: x["inputs"] for i, x in self.types.streams.items() if x["inputs"]}
