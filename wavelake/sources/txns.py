"""Transaction records as blocks, in rows or in columns, with ids and times as differences.

A record is a dict with `tag` and what that kind has: stream, type, id, start, end, parent, attrs (field number, field
type, value), link, target, label, key, value. Row and column form share one walk over the records: it asks a `Sink` to
put, or a `Source` to give, one named number after another, and keeps the running id and time.
"""

from __future__ import annotations

import struct

from wavelake.sources.wire import FIELDS, FIXED, Cursor, field, read_field, svarint, uvarint
from wavelake.sources.waves import pack, unpack

#: Record kinds by code (fixed values of the format).
TAGS = {"FULL": 1, "BEGIN": 2, "ATTR": 3, "END": 4, "LINK": 5, "META": 6}
#: Links by code (fixed values of the format).
LINKS = {"CAUSE_EFFECT": 0, "PARENT_CHILD": 1, "RELATED": 2, "CUSTOM": 0xFF}
#: Columns by number, and from where those of attributes count (fixed values of the format).
COLUMNS = {"tag": 0, "stream": 1, "type": 2, "id": 3, "time": 4, "duration": 5, "parent": 6, "link": 7, "target": 8, "label": 9, "key": 10, "value": 11, "inline": 12}
ATTRIBUTES = 0x80
DELTA, COLUMNAR = 0x04, 0x08

NAMES = {v: k for k, v in TAGS.items()}
LINK_NAMES = {v: k for k, v in LINKS.items()}
#: What each kind consists of, in order; `id` and `time` are differences.
SHAPE = {
    "FULL": ("stream", "type", "id", "time", "duration", "parent", "attrs"),
    "BEGIN": ("stream", "type", "id", "time", "parent"),
    "ATTR": ("id", "inline"),
    "END": ("id", "time"),
    "LINK": ("link", "id", "target", "label"),
    "META": ("id", "key", "value"),
}
BYTES = ("tag", "link")
#: What the older form without differences writes as eight bytes.
WIDE = ("id", "time", "duration", "parent", "target")


def _time(r: dict) -> int:
    return r["end"] if r["tag"] == "END" else r["start"]


def inline(attrs) -> bytes:
    """Attributes that carry their own types."""
    return uvarint(len(attrs)) + b"".join(uvarint(i) + bytes([FIELDS.index(kind)]) + field(kind, v) for i, kind, v in attrs)


def read_inline(c: Cursor) -> list[tuple]:
    out = []
    for _ in range(c.uvarint()):
        i, kind = c.uvarint(), FIELDS[c.u8()]
        out.append((i, kind, read_field(kind, c)))
    return out


def kind_in(schema: list[str], i: int) -> str:
    return schema[i] if i < len(schema) else "U64"


class Rows:
    """All parts of all records in one run of bytes."""

    def __init__(self):
        self.out = bytearray()

    def put(self, name: str, data: bytes) -> None:
        self.out += data

    def attrs(self, attrs, schema) -> None:
        self.out += uvarint(len(attrs)) + b"".join(uvarint(i) + field(kind_in(schema, i), v) for i, _, v in attrs)

    def inline(self, attrs) -> None:
        self.out += inline(attrs)

    def done(self) -> bytes:
        return bytes(self.out)


class Columns(Rows):
    """Each part in a column of its own."""

    def __init__(self):
        self.columns: dict[int, bytearray] = {}

    def put(self, name: str, data: bytes) -> None:
        self.columns.setdefault(COLUMNS[name], bytearray()).extend(data)

    def attrs(self, attrs, schema) -> None:
        if [i for i, _, _ in attrs] != list(range(len(schema))):
            raise ValueError("columns need every attribute of a record's type, in order")
        for i, _, v in attrs:
            self.columns.setdefault(ATTRIBUTES + i, bytearray()).extend(field(schema[i], v))

    def inline(self, attrs) -> None:
        data = inline(attrs)
        self.put("inline", uvarint(len(data)) + data)

    def done(self) -> bytes:
        return uvarint(len(self.columns)) + b"".join(uvarint(k) + uvarint(len(v)) + bytes(v) for k, v in sorted(self.columns.items()))


def _written(sink, start: int, records: list[dict], schemas: dict[int, list[str]], delta: bool) -> bytes:
    before_id, before = 0, start
    for r in records:
        sink.put("tag", bytes([TAGS[r["tag"]]]))
        for part in SHAPE[r["tag"]]:
            if part == "attrs":
                sink.attrs(r.get("attrs") or [], schemas.get(r["type"], []))
            elif part == "inline":
                sink.inline(r.get("attrs") or [])
            elif part == "link":
                sink.put(part, bytes([LINKS[r["link"]]]))
            elif part == "id":
                sink.put(part, svarint(r["id"] - before_id) if delta else struct.pack("<Q", r["id"]))
                before_id = r["id"]
            elif part == "time":
                sink.put(part, svarint(_time(r) - before) if delta else struct.pack("<Q", _time(r)))
                before = _time(r)
            elif part == "duration":
                if r["end"] < r["start"]:
                    raise ValueError(f"transaction {r['id']} ends before it starts")
                wide = r["end"] - r["start"] if delta or isinstance(sink, Columns) else r["end"]
                sink.put(part, uvarint(wide) if delta else struct.pack("<Q", wide))
                before = r["end"]
            else:
                fixed = not delta and part in WIDE and not isinstance(sink, Columns)
                sink.put(part, struct.pack("<Q", r.get(part) or 0) if fixed else uvarint(r.get(part) or 0))
    return sink.done()


def columns_fit(records: list[dict], schemas: dict[int, list[str]]) -> bool:
    """Whether every record has each attribute of its type, all types have one fixed-size field type by number, so that columns hold them."""
    seen: dict[int, str] = {}
    for r in records:
        if r["tag"] != "FULL":
            continue
        schema = schemas.get(r["type"], [])
        if [a[0] for a in r.get("attrs") or []] != list(range(len(schema))):
            return False
        for i, kind in enumerate(schema):
            if kind not in FIXED and kind != "ENUM" or seen.setdefault(i, kind) != kind:
                return False
    return True


def encode(start: int, records: list[dict], schemas: dict[int, list[str]], layout: str = "row", compressor: str | None = None, delta: bool = True) -> tuple[bytes, int, int]:
    """(payload, flags, end time). Layouts: row; column; auto, columns from 32 records on where they fit; adaptive, the smaller of both."""
    end = max([start, *(r[k] for r in records for k in ("start", "end") if r.get(k) is not None)])
    fits = layout != "row" and columns_fit(records, schemas)
    if layout not in ("row", "column", "auto", "adaptive"):
        raise ValueError(f"no layout {layout}")
    if layout == "column" and not fits:
        raise ValueError("these records don't fit into columns")

    def made(sink) -> tuple[bytes, int]:
        body = struct.pack("<QQ", start, end) + uvarint(len(records)) + _written(sink, start, records, schemas, delta)
        data, flags = pack(body, compressor)
        return data, flags | DELTA * delta | COLUMNAR * isinstance(sink, Columns)

    if fits and (layout == "column" or layout == "auto" and len(records) >= 32):
        data, flags = made(Columns())
    elif fits and layout == "adaptive":
        data, flags = min(made(Rows()), made(Columns()), key=lambda x: len(x[0]))
    else:
        data, flags = made(Rows())
    return data, flags, end


class Source:
    """Gives the parts of records from one run of bytes, or from columns."""

    def __init__(self, c: Cursor, columnar: bool):
        self.c, self.columns = c, None
        if columnar:
            self.columns = {}
            for _ in range(c.uvarint()):
                name = c.uvarint()
                self.columns[name] = Cursor(c.take(c.uvarint()))

    def of(self, name: str) -> Cursor:
        return self.c if self.columns is None else self.columns[COLUMNS[name]]

    def attrs(self, schema: list[str]) -> list[tuple]:
        if self.columns is None:
            out = []
            for _ in range(self.c.uvarint()):
                i = self.c.uvarint()
                out.append((i, kind_in(schema, i), read_field(kind_in(schema, i), self.c)))
            return out
        return [(i, kind, read_field(kind, self.columns[ATTRIBUTES + i])) for i, kind in enumerate(schema) if ATTRIBUTES + i in self.columns]

    def inline(self) -> list[tuple]:
        c = self.of("inline")
        return read_inline(c if self.columns is None else Cursor(c.take(c.uvarint())))


def decode(payload: bytes, flags: int, schemas: dict[int, list[str]]):
    """The records of a block."""
    c = Cursor(unpack(payload, flags))
    start = c.fixed("<Q")
    c.fixed("<Q")
    count, delta = c.uvarint(), bool(flags & DELTA)
    source = Source(c, bool(flags & COLUMNAR))
    before_id, before = 0, start
    for _ in range(count):
        tag = source.of("tag").u8()
        if tag not in NAMES:
            raise ValueError(f"no record kind {tag}")
        r = {"tag": NAMES[tag]}
        for part in SHAPE[r["tag"]]:
            if part == "attrs":
                r["attrs"] = source.attrs(schemas.get(r["type"], []))
                continue
            if part == "inline":
                r["attrs"] = source.inline()
                continue
            own = source.of(part)
            if part == "link":
                r["link"] = LINK_NAMES[own.u8()]
            elif part == "id":
                r["id"] = before_id = before_id + own.svarint() if delta else own.fixed("<Q")
            elif part == "time":
                before = before + own.svarint() if delta else own.fixed("<Q")
                r["end" if r["tag"] == "END" else "start"] = before
            elif part == "duration":
                given = own.uvarint() if delta else own.fixed("<Q")
                r["end"] = before = r["start"] + given if delta or source.columns is not None else given
            else:
                fixed = not delta and part in WIDE and source.columns is None
                r[part] = own.fixed("<Q") if fixed else own.uvarint()
        yield r
