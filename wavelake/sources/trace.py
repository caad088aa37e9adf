"""Trace files as a Spark data source: `spark.read.format("trace").option("table", ...).load(path)`.

A path is a file or a folder of files, of which each is a trace. Data tables are read by one partition for each data
block, planned from the files' indexes; with more than `split_files` files, by one for each file, whose blocks its
task then prunes. What is wanted of a table reaches the reader as options, so that blocks and waves are skipped: var_id,
stream_inst_id, kind, owner, key and ext_type (values joined by commas), time_from and time_to (inclusive). `scan()` sets
them and filters the rows too. They aren't taken from Spark's filter pushdown: in Spark 4.1 a DataFrame that is used again
keeps the filters pushed at its first use, and would then lose rows.

Blocks of an unknown codec are left out of the changes and can be seen in the table `blocks`. Tables that describe a
trace have one partition for each file. `df.write.format("trace")` writes changes or records, one file for each task;
files get their names when the job commits, so tasks that are lost or run twice leave nothing behind.
`spark.readStream.format("trace")` takes files in the order they appear.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from wavelake.sources import calls, codecs, txns, waves
from wavelake.sources.container import MIXED, TraceFile
from wavelake.sources.wire import ARRAY, FIELDS, Cursor
from wavelake.sources.writer import TraceWriter

ATTR = "struct<field_idx int, field_type string, v_int decimal(20,0), v_real double, v_text string, v_bytes binary, bit_width int>"
#: Each table's columns.
SCHEMAS = {
    "changes": "trace string, block long, var_id long, time long, encoding string, bit_width int, initial boolean, v_int long, v_wide binary, v_states string, v_real double, v_text string",
    "records": f"trace string, block long, seq long, tag string, stream_inst_id long, txn_type_id long, txn_id long, start_time long, end_time long, parent_txn_id long, attrs array<{ATTR}>, link_type string, target_txn_id long, label string, key string, value string",
    "traces": "trace string, path string, version_major int, version_minor int, timescale_exp int, timezero long",
    "blocks": "trace string, block long, kind string, flags int, length long, start_time long, end_time long, stream_inst_id long, codec string, available boolean",
    "strings": "trace string, str_id long, s string",
    "signal_types": "trace string, sig_type_id long, encoding string, bit_width int, radix string",
    "txn_fields": "trace string, txn_type_id long, type_name string, field_idx int, field_name string, field_type string, radix string, enum_type_id long",
    "enum_values": "trace string, enum_type_id long, enum_name string, value long, label string",
    "stream_types": "trace string, stream_type_id long, name string, kind string, txn_type_id long, codec string, version long, params binary",
    "stream_deps": "trace string, stream_type_id long, pos int, input_id long",
    "nodes": "trace string, hier_id long, hier_kind string, hier_name string, node_idx int, parent_idx int, node string, name string, path string, id long, type_id long, kind string, component string, file string, line long, alias_of long",
    "node_attrs": "trace string, hier_id long, node_idx int, pos int, key string, type string, value string",
    "metadata": "trace string, stream_type_id long, pos int, key string, type string, value string",
    "aux": "trace string, owner long, key long, ordinal long, block long, length long, payload binary",
    "ext": "trace string, block long, ext_type string, ext_version int, payload binary",
    "signatures": "trace string, sig_stream long, func_id long, name string, arg_types array<string>, ret_type string",
    "call_events": "trace string, call_stream long, block long, seq long, is_enter boolean, time long, func_id long, name string, args string, ret long",
    "derived": "trace string, var_id long, name string, bit_width int, inputs array<long>, code binary, materialized boolean",
}
#: What metadata types are called here, by code.
TYPE_NAMES = {-1: "text", 0: "bool", 1: "i64", 2: "u64", 3: "f64", 4: "string"}
BATCH = 20_000
SPLIT_FILES = 256


def type_name(code: int) -> str:
    return f"array<{TYPE_NAMES[code & ~ARRAY]}>" if code >= 0 and code & ARRAY else TYPE_NAMES[code]


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TraceSource)


def scan(spark: SparkSession, path: str, table: str = "changes", start: int | None = None, end: int | None = None, **equal) -> DataFrame:
    """A table, or the rows of it whose columns have the values given (one or a list of them), between two inclusive times of which either may be left out."""
    register(spark)
    reader, kept = spark.read.format("trace").option("table", table), []
    for column, given in equal.items():
        values = list(given) if isinstance(given, (list, tuple, set)) else [given]
        if column in KEYS:
            reader = reader.option(column, ",".join(map(str, values)))
        kept.append(F.col(column).isin(values))
    for name, bound, keeps in (("time_from", start, lambda: F.col("time") >= start), ("time_to", end, lambda: F.col("time") <= end)):
        if bound is not None and table == "changes":
            reader = reader.option(name, bound)
            kept.append(keeps())
    out = reader.load(path)
    for k in kept:
        out = out.where(k)
    return out


def listed(path: str) -> list[str]:
    """The trace files of a path, in order; hidden ones are left out."""
    if "://" in path:
        from pyarrow import fs

        system, own = fs.FileSystem.from_uri(path)
        scheme = path.split("://")[0]
        if system.get_file_info(own).type == fs.FileType.File:
            return [path]
        names = [f.path for f in system.get_file_info(fs.FileSelector(own, recursive=True)) if f.type == fs.FileType.File]
        return sorted(f"{scheme}://{n}" for n in names if not os.path.basename(n).startswith(("_", ".")))
    path = path.removeprefix("file:")
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith(("_", ".")))


#: Columns that a reader can be told values of, and what these are.
KEYS = {"var_id": int, "stream_inst_id": int, "kind": str, "owner": int, "key": int, "ext_type": str}


class Wanted:
    """What the options leave of a table."""

    def __init__(self, options: dict):
        self.low, self.high = (int(options[k]) if options.get(k) else None for k in ("time_from", "time_to"))
        self.among = {k: {kind(v) for v in options[k].split(",")} for k, kind in KEYS.items() if k in options}

    def span(self, low, high) -> bool:
        """Whether times from low to high may hold a wanted one; unknown bounds may."""
        if low is None or high is None:
            return True
        return (self.low is None or self.low <= high) and (self.high is None or self.high >= low)

    def one(self, name: str, value) -> bool:
        return name not in self.among or value in self.among[name]


@dataclass
class Part(InputPartition):
    path: str
    block: int | None = None


class TraceReader(DataSourceReader):
    def __init__(self, path: str, table: str, options: dict):
        self.path, self.table = path, table
        self.wanted = Wanted(options)
        self.split = int(options.get("split_files", SPLIT_FILES))
        self.payloads = options.get("payloads", "true").lower() != "false"
        self.registry = dict(codecs.REGISTRY)

    def partitions(self):
        files = listed(self.path)
        if self.table not in ("changes", "records") or len(files) > self.split:
            return [Part(f) for f in files]
        return [Part(f, at) for f in files for at in blocks_of(TraceFile(f), self.table, self.wanted)] or [Part(f) for f in files[:1]]

    def read(self, part: Part):
        yield from rows_of(TraceFile(part.path), self.table, self.wanted, part.block, self.registry, self.payloads)


def blocks_of(t: TraceFile, table: str, w: Wanted) -> list[int]:
    """Offsets of the data blocks that may hold wanted rows. A transaction's times reach beyond its records, so only value changes are pruned by time."""
    if table == "changes":
        times = {x[2]: x[:2] for x in t.index.vc} if t.index else {}
        return [at for kind, _, at, _ in t.blocks if kind == "VC" and w.span(*times.get(at, (None, None)))]
    streams = {x[2]: x[3] for x in t.index.txn} if t.index else {}
    return [at for kind, _, at, _ in t.blocks if kind == "TXN" and (streams.get(at, MIXED) == MIXED or w.one("stream_inst_id", streams[at]))]


def codec_name(t: TraceFile, payload: bytes) -> tuple[str, bytes]:
    c = Cursor(payload)
    name = t.strings.lookup(c.uvarint())
    return name, payload[c.at :]


def rows_of(t: TraceFile, table: str, w: Wanted, block: int | None, registry: dict, payloads: bool):
    name = os.path.basename(t.path)
    if table in ("changes", "records"):
        for at in [block] if block is not None else blocks_of(t, table, w):
            yield from (changes_of if table == "changes" else records_of)(t, name, at, w, registry)
        return
    for row in DESCRIBED[table](t, w, registry, payloads):
        yield (name, *row)


def changes_of(t: TraceFile, name: str, at: int, w: Wanted, registry: dict):
    flags, payload = t.payload(at)
    only = w.among.get("var_id")
    if flags & waves.STRUCTURED:
        own, rest = codec_name(t, payload)
        codec = codecs.found(own, registry)
        if codec is None or codec.decode is None:
            return
        signals = ((*x, False) for x in codec.decode(rest) if only is None or x[0] in only)
    else:
        signals = waves.decode(payload, flags, t.signal_types(), only)
    # signals of a block one after another, many small ones in one batch
    held, n = [], 0
    for signal in signals:
        held.append(signal)
        n += len(signal[3])
        if n >= BATCH:
            yield _batch(name, at, held)
            held, n = [], 0
    if held:
        yield _batch(name, at, held)


def _batch(name: str, at: int, signals: list) -> pa.RecordBatch:
    columns: dict[str, list] = {k: [] for k in ("var_id", "time", "encoding", "bit_width", "initial", "v_int", "v_wide", "v_states", "v_real", "v_text")}
    kinds = {"v_int": pa.int64(), "v_wide": pa.binary(), "v_states": pa.string(), "v_real": pa.float64(), "v_text": pa.string()}
    for var, kind, width, times, values, initial in signals:
        n = len(times)
        columns["var_id"].append(pa.array(np.full(n, var, np.int64)))
        columns["time"].append(pa.array(np.asarray(times, np.int64)))
        columns["encoding"].append(pa.array([kind] * n))
        columns["bit_width"].append(pa.array(np.full(n, width, np.int32)))
        columns["initial"].append(pa.array(np.full(n, initial)))
        own = {"4STATE": "v_states", "9STATE": "v_states", "REAL": "v_real", "ANALOG": "v_real", "STRING": "v_text"}.get(kind, "v_int" if width <= 63 else "v_wide")
        if own == "v_wide":
            values = [int(v).to_bytes((width + 7) // 8, "big") for v in values]
        for k, type_ in kinds.items():
            columns[k].append(pa.array(values, type_) if k == own else pa.nulls(n, type_))
    out = {k: pa.concat_arrays(v) for k, v in columns.items()}
    n = len(out["time"])
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.full(n, at, np.int64)), *out.values()], names=["trace", "block", *out])


def records_of(t: TraceFile, name: str, at: int, w: Wanted, registry: dict):
    flags, payload = t.payload(at)
    text = lambda i: t.strings.lookup(i) if i else None
    for seq, r in enumerate(txns.decode(payload, flags, t.schemas())):
        if r.get("stream") is not None and not w.one("stream_inst_id", r["stream"]):
            continue
        attrs = [attribute(*a) for a in r["attrs"]] if "attrs" in r else None
        yield Row(name, at, seq, r["tag"], r.get("stream"), r.get("type"), r["id"], r.get("start"), r.get("end"), r.get("parent"), attrs, r.get("link"), r.get("target"), text(r.get("label")), text(r.get("key")), text(r.get("value")))


def attribute(i: int, kind: str, v) -> tuple:
    from decimal import Decimal

    if kind in ("F32", "F64"):
        return i, kind, None, v, None, None, None
    if kind == "STRING":
        return i, kind, None, None, v, None, None
    if kind == "BYTES":
        return i, kind, None, None, None, v, None
    if kind == "BITVEC":
        return i, kind, None, None, None, v[1].to_bytes((v[0] + 7) // 8, "big"), v[0]
    return i, kind, Decimal(int(v)), None, None, None, None


def attribute_value(a) -> tuple[int, str, object]:
    """The (field number, type, value) that a row's attribute stands for."""
    kind = a["field_type"]
    if kind not in FIELDS:
        raise ValueError(f"no field type {kind}")
    if kind in ("F32", "F64"):
        return a["field_idx"], kind, a["v_real"]
    if kind == "STRING":
        return a["field_idx"], kind, a["v_text"]
    if kind == "BYTES":
        return a["field_idx"], kind, bytes(a["v_bytes"])
    if kind == "BITVEC":
        return a["field_idx"], kind, (a["bit_width"], int.from_bytes(a["v_bytes"], "big"))
    return a["field_idx"], kind, int(a["v_int"])


def _blocks(t, w, registry, payloads):
    own = {x[2]: (x[0], x[1], None) for x in t.index.vc} | {x[2]: (x[0], x[1], None if x[3] == MIXED else x[3]) for x in t.index.txn} if t.index else {}
    for kind, flags, at, size in t.blocks:
        if not w.one("kind", kind):
            continue
        codec, known = None, True
        if kind == "VC":
            codec = codec_name(t, t.payload(at)[1])[0] if flags & waves.STRUCTURED else "core.valuechange"
            found = codecs.found(codec, registry)
            known = found is not None and (codec == "core.valuechange" or found.decode is not None)
        yield at, kind, flags, size, *own.get(at, (None, None, None)), codec, known


def _nodes(t, w, registry, payloads):
    for tree in t.trees:
        for i, (n, path) in enumerate(zip(tree.nodes, tree.paths(), strict=True)):
            x = n.own
            yield tree.number, tree.kind, tree.name, i, n.parent, n.node, n.name, path, x.get("id"), x.get("type"), x.get("kind") or x.get("direction"), x.get("component") or None, x.get("file") or None, x.get("line"), x.get("alias")


def _metadata(t, w, registry, payloads):
    for owner, values in ((None, t.metadata), *((i, x["metadata"]) for i, x in t.types.streams.items())):
        for pos, (k, kind, v) in enumerate(values):
            yield owner, pos, k, type_name(kind), json.dumps(v)


def _aux(t, w, registry, payloads):
    for owner, key, n, at, size in t.blobs():
        if w.one("owner", owner) and w.one("key", key):
            flags, raw = t.payload(at) if payloads else (0, None)
            yield owner, key, n, at, size, waves.unpack(raw, flags) if payloads else None


def _ext(t, w, registry, payloads):
    for kind, _, at, _ in t.blocks:
        if kind == "EXT":
            raw = t.payload(at)[1]
            name = raw[:4].decode("latin-1")
            if w.one("ext_type", name):
                yield at, name, int.from_bytes(raw[4:6], "little"), raw[6:]


DESCRIBED = {
    "traces": lambda t, *_: [(t.path, *t.version, t.timescale_exp, t.timezero)],
    "blocks": _blocks,
    "strings": lambda t, *_: [(i, s) for i, s in enumerate(t.strings.of) if i],
    "signal_types": lambda t, *_: [(i, *x) for i, x in t.types.signals.items()],
    "txn_fields": lambda t, *_: [(i, name, k, *f) for i, (name, fields) in t.types.records.items() for k, f in enumerate(fields)],
    "enum_values": lambda t, *_: [(i, name, v, label) for i, (name, values) in t.types.enums.items() for v, label in values],
    "stream_types": lambda t, *_: [(i, x["name"], x["kind"], x["type"], x["codec"], x["version"], x["params"]) for i, x in t.types.streams.items()],
    "stream_deps": lambda t, *_: [(i, k, d) for i, x in t.types.streams.items() for k, d in enumerate(x["inputs"])],
    "nodes": _nodes,
    "node_attrs": lambda t, *_: [(tree.number, i, k, key, type_name(kind), json.dumps(v)) for tree in t.trees for i, n in enumerate(tree.nodes) for k, (key, kind, v) in enumerate(n.attrs)],
    "metadata": _metadata,
    "aux": _aux,
    "ext": _ext,
    "signatures": lambda t, *_: calls.signature_rows(t),
    "call_events": lambda t, *_: calls.event_rows(t),
    "derived": lambda t, *_: [(x["var_id"], x["name"], x["bit_width"], x["inputs"], x["code"], x["materialized"]) for x in t.derived()],
}


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None
    name: str | None


class Writing(DataSourceWriter):
    """Options: `table`, and those of TraceWriter; `block_rows`; `schemas`, record types as JSON {id: [[field, type], ...]}; `names`, signal names as JSON {id: name}."""

    def __init__(self, path: str, table: str, options: dict, overwrite: bool):
        if table not in ("changes", "records"):
            raise ValueError(f"{table} isn't written by rows")
        self.path, self.table, self.overwrite = path.removeprefix("file:"), table, overwrite
        self.rows = int(options.get("block_rows", 100_000))
        self.schemas = {int(k): v for k, v in json.loads(options.get("schemas", "{}")).items()}
        self.names = {int(k): v for k, v in json.loads(options.get("names", "{}")).items()}
        given = {k: options[k] for k in ("compressor", "compress_waves", "column_layout", "prefix") if options.get(k)}
        flags = {k: options[k].lower() == "true" for k in ("compress_time_table", "seekable") if k in options}
        numbers = {k: int(options[k]) for k in ("timescale_exp", "timezero") if k in options}
        self.options, self.codec = given | flags | numbers, options.get("codec")
        if not self.overwrite and os.path.isdir(self.path) and listed(self.path):
            raise FileExistsError(self.path)

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        mark = uuid.uuid4().hex
        hidden = os.path.join(self.path, f".{mark}")
        held, any_rows = [], False
        put = self._changes if self.table == "changes" else self._records
        with TraceWriter(hidden, **self.options) as w:
            known: dict[int, tuple[str, int]] = {}
            for i in sorted(self.schemas):
                while len(w.types.records) < i - 1:
                    w.add_txn_schema("unused", [])
                w.add_txn_schema(f"type{i}", [tuple(f) for f in self.schemas[i]])
            for row in rows:
                held.append(row)
                any_rows = True
                if len(held) >= self.rows:
                    put(w, held, known)
                    held = []
            if held:
                put(w, held, known)
            if known:
                with w.hierarchy(1, "DESIGN", "") as tree:
                    for var, (kind, width) in sorted(known.items()):
                        tree._add("var", self.names.get(var, f"v{var}"), {"id": var, "type": w.add_signal_type(kind, width), "direction": "NONE", "alias": 0, "file": "", "line": 0})
        if not any_rows:
            os.remove(hidden)
            return Written(None, None)
        return Written(hidden, os.path.join(self.path, f"part-{TaskContext.get().partitionId():05}-{mark}.trace"))

    def _changes(self, w: TraceWriter, rows: list, known: dict) -> None:
        columns = rows[0].__fields__
        of = lambda r, k: r[k] if k in columns else None
        with w.vc_block(min(r["time"] for r in rows), self.codec) as b:
            for r in rows:
                value, kind = next(((of(r, k), own) for k, own in (("v_int", "2STATE"), ("v_wide", "2STATE"), ("v_real", "REAL"), ("v_text", "STRING"), ("v_states", "4STATE")) if of(r, k) is not None), (None, None))
                kind = of(r, "encoding") or kind
                if kind is None:
                    raise ValueError(f"signal {r['var_id']} has no value at {r['time']}")
                width = of(r, "bit_width")
                if width is None:
                    width = {"2STATE": 63, "REAL": 64, "STRING": 0}[kind] if kind in ("2STATE", "REAL", "STRING") else len(value)
                if known.setdefault(r["var_id"], (kind, width)) != (kind, width):
                    raise ValueError(f"signal {r['var_id']} has two types")
                w.vars[r["var_id"]] = (kind, width)
                b.add_change(r["var_id"], r["time"], int.from_bytes(value, "big") if isinstance(value, (bytes, bytearray)) else value)

    def _records(self, w: TraceWriter, rows: list, known: dict) -> None:
        columns = rows[0].__fields__
        of = lambda r, k: r[k] if k in columns else None
        streams = {of(r, "stream_inst_id") for r in rows}
        times = [t for r in rows for t in (of(r, "start_time"), of(r, "end_time")) if t is not None]
        with w.txn_block(min(times, default=0), streams.pop() if len(streams) == 1 and None not in streams else None) as b:
            for r in rows:
                attrs = [attribute_value(a) for a in of(r, "attrs") or []]
                txn = r["txn_id"]
                if r["tag"] == "FULL":
                    fits = [(i, k) for i, k, _ in attrs] == list(enumerate(f[1] for f in self.schemas.get(r["txn_type_id"], [])))
                    b.full(r["stream_inst_id"], r["txn_type_id"], txn, r["start_time"], r["end_time"], of(r, "parent_txn_id") or 0, attrs if fits else [])
                    if attrs and not fits:
                        b.attr(txn, attrs)
                elif r["tag"] == "BEGIN":
                    b.begin(r["stream_inst_id"], r["txn_type_id"], txn, r["start_time"], of(r, "parent_txn_id") or 0)
                elif r["tag"] == "ATTR":
                    b.attr(txn, attrs)
                elif r["tag"] == "END":
                    b.end(txn, r["end_time"])
                elif r["tag"] == "LINK":
                    b.link(txn, r["target_txn_id"], of(r, "link_type") or "RELATED", of(r, "label") or "")
                elif r["tag"] == "META":
                    b.meta(txn, r["key"], r["value"] or "")
                else:
                    raise ValueError(f"no record kind {r['tag']}")

    def commit(self, messages):
        old = listed(self.path) if self.overwrite and os.path.isdir(self.path) else []
        os.makedirs(self.path, exist_ok=True)
        for m in messages:
            if m is not None and m.name:
                os.replace(m.hidden, m.name)
        for f in old:
            os.remove(f)
        with open(os.path.join(self.path, "_SUCCESS"), "w"):
            pass

    def abort(self, messages):
        for m in messages:
            if m is not None and m.hidden and os.path.exists(m.hidden):
                os.remove(m.hidden)


class Arriving(DataSourceStreamReader):
    """Files of a folder in the order of their times and names; an offset is the last one taken."""

    def __init__(self, path: str, table: str, options: dict):
        self.inner = TraceReader(path, table, options)
        self.path = path.removeprefix("file:")

    def _files(self) -> list[tuple[int, str]]:
        return sorted((os.stat(f).st_mtime_ns, f) for f in listed(self.path)) if os.path.isdir(self.path) else []

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self._files()
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        low, high = (start["time"], start["file"]), (end["time"], end["file"])
        return [Part(f) for t, f in self._files() if low < (t, f) <= high]

    def read(self, part: Part):
        yield from self.inner.read(part)


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace"

    def _table(self) -> str:
        table = self.options.get("table", "changes")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table}; there are {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema):
        return TraceReader(self.options["path"], self._table(), self.options)

    def writer(self, schema, overwrite):
        return Writing(self.options["path"], self._table(), self.options, overwrite)

    def streamReader(self, schema):  # noqa: N802
        return Arriving(self.options["path"], self._table(), self.options)
