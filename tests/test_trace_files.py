"""Trace files: numbers as bytes, every encoding and record kind through writer and reader, damaged and odd files."""

import io
import struct

import numpy as np
import pytest

from wavelake.functions.expr import Input
from wavelake.sources import calls, codecs, trace, txns, waves, wire
from wavelake.sources.container import Strings, TraceFile, Types
from wavelake.sources.writer import TraceWriter

OPTIONS = [{}, {"compressor": "zlib"}, {"compressor": "zstd"}, {"compress_waves": "zlib", "compress_time_table": True, "seekable": True}, {"compress_waves": "lz4"}, {"scope_grouped": True}]
VALUES = {
    ("2STATE", 1): [0, 1] * 40,
    ("2STATE", 32): [i * 0x1234 % 2**32 for i in range(50)],
    ("2STATE", 64): [2**64 - 1, 0, 2**63],
    ("2STATE", 200): [1 << 199, 3, (1 << 150) + 5],
    ("4STATE", 1): list("01XZ10"),
    ("4STATE", 5): ["01XZ0", "11111", "ZZZZZ"],
    ("9STATE", 1): list("01XZHUWL-"),
    ("9STATE", 4): ["HUWL", "01XZ", "0101"],
    ("REAL", 64): [1.5, float("inf"), -2.25, float("-inf")],
    ("ANALOG", 64): [0.5],
    ("STRING", 0): ["idle", "日本語", ""],
    ("BITVEC", 12): [4095, 1],
}


@pytest.mark.parametrize(("n", "raw"), [(0, b"\0"), (127, b"\x7f"), (128, b"\x80\1"), (300, b"\xac\2"), (2**64, b"\x80" * 9 + b"\2")])
def test_unsigned(n, raw):
    assert wire.uvarint(n) == raw and wire.Cursor(raw).uvarint() == n
    with pytest.raises(ValueError):
        wire.Cursor(b"\x80").uvarint()


def test_integers_in_bulk():
    rng = np.random.default_rng(0)
    for top in (1, 200, 2**20, 2**62):
        a = rng.integers(0, top, 500)
        raw = wire.many_uvarints(a)
        assert raw == b"".join(wire.uvarint(int(x)) for x in a)
        c = wire.Cursor(raw + b"\x05")
        assert c.uvarints(500).tolist() == a.tolist() and c.u8() == 5
    assert wire.Cursor(wire.uvarint(2**70) + b"\1").uvarints(2) == [2**70, 1]
    assert [wire.Cursor(wire.svarint(n)).svarint() for n in (0, -1, 1, -64, 2**62)] == [0, -1, 1, -64, 2**62]
    with pytest.raises(ValueError):
        wire.uvarint(-1)


@pytest.mark.parametrize(("kind", "value", "size"), [("U8", 255, 1), ("I16", -5, 2), ("U64", 2**64 - 1, 8), ("F32", 0.5, 4), ("F64", 1.1, 8), ("BOOL", True, 1), ("STRING", "é", 3), ("BYTES", b"\1\2", 3), ("BITVEC", (9, 257), 3), ("TIME", 7, 8), ("ENUM", 300, 2)])
def test_fields(kind, value, size):
    raw = wire.field(kind, value)
    assert len(raw) == size and wire.read_field(kind, wire.Cursor(raw)) == value
    with pytest.raises(struct.error):
        wire.field("U8", 256)


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("layout", ["row", "auto", "adaptive"])
def test_round_trip(tmp_path, options, layout):
    path = str(tmp_path / "a.trace")
    want: dict[int, list] = {}
    with TraceWriter(path, column_layout=layout, prefix="org.example", **options) as w:
        types = {k: w.add_signal_type(*k) for k in VALUES}
        assert w.add_signal_type("2STATE", 1) == types["2STATE", 1]
        bus = w.add_txn_schema("bus", [("addr", "U32"), ("data", "U64")])
        note = w.add_txn_schema("note", [("text", "STRING"), ("bits", "BITVEC"), ("kind", "ENUM", "DEC", 1), ("raw", "BYTES")])
        w.add_enum_type("sign", [(-1, "neg"), (3, "three")])
        one, two = w.add_stream_type("cpu", "memory", bus), w.add_stream_type("sig")
        w.declare_dependencies(one, [two])
        for edges in ([one], [two]):
            with pytest.raises(ValueError):
                w.declare_dependencies(two, edges)
        w.add_stream_profile(one, "a.b")
        w.add_stream_profile(one, "c.d")
        with w.hierarchy(1, "DESIGN", "top") as tree:
            tree.begin_scope("top")
            ids = {k: tree.add_var(f"v{i}", t, driver=("f.sv", 3) if i == 0 else None) for i, (k, t) in enumerate(types.items())}
            tree.begin_scope("sub", "FUNCTION")
            x = tree.add_var("x", types["2STATE", 1])
            tree.add_attr("n", 7, wire.U64)
            tree.end_scope()
            tree.end_scope()
            with pytest.raises(ValueError):
                tree.end_scope()
            stream = tree.add_stream(one, "s0", file="z.c", line=9)
        with w.vc_block(10) as b:
            for k, values in VALUES.items():
                for i, v in reversed(list(enumerate(values))):  # in any order
                    b.add_change(ids[k], 10 + 10 * i, v)
                want[ids[k]] = [(10 + 10 * i, v) for i, v in enumerate(values)]
            b.set_initial(x, 1)
        with w.vc_block(1000, "core.bytesplit") as b:
            for i in range(64):
                b.add_change(ids["REAL", 64], 1000 + i, 1000 + 0.25 * i)
                want[ids["REAL", 64]].append((1000 + i, 1000 + 0.25 * i))
        with pytest.raises(ValueError), w.vc_block(0, "no.such"):
            pass
        with w.txn_block(0, stream) as b:
            for i in range(40):
                b.full(stream, bus, 100 + i * 7 % 11, 10 * i, 10 * i + 5, attrs=[(0, "U32", 4 * i), (1, "U64", 2**63 + i)])
        big = (1 << 62) + 7
        with w.txn_block(5) as b:
            b.begin(stream, note, big, 100, parent=100, origin={"file": "a.c", "line": 3})
            b.attr(big, [(0, "STRING", "x"), (1, "BITVEC", (9, 257)), (2, "ENUM", 3), (3, "BYTES", b"\1\2")])
            b.attr(big, [(0, "STRING", "y")])
            b.link(big, 100, "CAUSE_EFFECT", "why")
            b.end(big, 300)
            b.meta(big, "k", "v")
        w.write_ext(b"COVG", 2, b"\1\2\3\4")
        with pytest.raises(ValueError):
            w.write_ext(b"COV")
        assert [w.write_aux(1, 7, b"a"), w.write_aux(1, 7, b"b"), w.write_aux(1, 9, b"")] == [0, 1, 0]
        for k, v in (("tool", "sim"), ("cores", 8), ("offset", -3), ("vdd", 1.8), ("strict", True), ("ints", [1, 2, 3]), ("names", ["a", "b"]), ("none", []), ("tool", "sim2")):
            w.add_trace_metadata(k, v)
        d = w.add_derived_signal("and", Input(0) & Input(1), [ids["2STATE", 1], x], 1)
        n = w.add_derived_signal("not", Input(0).lnot(), [d], 1, input_changes={d: [(0, 0), (20, 1)]})
    f = TraceFile(path)
    got: dict[int, list] = {}
    for name, _, at, _ in f.blocks:
        if name == "VC":
            flags, payload = f.payload(at)
            if flags & waves.STRUCTURED:
                own, rest = trace.codec_name(f, payload)
                assert own == "org.example.core.bytesplit"
                signals = [(*s, False) for s in codecs.found(own).decode(rest)]
            else:
                signals = waves.decode(payload, flags, f.signal_types())
            for var, _, _, times, values, _ in signals:
                got.setdefault(var, []).extend(zip(map(int, times), [v.item() if hasattr(v, "item") else v for v in values], strict=True))
    assert {k: got[k] for k in want} == want
    assert got[x] == [(10, 1)] and got[n] == [(0, 1), (20, 0)]
    records = [r for name, _, at, _ in f.blocks if name == "TXN" for flags, raw in [f.payload(at)] for r in txns.decode(raw, flags, f.schemas())]
    assert len(records) == 48 and records[39]["attrs"] == [(0, "U32", 156), (1, "U64", 2**63 + 39)]
    assert [r["tag"] for r in records[40:]] == ["BEGIN", "META", "META", "ATTR", "ATTR", "LINK", "END", "META"] and records[-2] == {"tag": "END", "id": big, "end": 300}
    assert records[43]["attrs"] == [(0, "STRING", "x"), (1, "BITVEC", (9, 257)), (2, "ENUM", 3), (3, "BYTES", b"\1\2")]
    assert f.strings.lookup(records[-1]["key"]) == "k" and f.strings.lookup(records[41]["key"]) == "org.example.origin.file"
    assert f.dependencies() == {one: [two]} and f.read_blobs(1, 7) == [b"a", b"b"] and f.read_blobs(5, 5) == []
    assert {k: v for k, _, v in f.metadata} == {"tool": "sim2", "cores": 8, "offset": -3, "vdd": 1.8, "strict": True, "ints": [1, 2, 3], "names": ["a", "b"], "none": []}
    assert f.trees[0].paths()[-2:] == ["top.sub.x", "s0"] and f.types.enums[1] == ("sign", [(-1, "neg"), (3, "three")])
    assert f.types.streams[one]["metadata"][0][2] == ["a.b", "c.d"] and [x["name"] for x in f.derived()] == ["and", "not"]
    assert f.seek(11) == f.index.vc[-2 if not options.get("scope_grouped") else -2][2] and (f.timescale_exp, f.timezero) == (-9, 0)
    with pytest.raises(ValueError):
        f.seek(5000)


def test_without_an_index_and_cut_off(tmp_path):
    class Pipe(io.BytesIO):
        def seek(self, *a):
            raise OSError("a pipe")

    pipe = Pipe()
    w = TraceWriter(pipe)
    with w.vc_block(0) as b:
        b.add_change(1, 3, 1)
    w.close()
    whole, cut = tmp_path / "a.trace", tmp_path / "b.trace"
    whole.write_bytes(pipe.getvalue())
    cut.write_bytes(pipe.getvalue()[:-5] + b"")
    assert TraceFile(str(whole)).index is None and [b[0] for b in TraceFile(str(whole)).blocks] == ["HEADER", "VC", "STRINGS", "TYPES", "INDEX"]
    assert [b[0] for b in TraceFile(str(cut)).blocks] == ["HEADER", "VC", "STRINGS", "TYPES"]
    (tmp_path / "c.trace").write_bytes(b"no trace at all, only text")
    with pytest.raises(ValueError):
        TraceFile(str(tmp_path / "c.trace"))


def test_transaction_rules():
    with pytest.raises(ValueError):
        txns.encode(0, [{"tag": "FULL", "stream": 1, "type": 1, "id": 1, "start": 5, "end": 4}], {})
    sparse = [{"tag": "FULL", "stream": 1, "type": 1, "id": i, "start": i, "end": i, "attrs": [(1, "U32", i)]} for i in range(40)]
    schemas = {1: ["U32", "U32"]}
    with pytest.raises(ValueError):
        txns.encode(0, sparse, schemas, "column")
    assert not txns.encode(0, sparse, schemas, "auto")[1] & txns.COLUMNAR
    for delta in (True, False):
        full = [{"tag": "FULL", "stream": 1, "type": 1, "id": 9 - i, "start": 10 + i, "end": 20 + i, "parent": i, "attrs": [(0, "U32", i), (1, "U32", 2 * i)]} for i in range(5)]
        mixed = [*full, {"tag": "LINK", "link": "CUSTOM", "id": 3, "target": 2**40, "label": 0}, {"tag": "END", "id": 1, "end": 3}, {"tag": "ATTR", "id": 1, "attrs": [(0, "BOOL", True)]}]
        for layout in ("row", "column"):
            raw, flags, end = txns.encode(5, mixed, schemas, layout, "zlib", delta)
            assert list(txns.decode(raw, flags, schemas)) == mixed and end == 24


def test_repeated_record_type_and_unknown_entry():
    s = Strings()
    t = Types()
    t.records[1] = ("a", [])
    raw = t.encode(s)
    with pytest.raises(ValueError):
        Types().decode(wire.uvarint(2) + raw[1:] * 2, s)
    later = Types()
    later.decode(wire.uvarint(2) + bytes([9]) + wire.uvarint(3) + b"xyz" + raw[1:], s)  # passed over by its length
    assert later.records == {1: ("a", [])}
    with pytest.raises(KeyError):
        s.lookup(99)


def test_codecs():
    rng = np.random.default_rng(1)
    raw = rng.bytes(240)
    for width in (1, 2, 3, 8):
        assert codecs.unsplit(codecs.split(raw, width), width) == raw
    with pytest.raises(ValueError):
        codecs.split(b"abc", 2)
    for bad in ("nodots", "Upper.case", "a..b", ""):
        with pytest.raises(ValueError):
            codecs.checked(bad)
    assert codecs.found("org.example.core.bytesplit").decode and codecs.found("org.example.other") is None
    smooth = [(i, 1000 + 0.25 * i) for i in range(1000)]
    import zlib

    plain = zlib.compress(struct.pack("<1000d", *[v for _, v in smooth]))
    assert len(codecs.encode_planes(0, {1: smooth}, {1: ("REAL", 64)})) < len(plain)
    with pytest.raises(ValueError):
        codecs.encode_planes(0, {1: [(0, "x")]}, {1: ("STRING", 0)})


def test_a_codecs_life(tmp_path):
    """Opened at its first block, encoding each, finalized while blobs can be written, closed at the end; replaced by a codec of the same id."""
    steps = []

    class Counting(codecs.Session):
        def encode(self, start, changes, types):
            steps.append(("encode", start))
            return codecs.encode_planes(start, changes, types)

        def finalize(self):
            steps.append(("finalize", self.store.write_aux(9, 0, str(len(steps)).encode())))

        def close(self):
            steps.append(("close", None))

    codecs.register(codecs.Codec("own.counting"))
    own = codecs.register(codecs.Codec("own.counting", session=Counting, decode=codecs.decode_planes, capabilities=codecs.Capability.LOSSLESS | codecs.Capability.RANDOM_ACCESS))
    try:
        path = str(tmp_path / "a.trace")
        with TraceWriter(path) as w:
            for start in (0, 10):
                with w.vc_block(start, "own.counting") as b:
                    b.add_change(1, start, 1)
        assert steps == [("encode", 0), ("encode", 10), ("finalize", 0), ("close", None)]
        t = TraceFile(path)
        assert t.read_blobs(9, 0) == [b"2"] and codecs.Capability.RANDOM_ACCESS in own.capabilities
        blocks = [at for kind, _, at, _ in t.blocks if kind == "VC"]
        read = lambda registry: [r for at in blocks for r in trace.changes_of(t, "a", at, trace.Wanted({}), registry)]
        assert sum(len(b) for b in read(codecs.REGISTRY)) == 2 and read({}) == []
    finally:
        codecs.REGISTRY.pop("own.counting")


def test_calls(tmp_path):
    path = str(tmp_path / "c.trace")
    with TraceWriter(path) as w:
        c = calls.CallWriter(w, w.add_stream_type("calls"), w.add_stream_type("signatures"), [(1, "outer", ["INT"], "INT"), (2, "inner", ["STR", "REAL"])], window=2)
        c.enter(1, (3,), 10)
        c.enter(2, ("hi", 0.5), 12)
        c.exit(None, 13)
        c.exit(99, 20)
        for i in range(6):
            c.enter(1, (i % 3,), 30 + i)
            c.exit(-i, 31 + i)
        with pytest.raises(ValueError):
            c.enter(1, (), 0)
        c.enter_raw(99, [42, -43], 20, 30)
        c.close()
    t = TraceFile(path)
    got = [(r[3], r[4], r[5], r[7], r[8]) for r in calls.event_rows(t)]
    assert got[:4] == [(True, 10, 1, "[3]", None), (True, 12, 2, '["hi", 0.5]', None), (False, 13, None, None, None), (False, 20, None, None, 99)]
    assert [(r[3], r[4]) for r in got[4::2]] == [(f"[{i % 3}]", None) for i in range(6)] and [r[4] for r in got[5::2]] == [0, -1, -2, -3, -4, -5]
    assert calls.signature_rows(t) == [(2, 1, "outer", ["INT"], "INT"), (2, 2, "inner", ["STR", "REAL"], "NONE")]


def test_scan_and_write(spark, tmp_path):
    rows = spark.createDataFrame([(v, t, float(v * t)) for v in range(5) for t in range(100)], "var_id long, time long, v_real double")
    path = str(tmp_path / "set")
    trace.register(spark)
    rows.repartitionByRange(3, "time").sortWithinPartitions("time").write.format("trace").option("table", "changes").option("block_rows", 50).mode("append").save(path)
    got = trace.scan(spark, path)
    assert sorted(map(tuple, got.select("var_id", "time", "v_real").collect())) == sorted(map(tuple, rows.collect()))
    assert trace.scan(spark, path, var_id=[1, 2], start=10, end=19).count() == 20 and got.count() == 500
    with pytest.raises(Exception, match="two types"):
        rows.select("var_id", "time", (rows.v_real.cast("int") + 1).alias("bit_width"), rows.time.alias("v_int")).coalesce(1).write.format("trace").mode("append").save(str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not [f for f in trace.listed(str(tmp_path / "bad"))]
    rows.limit(1).write.format("trace").mode("overwrite").save(path)
    assert trace.scan(spark, path).count() == 1
    assert trace.scan(spark, path, "nodes").select("name").first()[0] == "v0"
