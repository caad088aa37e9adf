"""Signal, transaction, call, hierarchy, graph and expression operators against plain versions, with nulls and clashes."""

import random

import pytest
from pyspark.sql import functions as F

from wavelake.functions import bytecode, states
from wavelake.functions.expr import Const, Expr, Input, compile_expr
from wavelake.operators import calls, derived, hierarchy, signals, transactions
from wavelake.plans import graph
from wavelake.streaming import capture

A, B = Input(0), Input(1)
VECTORS = [
    (A & B, (0b1100, 0b1010), 8, 0b1000), (A | B, (0b1100, 0b1010), 8, 0b1110), (A ^ B, (0b1100, 0b1010), 8, 0b0110), (~A, (0x0F, 0), 8, 0xF0),
    (A.eq(B), (5, 5), 1, 1), (A.ne(B), (5, 6), 1, 1), (A.shl(4), (3, 0), 8, 0x30), (A.shr(2), (0b1100, 0), 8, 0b11), (A.reduce_or(4), (0b0010, 0), 1, 1),
    (A.reduce_and(4), (0b1110, 0), 1, 0), (A.reduce_and(4), (0b1111, 0), 1, 1), (A.reduce_and(0), (0, 0), 1, 1), (A.reduce_or(0), (7, 0), 1, 0), (A.slice_(2, 3), (0b11100, 0), 3, 0b111),
    (A.concat(B, 4), (0xA, 0x5), 8, 0xA5), (A & Const(0x0F), (0xAB, 0), 8, 0x0B), (A.shl(63).shr(60), (3, 0), 16, 24), (A.concat(B, 62).shr(62), (3, 1), 16, 3),
    (A.shl(70), (1, 0), 72, 1 << 70), (A | Const(2**63), (1, 0), 64, 2**63 + 1), (~A, (0, 0), 100, 2**100 - 1),
]


def number(x):
    return int.from_bytes(x, "big") if isinstance(x, (bytes, bytearray)) else x % 2**64


@pytest.mark.parametrize(("e", "inputs", "width", "want"), VECTORS)
def test_expressions(spark, e, inputs, width, want):
    code = bytecode.compile_bytes(e)
    assert bytecode.parse(code) == e and bytecode.value(e, list(inputs)) % (1 << width) == want
    df = spark.createDataFrame([inputs], "a long, b long")
    assert number(df.select(compile_expr(e, [F.col("a"), F.col("b")], width)).first()[0]) == want


def test_random_expressions(spark):
    rng = random.Random(4)

    def rand(d):
        if d == 0:
            return rng.choice([A, B]) if rng.random() < 0.7 else Const(rng.choice([0, 1, 2**31, 2**63 + 5, 2**70 + 3]))
        op, n = rng.choice([("not", 0), ("and", 0), ("or", 0), ("xor", 0), ("lnot", 0), ("eq", 0), ("ne", 0), ("shl", 63), ("shr", 65), ("reduce_and", 64), ("reduce_or", 64), ("slice", 70), ("concat", 62)])
        _, operands, numbers = bytecode.OPS[op]
        return Expr(op, (*(rand(d - 1) for _ in range(operands)), *(rng.randint(0, n) for _ in range(numbers))))

    rows = [(0, 0), (2**63 - 1, 2**31)] + [(rng.getrandbits(63), rng.getrandbits(20)) for _ in range(4)]
    df = spark.createDataFrame(rows, "a long, b long")
    cases = [(rand(rng.randrange(1, 4)), rng.choice([1, 8, 33, 63, 64, 0, 72, 100])) for _ in range(24)]
    got = df.select(*[compile_expr(e, [F.col("a"), F.col("b")], w).alias(f"c{i}") for i, (e, w) in enumerate(cases)]).collect()
    for r, inputs in zip(got, rows, strict=True):
        for x, (e, w) in zip(r, cases, strict=True):
            assert number(x) == bytecode.value(e, list(inputs)) % (1 << (w or 64)), (e, w, inputs)


def test_bad_bytecode():
    for bad in (b"\xff", b"\1\0\1\0", b"\4", b"", b"\2"):
        with pytest.raises(ValueError):
            bytecode.parse(bad)


def test_derived_over_derived(spark):
    a, b = [(0, 0), (10, 1), (30, 0)], [(0, 0), (20, 1)]
    changes = spark.createDataFrame([("t", 1, t, 0, v) for t, v in a] + [("t", 2, t, 0, v) for t, v in b], "trace string, var_id long, time long, block long, v_int long")
    d = [{"var_id": 100, "inputs": [1, 2], "bit_width": 1, "code": bytecode.compile_bytes(A & B)}, {"var_id": 101, "inputs": [100], "bit_width": 1, "code": bytecode.compile_bytes(A.lnot())}]
    got = sorted((r.var_id, r.time, r.v_int) for r in derived.read(changes, d, [100, 101]).collect())
    assert got == [(100, 0, 0), (100, 20, 1), (100, 30, 0), (101, 0, 1), (101, 20, 0), (101, 30, 1)]
    assert bytecode.evaluate(A & B, [a, b], 1) == [(0, 0), (20, 1), (30, 0)]
    with pytest.raises(ValueError):
        derived.read(changes, [d[0] | {"inputs": [101]}, d[1]], [101])


def test_null_values(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, None, "x"), (1, 3, None, "x"), (1, 4, "b", "x"), (1, 5, "b", "x")], "u long, t long, v string, _same string")
    assert [r.t for r in signals.change_only(rows, ["u"], ["t"], "v").orderBy("t").collect()] == [1, 2, 4]
    assert "_same" in signals.change_only(rows, ["u"], ["t"], "v").columns
    probes = spark.createDataFrame([(1, 0, 0), (1, 2, 0), (1, 9, 0)], "u long, t long, s long")
    found = signals.as_of(probes, rows.withColumn("s", F.lit(0).cast("long")), ["u"], "t", "s", "v", "v")
    assert [r.v for r in found.orderBy("t").collect()] == [None, None, "b"]
    assert signals.change_only(rows.limit(0), ["u"], ["t"], "v").count() == 0
    settled = signals.settle(rows, ["u"], "t", "v").first()
    assert (settled.v, settled.n) == ("b", 5)
    assert [(r.v, r.n) for r in signals.runs(rows, ["u"], ["t"], "v").orderBy("first").collect()] == [("a", 1), (None, 2), ("b", 2)]
    assert signals.time_range(rows, 2, 4, "t").count() == 3 and signals.time_range(rows, None, 4, "t").count() == 4


def test_capture_tasks(spark):
    changes = spark.createDataFrame([(1, t, t, t * 10) for t in range(1, 9)] + [(2, 2, 2, 7)], "var long, time long, seq long, value long")
    tasks = spark.createDataFrame([(3, "off"), (6, "on"), (7, "all")], "time long, task string")
    got = sorted(map(tuple, signals.controlled(changes, tasks, "var", "time", "seq", "value").collect()))
    assert got == sorted([(1, 1, 10), (1, 2, 20), (2, 2, 7), (1, 3, 30), (1, 6, 60), (2, 6, 7), (1, 7, 70), (1, 7, 70), (2, 7, 7), (1, 8, 80)])
    own = capture.options(["+capture_2state", "+capture_flush_interval=5", "+capture_compress=none", "+capture_signals=top.*,x", "+other=1", "+capture_scope_grouped"])
    assert own == {"two_state": True, "flush_interval": 5, "compress": None, "scope_grouped": True, "signals": "top.*,x"}


def test_states(spark):
    df = spark.createDataFrame([(0b0101, 0b0011, [1, 2])], "a long, b long, w array<int>")
    r = df.select(states.states(F.col("a"), F.col("b"), 4), states.states(F.col("a"), F.col("b"), 4, swapped=True), states.wide(F.col("w"), 40)).first()
    assert r[0] == "01ZX" and r[1] == "01XZ" and bytes(r[2]) == bytes([2, 0, 0, 0, 1])


def tree_by_stack(events):
    out, stack = [], []
    for t, enter in events:
        if enter:
            out.append([t, None, len(stack), stack[-1][0] if stack else None])
            stack.append(out[-1])
        elif stack:
            stack.pop()[1] = t
    return sorted(map(tuple, out), key=lambda r: r[0])


def test_call_tree(spark):
    rng = random.Random(2)
    events = {k: [(t, rng.random() < 0.5) for t in range(60)] for k in range(6)}
    df = spark.createDataFrame([(k, t, e) for k, own in events.items() for t, e in own], "k long, t long, is_enter boolean")
    got = calls.tree(df, ["k"], "t").collect()
    for k, own in events.items():
        assert sorted(((r.t, r["end"], r.depth, r.parent) for r in got if r.k == k), key=lambda r: r[0]) == tree_by_stack(own)


def test_ancestry_and_paths(spark):
    edges = [(i, i - 1 if i % 50 else None) for i in range(200)] + [(500, 499)]
    got = {r.id: (r.root, r.depth) for r in transactions.ancestry(spark.createDataFrame(edges, "id long, parent long")).collect()}
    assert got == {i: (i // 50 * 50, i % 50) for i in range(200)} | {500: (500, 0)}
    with pytest.raises(ValueError):
        transactions.ancestry(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))
    nodes = spark.createDataFrame([(1, None, "top"), (2, 1, "cpu"), (3, 2, "reg"), (4, 3, "[7]"), (9, 8, "lost")], "id long, parent long, name string")
    found = hierarchy.paths(nodes)
    assert {r.id: (r.path, r.depth) for r in found.collect()} == {1: ("top", 0), 2: ("top.cpu", 1), 3: ("top.cpu.reg", 2), 4: ("top.cpu.reg[7]", 3)}
    pick = lambda p: sorted(r.id for r in found.where(hierarchy.matches(F.col("path"), p)).collect())
    assert pick("top.c*") == [2, 3, 4] and pick("top.?pu,nothing") == [2] and pick("") == [1, 2, 3, 4] and pick("top.[!x]pu") == [2] and pick("t.p") == []
    with pytest.raises(ValueError):
        hierarchy.matches(F.col("path"), ",".join(f"p{i}" for i in range(65)))


def test_graph():
    for edges, cycle in (({1: [2], 2: [1]}, {1, 2}), ({1: [1]}, {1}), ({1: [2], 2: [3], 3: [1]}, {1, 2, 3})):
        found = graph.find_cycle(edges)
        assert found[0] == found[-1] and set(found) == cycle
        with pytest.raises(ValueError):
            graph.topo_order(edges)
    assert graph.find_cycle({3: [1, 2], 2: [1]}) is None
    assert graph.topo_order({3: [1, 2], 2: [1]}) == [1, 2, 3] and graph.finalize_order({3: [1, 2], 2: [1]}) == [3, 2, 1]
    long = {i: [i - 1] for i in range(1, 5000)}
    assert graph.topo_order(long) == list(range(5000))
    made = []
    m = graph.Materializer({3: [1, 2], 2: [1], 9: [9]}, lambda n, inputs: made.append(n) or n + sum(inputs))
    assert made == [] and m.get(3) == 3 + 1 + 3 and m.get(2) == 3 and made == [1, 2, 3]
    with pytest.raises(ValueError):
        m.get(9)


def test_sql_leaves_the_sessions_views(spark):
    from wavelake import catalogue

    spark.range(1).createOrReplaceTempView("events")
    assert catalogue.queries()["vc_block_index"](spark, "/root/testdata/sf0.001").count() > 0
    assert spark.table("events").columns == ["id"]
    spark.catalog.dropTempView("events")
