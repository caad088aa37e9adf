"""Queries over trace files: the driver's tables are written as traces, read back by the data source, and compared as rows.

Data tables go through distributed writes; descriptions (trees, types, metadata, blobs) are made on the driver from the
two tables of fixed size, region and nation.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions.expr import Input
from wavelake.operators import derived, transactions
from wavelake.session import shared_path, table
from wavelake.sources import codecs, trace
from wavelake.sources.calls import CallWriter
from wavelake.sources.writer import TraceWriter

#: Event time in ticks of a microsecond.
MICROS = "unix_micros(cast(ts as timestamp))"


def _written(df: DataFrame, name: str, order: list[str], **options) -> str:
    """A folder of trace files, each of one range of `order`."""
    path = shared_path(df.sparkSession, "trace")
    trace.register(df.sparkSession)
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.format("trace").mode("append").option("table", name)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save(path)
    return path


def _events(spark: SparkSession, sf_dir: str, *value, **options) -> str:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("var_id"), F.expr(MICROS).alias("time"), *value)
    return _written(e, "changes", ["time"], **options)


def trace_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, with waves compressed one by one."""
    path = _events(spark, sf_dir, F.col("value").alias("v_real"), compress_waves="zlib", compress_time_table="true", seekable="true")
    return trace.scan(spark, path).select("var_id", "time", "v_real")


def trace_read_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal between two inclusive times: other blocks and waves aren't decoded."""
    path = _events(spark, sf_dir, F.col("value").alias("v_real"), block_rows=500)
    return trace.scan(spark, path, var_id=7, start=1704412800000000, end=1705708800000000).select("time", "v_real")


def trace_whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-bit signals as runs of differences, blocks compressed whole."""
    path = _events(spark, sf_dir, F.floor(F.col("value") * 100).cast("long").alias("v_int"), F.lit(40).alias("bit_width"), compressor="zstd")
    return trace.scan(spark, path).select("var_id", "time", "v_int")


def trace_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _events(spark, sf_dir, F.col("event_type").alias("v_text"), compressor="zlib")
    return trace.scan(spark, path).select("var_id", "time", "v_text")


def trace_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-state values, with and without a number."""
    value = F.when(F.col("event_type") == "view", "01XZ").when(F.col("event_type") == "click", "0110").otherwise("ZZZ1")
    path = _events(spark, sf_dir, value.alias("v_states"), F.lit("4STATE").alias("encoding"), F.lit(4).alias("bit_width"))
    return trace.scan(spark, path).select("var_id", "time", "v_states")


def trace_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of 100 bits."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("var_id"), F.col("o_orderkey").alias("time"), F.unhex(F.lpad(F.hex("o_orderkey"), 26, "0")).alias("v_wide"), F.lit(100).alias("bit_width"))
    return trace.scan(spark, _written(o, "changes", ["time"])).select("var_id", "time", F.hex("v_wide").alias("v"))


def trace_byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the byte-plane codec."""
    path = _events(spark, sf_dir, F.col("value").alias("v_real"), codec="core.bytesplit", prefix="org.example")
    return trace.scan(spark, path).select("var_id", "time", "v_real")


def trace_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index knows of value-change blocks, undecoded: their times and codec, summed over the files."""
    path = _events(spark, sf_dir, F.col("value").alias("v_real"), block_rows=1000)
    b = trace.scan(spark, path, "blocks", kind="VC")
    return b.groupBy("codec", "available").agg(F.min("start_time").alias("first_time"), F.max("end_time").alias("last_time"))


def trace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace files as a stream."""
    from wavelake.streaming import capture

    path = _events(spark, sf_dir, F.col("value").alias("v_real"))
    trace.register(spark)
    rows = spark.readStream.format("trace").option("table", "changes").load(path)
    return capture.run_available(rows.select("var_id", "time", "v_real"), "append")


ATTRS = json.dumps({"1": [["status", "STRING"], ["price", "F64"], ["customer", "U64"]], "2": [["price", "F64"], ["customer", "U64"]]})


def _attr(i: int, kind: str, **value):
    kinds = {"v_int": "decimal(20,0)", "v_real": "double", "v_text": "string", "v_bytes": "binary", "bit_width": "int"}
    return F.struct(F.lit(i).alias("field_idx"), F.lit(kind).alias("field_type"), *[value.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").withColumn("at", at)


def _full(o: DataFrame, record: int, attrs: list) -> DataFrame:
    return o.select(F.lit("FULL").alias("tag"), F.col("o_custkey").alias("stream_inst_id"), F.lit(record).cast("long").alias("txn_type_id"), F.col("o_orderkey").alias("txn_id"), F.col("at").alias("start_time"), (F.col("at") + F.col("o_orderkey") % 1000).alias("end_time"), F.lit(0).cast("long").alias("parent_txn_id"), F.array(*attrs).alias("attrs"))


def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole transactions with attributes of their type, in rows."""
    price, customer = _attr(1, "F64", v_real=F.col("o_totalprice")), _attr(2, "U64", v_int=F.col("o_custkey"))
    path = _written(_full(_orders(spark, sf_dir), 1, [_attr(0, "STRING", v_text=F.col("o_orderstatus")), price, customer]), "records", ["start_time", "txn_id"], schemas=ATTRS, compressor="zlib")
    a = F.col("attrs")
    return trace.scan(spark, path, "records").select("txn_id", "stream_inst_id", "start_time", "end_time", a[0]["v_text"].alias("status"), a[1]["v_real"].alias("price"), a[2]["v_int"].cast("long").alias("customer"))


def trace_record_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in columns, which hold numbers only; read by stream."""
    path = _written(_full(_orders(spark, sf_dir), 2, [_attr(0, "F64", v_real=F.col("o_totalprice")), _attr(1, "U64", v_int=F.col("o_custkey"))]), "records", ["start_time", "txn_id"], schemas=ATTRS, column_layout="auto")
    r = trace.scan(spark, path, "records", stream_inst_id=7)
    return r.select("txn_id", "start_time", F.col("attrs")[0]["v_real"].alias("price"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as begins, with attributes, metadata and links in between; ends come from their last shipping, in other blocks."""
    o = _orders(spark, sf_dir)
    nil = lambda t: F.lit(None).cast(t)
    blank = {"stream_inst_id": "long", "txn_type_id": "long", "start_time": "long", "end_time": "long", "parent_txn_id": "long", "attrs": trace.SCHEMAS["records"].split("attrs ")[1].split(", link_type")[0], "link_type": "string", "target_txn_id": "long", "label": "string", "key": "string", "value": "string"}

    def rows(df: DataFrame, tag: str, when, rank: int, **given) -> DataFrame:
        return df.select(F.lit(tag).alias("tag"), F.col("o_orderkey").alias("txn_id"), *[given.get(k, nil(t)).cast(t).alias(k) for k, t in blank.items()], when.alias("_when"), F.lit(rank).alias("_rank"))

    at = F.col("at")
    begin = rows(o, "BEGIN", at, 0, stream_inst_id=F.col("o_custkey"), txn_type_id=F.lit(1), start_time=at, parent_txn_id=F.lit(0))
    attr = rows(o, "ATTR", at, 1, attrs=F.array(_attr(0, "STRING", v_text=F.lit("new")), _attr(0, "STRING", v_text=F.col("o_orderstatus"))))
    meta = rows(o, "META", at, 2, key=F.lit("priority"), value=F.col("o_orderpriority"))
    link = rows(o.where("o_orderkey % 3 = 0"), "LINK", at, 3, link_type=F.lit("CAUSE_EFFECT"), target_txn_id=F.col("o_orderkey") + 1, label=F.lit("next"))
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("at"))
    end = rows(ends, "END", F.col("at"), 4, end_time=F.col("at"))
    path = _written(begin.unionByName(attr).unionByName(meta).unionByName(link).unionByName(end), "records", ["_when", "txn_id", "_rank"], block_rows=5000)
    return trace.scan(spark, path, "records").withColumn("set", F.lit(1))


KEY = ("set",)  # the files of one set are one log


def txn_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.assembled(_ordered(_log(spark, sf_dir)), KEY).select("txn_id", "stream_inst_id", "start_time", "end_time", "duration", "n_attrs", "n_meta", "n_links")


def _ordered(records: DataFrame) -> DataFrame:
    """Blocks of a set counted through its files, which are in the order of their names."""
    return records.withColumn("block", F.regexp_extract("trace", "part-([0-9]+)", 1).cast("long") * (1 << 40) + F.col("block"))


def txn_last_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.last_attributes(_ordered(_log(spark, sf_dir)), KEY).select("txn_id", "field_idx", "v_text")


def txn_last_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.last_metadata(_ordered(_log(spark, sf_dir)), KEY).select("txn_id", "key", "value", "n")


def txn_resolved_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of one stream, also those that carry none."""
    r = transactions.with_streams(_ordered(_log(spark, sf_dir)), KEY).where("stream_inst_id = 7")
    return r.groupBy("tag").agg(F.count("*").alias("n"))


def txn_in_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of a stream that touch a span of time, open ones too."""
    r = transactions.in_stream(_ordered(_log(spark, sf_dir)), 7, 757382400000000, 883612800000000, KEY, overlapping=True)
    return r.select("txn_id", "start_time", "end_time")


def _described(spark: SparkSession, sf_dir: str) -> str:
    """One file of what region and nation describe."""
    import os

    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    folder = shared_path(spark, "trace")
    local = folder.removeprefix("file:")
    os.makedirs(local)
    codecs.register(codecs.Codec("own.gone", encode=codecs.encode_planes))
    try:
        with TraceWriter(f"{local}/described.trace", compressor="zlib", timescale_exp=-12, timezero=5) as w:
            bit, real = w.add_signal_type("2STATE", 1), w.add_signal_type("REAL", 64)
            colours = w.add_enum_type("region", [(r.r_regionkey - 2, r.r_name) for r in regions])
            record = w.add_txn_schema("nation", [("key", "U32"), ("region", "ENUM", "DEC", colours)])
            streams = {r.r_regionkey: w.add_stream_type(r.r_name, "even" if r.r_regionkey % 2 == 0 else "odd", record) for r in regions}
            for k, s in streams.items():
                if k:
                    w.declare_dependencies(s, [streams[k - 1]])
                w.add_stream_profile(s, f"own.profile.r{k}")
                w.add_stream_metadata(s, "key", k)
            with w.hierarchy(1, "DESIGN", "world") as tree:
                for r in regions:
                    tree.begin_scope(r.r_name, component="region")
                    for n in nations:
                        if n.n_regionkey == r.r_regionkey:
                            tree.add_var(n.n_name, bit if n.n_nationkey % 2 else real, "OUT")
                            tree.add_attr("key", n.n_nationkey, 2)
                    tree.add_stream(streams[r.r_regionkey], f"{r.r_name}_stream")
                    tree.end_scope()
            for n in nations:
                w.write_aux(n.n_regionkey, n.n_nationkey % 2, n.n_name.encode())
                w.write_ext(f"R{n.n_regionkey:03}".encode(), n.n_nationkey, n.n_name.encode())
                w.add_trace_metadata(f"r{n.n_regionkey}", n.n_name)
                w.add_trace_metadata("count", n.n_nationkey)
            with w.vc_block(0, "own.gone") as b:
                b.add_change(1, 0, 1.5)
            with w.vc_block(10) as b:
                b.set_initial(1, 2.5)
            calls = CallWriter(w, w.add_stream_type("calls"), w.add_stream_type("signatures"), [(1, "region", ["INT"]), (2, "nation", ["UINT", "STR"])])
            for r in regions:
                calls.enter(1, (r.r_regionkey - 2,), 100 * r.r_regionkey)
                for n in nations:
                    if n.n_regionkey == r.r_regionkey:
                        calls.enter(2, (n.n_nationkey, n.n_name), 100 * r.r_regionkey + n.n_nationkey)
                        calls.exit(n.n_nationkey * 3, 100 * r.r_regionkey + n.n_nationkey)
                if r.r_regionkey % 2:
                    calls.exit(None, 100 * r.r_regionkey + 90)
            calls.enter_raw(99, [42, -43], 20, 30)
            calls.close()
            a = w.add_derived_signal("both", Input(0) & Input(1), [1, 2], 16)
            w.add_derived_signal("none", Input(0).lnot(), [a], 1)
    finally:
        codecs.REGISTRY.pop("own.gone")
    return folder


def _table_of(name: str, columns: list, **equal) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return trace.scan(spark, _described(spark, sf_dir), name, **equal).selectExpr(*columns)

    return run


def trace_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each key of the whole trace, as JSON."""
    m = trace.scan(spark, _described(spark, sf_dir), "metadata").where("stream_type_id is null")
    return m.groupBy("key").agg(F.max_by("value", "pos").alias("value"))


def trace_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of each stream type; types without any have an empty list, and so no row."""
    m = trace.scan(spark, _described(spark, sf_dir), "metadata").where("stream_type_id is not null and key rlike '(^|[.])profile$'")
    return m.select("stream_type_id", F.explode(F.from_json("value", "array<string>")).alias("profile"))


def trace_enum_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with the label that the file's enumeration gives their region's number."""
    e = trace.scan(spark, _described(spark, sf_dir), "enum_values")
    n = table(spark, sf_dir, "nation")
    return n.join(F.broadcast(e), n["n_regionkey"] - 2 == e["value"], "left").select("n_name", "label")


def missing_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = trace.scan(spark, _described(spark, sf_dir), "blocks", kind="VC")
    return b.where("not available").select("codec").distinct()


def dep_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream type's level: the longest way down through what it depends on."""
    from wavelake.plans.graph import topo_order

    d = trace.scan(spark, _described(spark, sf_dir), "stream_deps").collect()  # as many as there are stream types
    edges: dict[int, list[int]] = {}
    for r in d:
        edges.setdefault(r.stream_type_id, []).append(r.input_id)
    level: dict[int, int] = {}
    for n in topo_order(edges):
        level[n] = max((level[x] + 1 for x in edges.get(n, ())), default=0)
    return spark.createDataFrame(sorted(level.items()), "node long, lvl long")


def trace_call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavelake.operators import calls

    e = trace.scan(spark, _described(spark, sf_dir), "call_events")
    t = calls.tree(e, ["trace", "call_stream"], "seq", results=("time", "ret"))
    return t.select("name", "args", "time", "depth", F.col("end_time").alias("end_time"), F.col("end_ret").alias("ret"))


def trace_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived signal over a derived one, by the file's definitions, for each user: inputs are views and purchases in cents."""
    d = trace.scan(spark, _described(spark, sf_dir), "derived").collect()
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    changes = e.select("user_id", F.when(F.col("event_type") == "view", 1).otherwise(2).cast("long").alias("var_id"), F.expr(MICROS).alias("time"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 100).cast("long").alias("v_int"))
    names = {x["name"]: x["var_id"] for x in d}
    got = derived.read(changes, d, [names["both"], names["none"]], ("user_id",), "seq")
    return got.select("user_id", (F.col("var_id") == names["none"]).alias("is_none"), "time", "v_int")


EVENTS = 'select user_id var_id, epoch_us(ts) "time"'
_PAIR = "with x as (select *, cast(floor(value * 100) as bigint) v from events where event_type in ('view', 'purchase')), y as (select user_id, ts, event_id, coalesce(last_value(case when event_type = 'view' then v end ignore nulls) over w, 0) & coalesce(last_value(case when event_type = 'purchase' then v end ignore nulls) over w, 0) & 65535 v from x window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)), b as (select * from (select *, lag(v) over (partition by user_id order by ts, event_id) p from y) z where p is null or p <> v)"
_LAST = "(select l_orderkey, max(epoch_us(l_shipdate)) e from lineitem group by l_orderkey)"
#: name: (query, the same in SQL)
QUERIES: dict[str, tuple[Callable, str | None]] = {
    "trace_changes": (trace_changes, f"{EVENTS}, value v_real from events"),
    "trace_read_signal": (trace_read_signal, 'select epoch_us(ts) "time", value v_real from events where user_id = 7 and epoch_us(ts) between 1704412800000000 and 1705708800000000'),
    "trace_whole_numbers": (trace_whole_numbers, f"{EVENTS}, cast(floor(value * 100) as bigint) v_int from events"),
    "trace_texts": (trace_texts, f"{EVENTS}, event_type v_text from events"),
    "trace_states": (trace_states, f"{EVENTS}, case event_type when 'view' then '01XZ' when 'click' then '0110' else 'ZZZ1' end v_states from events"),
    "trace_wide": (trace_wide, 'select o_custkey var_id, o_orderkey "time", lpad(to_hex(o_orderkey), 26, \'0\') v from orders'),
    "trace_byte_planes": (trace_byte_planes, f"{EVENTS}, value v_real from events"),
    "trace_blocks": (trace_blocks, "select 'core.valuechange' codec, true available, min(epoch_us(ts)) first_time, max(epoch_us(ts)) last_time from events"),
    "trace_stream": (trace_stream, f"{EVENTS}, value v_real from events"),
    "trace_records": (trace_records, "select o_orderkey txn_id, o_custkey stream_inst_id, epoch_us(o_orderdate) start_time, epoch_us(o_orderdate) + o_orderkey % 1000 end_time, o_orderstatus status, o_totalprice price, o_custkey customer from orders"),
    "trace_record_columns": (trace_record_columns, "select o_orderkey txn_id, epoch_us(o_orderdate) start_time, o_totalprice price from orders where o_custkey = 7"),
    "txn_assembled": (txn_assembled, f"select o_orderkey txn_id, o_custkey stream_inst_id, epoch_us(o_orderdate) start_time, e end_time, e - epoch_us(o_orderdate) duration, 2::bigint n_attrs, 1::bigint n_meta, (case when o_orderkey % 3 = 0 then 1 else 0 end)::bigint n_links from orders left join {_LAST} l on o_orderkey = l_orderkey"),
    "txn_last_attributes": (txn_last_attributes, "select o_orderkey txn_id, 0::integer field_idx, o_orderstatus v_text from orders"),
    "txn_last_metadata": (txn_last_metadata, "select o_orderkey txn_id, 'priority' \"key\", o_orderpriority \"value\", 1::bigint n from orders"),
    "txn_resolved_stream": (txn_resolved_stream, f"with o as (select * from orders where o_custkey = 7) select * from (select 'BEGIN' tag, count(*) n from o union all select 'ATTR', count(*) from o union all select 'META', count(*) from o union all select 'LINK', count(*) from o where o_orderkey % 3 = 0 union all select 'END', count(*) from o join {_LAST} l on o_orderkey = l_orderkey) x where n > 0"),
    "txn_in_stream": (txn_in_stream, f"select o_orderkey txn_id, epoch_us(o_orderdate) start_time, e end_time from orders left join {_LAST} l on o_orderkey = l_orderkey where o_custkey = 7 and epoch_us(o_orderdate) <= 883612800000000 and (e is null or e >= 757382400000000)"),
    "trace_header": (_table_of("traces", ["version_major", "version_minor", "timescale_exp", "timezero"]), "select 2::integer version_major, 1::integer version_minor, -12::integer timescale_exp, 5::bigint timezero"),
    "trace_nodes": (
        _table_of("nodes", ["node", "path", "id"]),
        "select 'scope' node, r_name path, cast(null as bigint) id from region union all select 'var', concat(r_name, '.', n_name), row_number() over (order by n_regionkey, n_nationkey) from nation join region on n_regionkey = r_regionkey union all select 'stream', concat(r_name, '.', r_name, '_stream'), row_number() over (order by r_regionkey) from region",
    ),
    "trace_node_attrs": (_table_of("node_attrs", ["key", "type", "value"]), "select 'key' \"key\", 'u64' \"type\", cast(n_nationkey as varchar) \"value\" from nation"),
    "trace_signal_types": (_table_of("signal_types", ["sig_type_id", "encoding", "bit_width", "radix"]), "select * from (values (1::bigint, '2STATE', 1::integer, 'HEX'), (2::bigint, 'REAL', 64::integer, 'HEX')) t(sig_type_id, encoding, bit_width, radix)"),
    "trace_strings": (lambda spark, sf_dir: _table_of("strings", ["s"])(spark, sf_dir).where("s rlike '^NATION_[0-9]+$'"), "select distinct n_name s from nation"),
    "trace_txn_fields": (_table_of("txn_fields", ["type_name", "field_idx", "field_name", "field_type"]), "select * from (values ('nation', 0::integer, 'key', 'U32'), ('nation', 1::integer, 'region', 'ENUM')) t(type_name, field_idx, field_name, field_type)"),
    "trace_stream_kinds": (lambda spark, sf_dir: _table_of("stream_types", ["name", "kind"])(spark, sf_dir).where("kind = 'even'"), "select r_name \"name\", 'even' kind from region where r_regionkey % 2 = 0"),
    "trace_metadata": (trace_metadata, "select concat('r', n_regionkey) \"key\", concat('\"', arg_max(n_name, n_nationkey), '\"') \"value\" from nation group by n_regionkey union all select 'count', cast(max(n_nationkey) as varchar) from nation"),
    "trace_profiles": (trace_profiles, "select cast(r_regionkey + 1 as bigint) stream_type_id, concat('own.profile.r', r_regionkey) profile from region"),
    "trace_aux": (
        lambda spark, sf_dir: _table_of("aux", ["owner", "key", "ordinal", "cast(payload as string) payload"])(spark, sf_dir).where("owner < 5"),
        "select cast(n_regionkey as bigint) owner, cast(n_nationkey % 2 as bigint) \"key\", row_number() over (partition by n_regionkey, n_nationkey % 2 order by n_nationkey) - 1 ordinal, n_name payload from nation",
    ),
    "trace_aux_read": (_table_of("aux", ["ordinal", "cast(payload as string) payload"], owner=3, key=1), "select row_number() over (order by n_nationkey) - 1 ordinal, n_name payload from nation where n_regionkey = 3 and n_nationkey % 2 = 1"),
    "trace_ext": (_table_of("ext", ["ext_version", "cast(payload as string) payload"], ext_type="R002"), "select n_nationkey ext_version, n_name payload from nation where n_regionkey = 2"),
    "trace_initial": (_table_of("changes", ["var_id", "time", "initial", "v_real"], start=0), "select 1::bigint var_id, 10::bigint \"time\", true initial, 2.5::double v_real"),
    "trace_enum_labels": (trace_enum_labels, "select n_name, r_name label from nation join region on n_regionkey = r_regionkey"),
    "missing_codecs": (missing_codecs, "select 'own.gone' codec"),
    "dep_levels": (dep_levels, "select cast(r_regionkey + 1 as bigint) node, cast(r_regionkey as bigint) lvl from region union all select 6, 1 union all select 7, 0"),
    "trace_signatures": (_table_of("signatures", ["func_id", "name", "array_join(arg_types, ',') args"]), "select * from (values (1::bigint, 'region', 'INT'), (2::bigint, 'nation', 'UINT,STR')) t(func_id, \"name\", args)"),
    "trace_call_tree": (
        trace_call_tree,
        # even regions stay open, so the next region's call is one deeper, and an odd region's exit closes its own call
        "select 'region' \"name\", concat('[', r_regionkey - 2, ']') args, cast(100 * r_regionkey as bigint) \"time\", cast((r_regionkey + 1) // 2 as bigint) depth, case when r_regionkey % 2 = 1 then cast(100 * r_regionkey + 90 as bigint) end end_time, cast(null as bigint) ret from region union all select 'nation', concat('[', n_nationkey, ', \"', n_name, '\"]'), 100 * n_regionkey + n_nationkey, (n_regionkey + 1) // 2 + 1, 100 * n_regionkey + n_nationkey, n_nationkey * 3 from nation",
    ),
    "trace_call_fallback": (lambda spark, sf_dir: trace.scan(spark, _described(spark, sf_dir), "records").groupBy("txn_id").agg(F.max("txn_type_id").alias("func_id"), F.max("end_time").alias("end_time"), F.max(F.expr("cast(get(attrs, 1).v_int as bigint)")).alias("second")), "select 0::bigint txn_id, 99::bigint func_id, 30::bigint end_time, -43::bigint \"second\""),
    "trace_derived": (trace_derived, f"{_PAIR} select user_id, false is_none, epoch_us(ts) \"time\", v v_int from b union all select user_id, true, epoch_us(ts), n from (select user_id, ts, n, lag(n) over (partition by user_id order by ts, event_id) q from (select *, (v = 0)::bigint n from b) c) d where q is null or q <> n"),
}
