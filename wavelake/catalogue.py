"""Every registered query of the trace engine with its SQL twin for another engine.

The driver's tables stand in for traces: `events` are value changes of one signal per user, `orders` and `lineitem`
transactions, `region`..`supplier` a hierarchy, `conversations` calls. A query is Spark SQL or a plan built from the
operators; where one text serves both engines it is given once.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelake import traces
from wavelake.functions import states
from wavelake.functions.expr import Const, Expr, Input, compile_expr
from wavelake.operators import calls, hierarchy, planes, signals, transactions
from wavelake.operators.numbering import numbered
from wavelake.session import table
from wavelake.streaming import capture

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()
W = "partition by user_id order by ts, event_id"

#: name: (SQL for Spark, SQL for the other engine or None if the same text serves)
SQL: dict[str, tuple[str, str | None]] = {}


def both(name: str, text: str, other: str | None = None) -> None:
    SQL[name] = (text, other)


# --- scans, ranges and blocks
both("vc_scan_range", "select count(*) n, min(event_id) first_id from events where ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-10 00:00:00'")
both("vc_block_index", "select date_trunc('hour', ts) block, min(ts) start_ts, max(ts) end_ts, count(*) n, count(distinct user_id) n_vars from events group by date_trunc('hour', ts)")
both("vc_seek_block", "select min(block) block from (select date_trunc('hour', ts) block, min(ts) s from events group by date_trunc('hour', ts)) b where s >= timestamp '2024-01-03 00:30:00'")
# --- change-only, forward fill, settle, snapshot, pause
both(
    "vc_ffill_two_inputs",
    f"select event_id, coalesce(last(case when event_type = 'view' then value end, true) over ({W} rows between unbounded preceding and current row), 0.0) a, coalesce(last(case when event_type = 'purchase' then value end, true) over ({W} rows between unbounded preceding and current row), 0.0) b from events",
    f"select event_id, coalesce(last_value(case when event_type = 'view' then value end ignore nulls) over ({W} rows between unbounded preceding and current row), 0.0) a, coalesce(last_value(case when event_type = 'purchase' then value end ignore nulls) over ({W} rows between unbounded preceding and current row), 0.0) b from events",
)
both(
    "vc_settle",
    "select user_id, date_trunc('hour', ts) h, max_by(value, event_id) value, count(*) n from events group by user_id, date_trunc('hour', ts)",
    "select user_id, date_trunc('hour', ts) h, arg_max(value, event_id) \"value\", count(*) n from events group by user_id, date_trunc('hour', ts)",
)
both("vc_rle_runs", f"select user_id, event_type, run, count(*) n, min(event_id) first_id from (select *, row_number() over ({W}) - row_number() over (partition by user_id, event_type order by ts, event_id) run from events) x group by user_id, event_type, run")
both(
    "vc_xor_delta",
    f"select event_id, v ^ coalesce(lag(v) over ({W}), 0) d from (select *, cast(floor(value * 100) as bigint) v from events) x",
    f"select event_id, xor(v, coalesce(lag(v) over ({W}), 0)) d from (select *, cast(floor(value * 100) as bigint) v from events) x",
)
both(
    "vc_xor_decode",
    f"select event_id, bit_xor(d) over ({W} rows between unbounded preceding and current row) v from (select event_id, user_id, ts, v ^ coalesce(lag(v) over ({W}), 0) d from (select *, cast(floor(value * 100) as bigint) v from events) x) y",
    "select event_id, cast(floor(value * 100) as bigint) v from events",
)
# a signal's wave is the hash of its days' hashes, so that no row gathers a whole signal
both(
    "vc_wave_dedup",
    "select wave, count(*) n, min(user_id) first_user from (select user_id, md5(array_join(transform(array_sort(collect_list(struct(d, h))), x -> x.h), ',')) wave from (select user_id, date_trunc('day', ts) d, md5(array_join(transform(array_sort(collect_list(struct(ts, event_id, event_type))), x -> x.event_type), ',')) h from events group by user_id, date_trunc('day', ts)) y group by user_id) x group by wave",
    "select wave, count(*) n, min(user_id) first_user from (select user_id, md5(string_agg(h, ',' order by d)) wave from (select user_id, date_trunc('day', ts) d, md5(string_agg(event_type, ',' order by ts, event_id)) h from events group by user_id, date_trunc('day', ts)) y group by user_id) x group by wave",
)
both("vc_dump_limit", "select event_id from (select event_id, 16 * row_number() over (partition by date_trunc('hour', ts) order by ts, event_id) used from events) x where used <= 48")
both("vc_scope_blocks", "select c_nationkey scope_id, count(*) n, min(ts) start_ts, max(ts) end_ts, count(distinct user_id) n_vars from events join customer on user_id = c_custkey group by c_nationkey")
both("vc_last_before_block", "select h, user_id, event_id from (select date_trunc('hour', ts) h, user_id, event_id, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts desc, event_id desc) k from events) x where k = 1")
both(
    "vc_time_table",
    "select h, t, t - coalesce(lag(t) over (partition by h order by t), t) d from (select distinct date_trunc('hour', ts) h, unix_micros(cast(ts as timestamp)) t from events) x",
    "select h, t, t - coalesce(lag(t) over (partition by h order by t), t) d from (select distinct date_trunc('hour', ts) h, epoch_us(ts) t from events) x",
)
both("vc_radix_labels", "select event_id, lower(hex(event_id)) hex, bin(event_id) bits from events", "select event_id, lower(to_hex(event_id)) hex, to_binary(event_id) bits from events")
both("signal_type_dedup", "select distinct p_type encoding, p_size bit_width from part")
# --- transactions
both("txn_overlap", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem join orders on l_orderkey = o_orderkey where o_orderdate <= timestamp '1995-03-31 00:00:00' and l_shipdate >= timestamp '1995-03-01 00:00:00' and l_shipdate >= o_orderdate")
both("txn_stream_compat", "select o_orderkey txn_id from orders where o_custkey = 7 or o_custkey is null")
both("txn_attr_sequence", "select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 pos from events")
both("txn_to_tagged_records", "select o_orderkey txn_id, 'BEGIN' tag, o_orderdate t from orders union all select l_orderkey, 'END', max(l_shipdate) from lineitem group by l_orderkey")
both("txn_full", "select o_orderkey txn_id, o_custkey stream_id, o_orderdate start_time, o_orderstatus status from orders")
both("txn_stream_filter", "select o.o_orderkey txn_id, c.c_name stream_name from orders o join customer c on o.o_custkey = c.c_custkey where c.c_mktsegment = 'BUILDING' and c.c_nationkey < 5")
both("txn_stream_range", "select o_orderkey txn_id from orders where o_custkey = 7 and o_orderdate between timestamp '1993-01-01' and timestamp '1997-12-31'")
both("txn_begin_end_pair", f"select b event_id, e end_id from (select event_type t, event_id b, lead(event_type) over ({W}) nt, lead(event_id) over ({W}) e from events where event_type in ('view', 'purchase')) x where t = 'view' and nt = 'purchase'")
both("txn_open", "select o_orderkey txn_id from orders left anti join lineitem on o_orderkey = l_orderkey", "select o_orderkey txn_id from orders where o_orderkey not in (select l_orderkey from lineitem)")
both(
    "txn_attr_last_wins",
    "select user_id, event_type, max_by(get_json_object(props, '$.k'), struct(ts, event_id)) v from events group by user_id, event_type",
    "select user_id, event_type, arg_max(json_extract_string(props, '$.k'), event_id) v from events group by user_id, event_type",
)
both(
    "txn_meta_map",
    "select user_id, event_type k, max_by(value, event_id) v, count(*) n from events group by user_id, event_type",
    "select user_id, event_type k, arg_max(value, event_id) v, count(*) n from events group by user_id, event_type",
)
both("txn_json_attr", "select event_id, cast(get_json_object(props, '$.k') as bigint) k from events", "select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
both(
    "txn_parent_join",
    "select l_orderkey, l_linenumber, o_custkey, cast(datediff(l_shipdate, o_orderdate) as bigint) n_days from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate",
    "select l_orderkey, l_linenumber, o_custkey, cast(date_diff('day', o_orderdate, l_shipdate) as bigint) n_days from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate",
)
both("txn_links", "select a.o_orderkey src, b.o_orderkey dst from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderdate = b.o_orderdate and a.o_orderkey < b.o_orderkey")
both(
    "txn_delta",
    "select o_orderkey, o_orderkey - coalesce(lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey), 0) d_id, unix_micros(cast(o_orderdate as timestamp)) - coalesce(lag(unix_micros(cast(o_orderdate as timestamp))) over (partition by o_custkey order by o_orderdate, o_orderkey), 0) d_time from orders",
    "select o_orderkey, o_orderkey - coalesce(lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey), 0) d_id, epoch_us(o_orderdate) - coalesce(lag(epoch_us(o_orderdate)) over (partition by o_custkey order by o_orderdate, o_orderkey), 0) d_time from orders",
)
ANCESTRY = "with recursive p as (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) parent from orders), t(id, depth) as (select o_orderkey, 0 from p where parent is null union all select p.o_orderkey, t.depth + 1 from p join t on p.parent = t.id) select id, depth from t"
# --- calls
DEPTH = "select conv_id, turn, e, s - least(0, min(s) over (partition by conv_id order by turn rows between unbounded preceding and current row)) - case when e = 1 then 1 else 0 end depth from (select conv_id, turn, e, sum(e) over (partition by conv_id order by turn rows between unbounded preceding and current row) s from (select conv_id, turn, case when role = 'user' then 1 else -1 end e from conversations where role in ('user', 'assistant')) a) b"
# --- hierarchy
PATHS = "with recursive nodes as (select concat('r', cast(r_regionkey as varchar(20))) id, cast(null as varchar(20)) parent, r_name name from region union all select concat('n', cast(n_nationkey as varchar(20))), concat('r', cast(n_regionkey as varchar(20))), n_name from nation union all select concat('s', cast(s_suppkey as varchar(20))), concat('n', cast(s_nationkey as varchar(20))), s_name from supplier), t(id, path, depth) as (select id, name, 0 from nodes where parent is null union all select n.id, concat(t.path, '.', n.name), t.depth + 1 from nodes n join t on n.parent = t.id)"
both("hier_children", f"{PATHS} select n.parent, count(*) n_children from nodes n join t on n.parent = t.id group by n.parent")
both("aux_read", "select doc_id, row_number() over (partition by source, lang order by doc_id) - 1 ordinal from (select doc_id, source, lang from documents where source = (select min(source) from documents) and lang = (select min(lang) from documents)) x")
both("string_lookup", "select n_nationkey str_id, n_name s, count(c_custkey) n from nation left join customer on n_nationkey = c_nationkey group by n_nationkey, n_name")
# --- dictionaries, streams, codecs, blobs, graphs
both("stream_by_kind", "select c_custkey stream_id, c_name name from customer where c_mktsegment = 'BUILDING'")
both("aux_keys_first_seen", "select source, lang, min(doc_id) pos from documents group by source, lang")
both("metadata_last_wins", "select source k, max_by(lang, doc_id) v from documents group by source", "select source k, arg_max(lang, doc_id) v from documents group by source")
both("block_overlap", "select count(*) n from (select date_trunc('hour', ts) b, min(ts) s, max(ts) e from events group by date_trunc('hour', ts)) x where e >= timestamp '2024-01-02 00:00:00' and s <= timestamp '2024-01-03 00:00:00'")
# --- extensions: categories that a trace store has no operator for, added for analysis
both("tumbling_counts", "select window.start h, count(*) n, count(distinct user_id) users from events group by window(ts, '1 hour')", "select time_bucket(interval '1 hour', ts) h, count(*) n, count(distinct user_id) users from events group by 1")
both(
    "sliding_counts",
    "select window.start h, count(*) n from events group by window(ts, '1 hour', '30 minutes')",
    "select h, count(*) n from (select time_bucket(interval '30 minutes', ts) h from events union all select time_bucket(interval '30 minutes', ts) - interval '30 minutes' from events) x group by h",
)
both("session_windows", f"select user_id, session, min(ts) s, max(ts) e, count(*) n from (select *, sum(fresh) over ({W} rows between unbounded preceding and current row) session from (select *, case when lag(ts) over ({W}) is null or ts > lag(ts) over ({W}) + interval '30' minute then 1 else 0 end fresh from events) x) y group by user_id, session")
both("rollup_by_scope", "select r_name, n_name, count(*) n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup(r_name, n_name)")

# --- derived signals: a = scaled value of views, b = of purchases, per user
A, B = Input(0), Input(1)
#: name: (expression, width, the same in the other engine over a and b)
DERIVED: dict[str, tuple[Expr, int, str]] = {
    "drv_and": (A & B, 16, "a & b"),
    "drv_or": (A | B, 16, "a | b"),
    "drv_xor": (A ^ B, 16, "xor(a, b)"),
    "drv_not": (~A, 16, "65535 - a % 65536"),
    "drv_shl": (A.shl(3), 16, "a * 8"),
    "drv_shr": (A.shr(2), 16, "a >> 2"),
    "drv_lnot": (A.lnot(), 1, "(a = 0)::bigint"),
    "drv_eq": (A.eq(B), 1, "(a = b)::bigint"),
    "drv_ne": (A.ne(B), 1, "(a <> b)::bigint"),
    "drv_red_and": (A.reduce_and(3), 1, "((a & 7) = 7)::bigint"),
    "drv_red_or": (A.reduce_or(3), 1, "((a & 7) <> 0)::bigint"),
    "drv_slice": (A.slice_(2, 3), 3, "(a >> 2) & 7"),
    "drv_concat": (A.concat(B, 4), 16, "(a * 16) | (b & 15)"),
    "drv_const": (A & Const(0x0F), 8, "a & 15"),
    "drv_alias": (A, 16, "a"),
    "drv_chain": ((A & B).lnot(), 1, "((a & b) = 0)::bigint"),
}


def _derived(name: str) -> Callable[[SparkSession, str], DataFrame]:
    expr, width, _ = DERIVED[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.floor(F.col("value") * 100).cast("long")
        inputs = [(F.col("event_type") == "view", v), (F.col("event_type") == "purchase", v)]
        result = compile_expr(expr, [F.col("in0"), F.col("in1")], width, [31, 31])  # cents fit into 31 bits
        return signals.derived(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", inputs, result)

    return run


def _derived_sql(name: str) -> str:
    _, width, text = DERIVED[name]
    pick = lambda t: f"coalesce(last_value(case when event_type = '{t}' then cast(floor(value * 100) as bigint) end ignore nulls) over ({W} rows between unbounded preceding and current row), 0)"
    return f"select user_id, ts, v from (select *, lag(v) over ({W}) p from (select user_id, ts, event_id, ({text}) & {(1 << width) - 1} v from (select *, {pick('view')} a, {pick('purchase')} b from events) x) y) z where p is null or p <> v"


def vc_change_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from their user's one before."""
    return signals.change_only(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


def vc_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one signal between two inclusive times, in order."""
    e = signals.time_range(table(spark, sf_dir, "events"), F.expr("timestamp_ntz '2024-01-05 00:00:00'"), F.expr("timestamp_ntz '2024-01-20 00:00:00'"), "ts")
    return e.where("user_id = 7").select("event_id", "ts", "value")


def txn_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders of the same customer came before each, by following each order's predecessor."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("parent"))
    return transactions.ancestry(edges).select("id", "depth")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    return c.select("conv_id", "turn", (F.col("role") == "user").alias("is_enter"))


def call_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as calls (user) and returns (assistant), with their depth."""
    return calls.depths(_turns(spark, sf_dir), ["conv_id"], ["turn"]).select("conv_id", "turn", F.when(F.col("is_enter"), 1).otherwise(-1).alias("is_enter"), "depth")


def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call with its return, null while open, its depth and its parent."""
    t = calls.tree(_turns(spark, sf_dir), ["conv_id"], "turn")
    return t.select("conv_id", F.col("turn").alias("start_turn"), F.col("end").alias("end_turn"), "depth", F.col("parent").alias("parent_turn"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    top = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    mid = table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")
    return top.union(mid).union(table(spark, sf_dir, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey"), "s_name")).union(table(spark, sf_dir, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), "c_name"))


def hier_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and depths of regions, nations, suppliers and customers."""
    return hierarchy.paths(_nodes(spark, sf_dir)).select("id", "path", "depth")


def hier_depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hier_paths(spark, sf_dir).where("depth < 2")


def hier_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose path fits one of two shell patterns."""
    p = hier_paths(spark, sf_dir)
    return p.where(hierarchy.matches(F.col("path"), "ASIA.*,EUROPE.G*.Supplier?0000000[1-9]*")).select("id", "path")


def state_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two planes of bits as states, and the number where they have one."""
    s = states.states(F.col("event_id"), F.col("event_id").bitwiseAND(F.col("user_id")), 8)
    return table(spark, sf_dir, "events").select("event_id", s.alias("states"), states.number(s).alias("number"))


def capture_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a capture writes them that is switched off and on again, and asked for all values once."""
    stamp = lambda t: datetime.datetime.fromisoformat(t)
    tasks = spark.createDataFrame([(stamp("2024-01-08 00:00:00"), "off"), (stamp("2024-01-12 00:00:00"), "on"), (stamp("2024-01-20 00:00:00"), "all")], "ts timestamp_ntz, task string")
    return signals.controlled(table(spark, sf_dir, "events"), tasks, "user_id", "ts", "event_id", "value")


def vc_value_at_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the latest view at or before each purchase."""
    e = table(spark, sf_dir, "events")
    probes = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = e.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    return signals.as_of(probes, views, ["user_id"], "ts", "event_id", "value", "view_value").where("view_value is not null").select("event_id", "view_value")


def vc_snapshot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's value at one time."""
    return signals.snapshot(table(spark, sf_dir, "events"), ["user_id"], F.expr("timestamp_ntz '2024-01-20 00:00:00'"), "ts", "event_id", "value").select("user_id", "value", "ts")


def vc_pause_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes outside the span between their user's first and last error."""
    e = table(spark, sf_dir, "events")
    spans = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return signals.pause_windows(e, spans, ["user_id"], "ts").select("event_id", "user_id")


def vc_flush_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 1,000 changes in order of time."""
    rows = numbered(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"])
    return rows.groupBy(F.expr("(rn - 1) div 1000").alias("block")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def intern_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of strings by first occurrence."""
    first = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("s")).agg(F.min("event_id").alias("pos"))
    return numbered(first, ["pos"], "str_id").select("s", "str_id")


def aux_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals from 0 within each owner: places in the whole table less that of the owner's first row, so that a large owner isn't one task."""
    rows = numbered(table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), "doc_id"), ["owner", "doc_id"])
    first = rows.groupBy(F.col("owner").alias("o")).agg(F.min("rn").alias("lo"))
    return rows.join(first, F.col("owner").eqNullSafe(F.col("o"))).select("owner", "doc_id", (F.col("rn") - F.col("lo")).alias("ordinal"))


def byte_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's four byte planes, in hexadecimal."""
    return planes.split(table(spark, sf_dir, "embeddings"), "embedding", keys=("vec_id",)).select("vec_id", F.hex("planes").alias("planes"))


def stream_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vc_settle, from a stream."""
    settled = capture.run_available(capture.settle(capture.changes(spark, sf_dir), ["user_id"], late=None), "update", ["user_id", "h"])
    return settled.withColumn("h", F.col("h").cast("timestamp_ntz"))


def stream_begin_end_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn_begin_end_pair, from a stream."""
    return capture.run_available(capture.pairs(capture.changes(spark, sf_dir), "view", "purchase"), "append")


LEVELS = "with recursive nodes as (select concat('r', r_regionkey) id, cast(null as varchar) parent, r_name name from region union all select concat('n', n_nationkey), concat('r', n_regionkey), n_name from nation union all select concat('s', s_suppkey), concat('n', s_nationkey), s_name from supplier union all select concat('c', c_custkey), concat('n', c_nationkey), c_name from customer), t(id, path, depth) as (select id, name, 0 from nodes where parent is null union all select n.id, concat(t.path, '.', n.name), t.depth + 1 from nodes n join t on n.parent = t.id)"
PLANS: dict[str, tuple[Callable, str | None]] = {
    "vc_change_only": (vc_change_only, f"select user_id, event_id, event_type from (select *, lag(event_type) over ({W}) p, row_number() over ({W}) k from events) x where k = 1 or p is distinct from event_type"),
    "vc_time_range": (vc_time_range, "select event_id, ts, value from events where user_id = 7 and ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 00:00:00'"),
    "txn_ancestry": (txn_ancestry, ANCESTRY.replace(", 0 from p", ", 0::bigint from p")),
    "call_depth": (call_depth, f"select conv_id, turn, e is_enter, cast(depth as bigint) depth from ({DEPTH}) d"),
    "call_tree": (call_tree, f"with d as (select conv_id, turn, e, cast(depth as bigint) depth from ({DEPTH}) q) select x.conv_id, x.turn start_turn, case when ne = -1 then nt end end_turn, depth, (select max(y.turn) from d y where y.conv_id = x.conv_id and y.e = 1 and y.depth = x.depth - 1 and y.turn < x.turn) parent_turn from (select *, lead(e) over (partition by conv_id, depth order by turn) ne, lead(turn) over (partition by conv_id, depth order by turn) nt from d) x where e = 1"),
    "hier_paths": (hier_paths, f"{LEVELS} select id, path, depth from t"),
    "hier_depth_limit": (hier_depth_limit, f"{LEVELS} select id, path, depth from t where depth < 2"),
    "hier_glob_filter": (hier_glob_filter, f"{LEVELS} select id, path from t where path glob 'ASIA.*' or path glob 'EUROPE.G*.Supplier?0000000[1-9]*'"),
    "state_packing": (
        state_packing,
        "select event_id, s states, case when regexp_matches(s, '^[01]+$') then list_sum(list_transform(range(8), lambda i: (case when s[8 - i] = '1' then 1 else 0 end) << i))::bigint end \"number\" from (select event_id, array_to_string(list_transform(range(7, -1, -1), lambda i: case when ((event_id & user_id) >> i) & 1 = 0 then (case when (event_id >> i) & 1 = 1 then '1' else '0' end) when (event_id >> i) & 1 = 1 then 'X' else 'Z' end), '') s from events) x",
    ),
    "capture_controlled": (
        capture_controlled,
        "select user_id, ts, value from events where not (ts > timestamp '2024-01-08' and ts <= timestamp '2024-01-12') union all select user_id, timestamp '2024-01-12', arg_max(value, event_id) from events where ts <= timestamp '2024-01-12' group by user_id union all select user_id, timestamp '2024-01-20', arg_max(value, event_id) from events where ts <= timestamp '2024-01-20' group by user_id",
    ),
    "vc_flush_blocks": (vc_flush_blocks, "select block, count(*) n, min(event_id) first_id, max(event_id) last_id from (select event_id, cast(floor((row_number() over (order by ts, event_id) - 1) / 1000) as bigint) block from events) x group by block"),
    "intern_dictionary": (intern_dictionary, "select s, row_number() over (order by pos) str_id from (select event_type s, min(event_id) pos from events group by event_type) x"),
    "aux_ordinals": (aux_ordinals, "select source owner, doc_id, row_number() over (partition by source order by doc_id) - 1 ordinal from documents"),
    "byte_split": (byte_split, "select vec_id, array_to_string(list_transform([24, 16, 8, 0], lambda s: array_to_string(list_transform(embedding, lambda x: lpad(to_hex(((x::float::bit::integer::bigint & 4294967295) >> (24 - s)) & 255), 2, '0')), '')), '') planes from embeddings"),
    "stream_settle": (stream_settle, SQL["vc_settle"][1]),
    "stream_begin_end_pair": (stream_begin_end_pair, SQL["txn_begin_end_pair"][0]),
    "vc_value_at_asof": (vc_value_at_asof, "select p.event_id, v.value view_value from (select * from events where event_type = 'purchase') p asof join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts"),
    "vc_snapshot_all": (vc_snapshot_all, "select user_id, arg_max(value, event_id) \"value\", max(ts) ts from events where ts <= timestamp '2024-01-20 00:00:00' group by user_id"),
    "vc_pause_windows": (vc_pause_windows, "select e.event_id, e.user_id from events e left join (select user_id, min(ts) lo, max(ts) hi from events where event_type = 'error' group by user_id) w on e.user_id = w.user_id and e.ts between w.lo and w.hi where w.user_id is null"),
}


def _sql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    # tables are handed over as DataFrames, so that the session's own views stay as they are
    text = re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", r"\1 {\2}", SQL[name][0])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _sql(n) for n in SQL} | {n: _derived(n) for n in DERIVED} | {n: f for n, (f, _) in (PLANS | traces.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {n: other or text for n, (text, other) in SQL.items()} | {n: _derived_sql(n) for n in DERIVED} | {n: s for n, (_, s) in (PLANS | traces.QUERIES).items() if s}
