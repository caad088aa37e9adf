"""Value-change operators over (trace keys, var, time, seq, value) DataFrames.

Every window is partitioned by the signal group (the keys given), never global, so work spreads over the groups. A null
value is a value of its own: a change to it, or from it, counts. Rows repeated in time and seq stay as many as they are.
Columns that an operator needs in between get names that no input column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def spare(df: DataFrame, name: str) -> str:
    """A column name that a DataFrame doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def time_range(changes: DataFrame, start=None, end=None, time: str = "time") -> DataFrame:
    """Changes between two inclusive bounds, either of which may be left out; plain comparisons, so that they reach the scan."""
    out = changes
    if start is not None:
        out = out.where(F.col(time) >= start)
    if end is not None:
        out = out.where(F.col(time) <= end)
    return out


def change_only(changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before; the first of each group always stays."""
    w, same = Window.partitionBy(*keys).orderBy(*order), spare(changes, "_same")
    kept = (F.row_number().over(w) > 1) & F.lag(value).over(w).eqNullSafe(F.col(value))
    return changes.withColumn(same, kept).where(~F.col(same)).drop(same)


def settle(changes: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """The last value, by seq, of each key combination (such as signal and time), with how many there were."""
    return changes.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.count("*").alias("n"))


def snapshot(changes: DataFrame, keys: list[str], at, time: str, seq: str, value: str) -> DataFrame:
    """Each group's value at a time: its latest change at or before it; a map-side combined aggregate, no window."""
    return changes.where(F.col(time) <= at).groupBy(*keys).agg(F.max_by(value, F.struct(time, seq)).alias(value), F.max(time).alias(time))


def as_of(probes: DataFrame, changes: DataFrame, keys: list[str], time: str, seq: str, value: str, name: str) -> DataFrame:
    """Each probe with the latest value of `changes` at or before it, as column `name`: a union and a forward fill, one shuffle on the keys instead of a range join."""
    side, held = spare(probes, "_side"), spare(probes, "_held")
    cols = [c for c in probes.columns if c not in (*keys, time, seq)]
    kind = changes.schema[value].dataType
    # in a struct, so that a null value is found as well as any other
    left = probes.select(*keys, time, seq, *cols, F.lit(None).cast(StructType([StructField("v", kind)])).alias(held), F.lit(1).alias(side))
    right = changes.select(*keys, time, seq, *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in cols], F.struct(F.col(value).alias("v")).alias(held), F.lit(0).alias(side))
    w = Window.partitionBy(*keys).orderBy(time, side, seq).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn(held, F.last(held, ignorenulls=True).over(w)).where(F.col(side) == 1)
    return found.withColumn(name, F.col(f"{held}.v")).drop(held, side)


def controlled(changes: DataFrame, tasks: DataFrame, var: str, time: str, seq: str, value: str) -> DataFrame:
    """(var, time, value) as a capture writes them under its tasks: `tasks` has (time, task) with off, on and all.

    Changes while off are dropped, on begins with every signal's value at that time, all writes every signal's value
    without pausing. Changes at the time of off still count, those at the time of on are in its values. Tasks are few.
    """
    rows = sorted((r[0], r[1]) for r in tasks.select(time, "task").collect())
    out, dark = changes.select(var, time, seq, value), None
    shown = [t for t, task in rows if task in ("on", "all")]
    spans = []
    for t, task in rows:
        if task == "off" and dark is None:
            dark = t
        elif task == "on" and dark is not None:
            spans.append((dark, t))
            dark = None
    if dark is not None:
        spans.append((dark, None))
    lit = F.lit(True)
    for a, b in spans:
        lit = lit & ~((F.col(time) > a) if b is None else (F.col(time) > a) & (F.col(time) <= b))
    kept = out.where(lit).select(var, time, value)
    for t in shown:
        now = out.where(F.col(time) <= t).groupBy(var).agg(F.max_by(F.struct(value), F.struct(time, seq)).alias("_v"))
        kept = kept.unionByName(now.select(var, F.lit(t).cast(out.schema[time].dataType).alias(time), F.col(f"_v.{value}").alias(value)))
    return kept


def derived(changes: DataFrame, keys: list[str], time: str, seq: str, inputs: list[tuple[Column, Column]], result: Column, name: str = "v") -> DataFrame:
    """A derived signal: (keys, time, name) at each time it changes.

    `inputs` are pairs of a condition that picks an input's changes and its value; `result` is an expression over
    columns in0, in1, ... . At each distinct time an input's last change by seq counts, before its first it is 0.
    """
    last = [F.max_by(v, F.when(c, F.col(seq))).alias(f"_c{i}") for i, (c, v) in enumerate(inputs)]
    at = changes.groupBy(*keys, time).agg(*last)
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    filled = at.select(*keys, time, *[F.coalesce(F.last(f"_c{i}", ignorenulls=True).over(w), F.lit(0)).cast("long").alias(f"in{i}") for i in range(len(inputs))])
    return change_only(filled.select(*keys, time, result.alias(name)), keys, [time], name)


def runs(changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length form: (keys, value, run, n, first order column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    inner = Window.partitionBy(*keys, value).orderBy(*order)
    numbered = changes.withColumn("run", F.row_number().over(w) - F.row_number().over(inner))
    return numbered.groupBy(*keys, value, "run").agg(F.count("*").alias("n"), F.min(order[-1]).alias("first"))


def pause_windows(changes: DataFrame, windows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Changes outside all of their group's pause windows (keys, lo, hi; inclusive): an anti-join on the keys."""
    met = [changes[k] == windows[k] for k in keys] + [changes[time].between(windows["lo"], windows["hi"])]
    return changes.join(windows, met, "left_anti")
