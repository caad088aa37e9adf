"""Derived signals from a table of definitions, each computed once however many others use it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.functions.bytecode import parse
from wavelake.functions.expr import compile_expr
from wavelake.operators import signals
from wavelake.plans.graph import Materializer


def read(changes: DataFrame, definitions: list, wanted: list[int], keys: tuple[str, ...] = ("trace",), seq: str = "block") -> DataFrame:
    """(keys, var_id, time, v_int) of the wanted derived signals.

    `definitions` are rows of the table `derived` (few, so on the driver): a definition's inputs are signals of
    `changes` (keys, var_id, time, seq, v_int) or other definitions. A cycle is a ValueError. Each definition becomes
    one plan over those of its inputs; states other than 0 and 1 have no number and count as no change.
    """
    known = {d["var_id"]: d for d in definitions}
    base = changes.where("v_int is not null").select(*keys, "var_id", "time", F.col(seq).alias("_seq"), "v_int")

    def made(var: int, inputs: list[DataFrame]) -> DataFrame:
        if var not in known:
            return base.where(F.col("var_id") == var)
        d = known[var]
        own = inputs[0]
        for other in inputs[1:]:
            own = own.unionByName(other)
        slots = [(F.col("var_id") == i, F.col("v_int")) for i in d["inputs"]]
        result = compile_expr(parse(bytes(d["code"])), [F.col(f"in{i}") for i in range(len(slots))], d["bit_width"])
        out = signals.derived(own, list(keys), "time", "_seq", slots, result, "v_int")
        return out.select(*keys, F.lit(var).cast("long").alias("var_id"), "time", F.lit(0).cast("long").alias("_seq"), "v_int")

    m = Materializer({v: list(dict.fromkeys(d["inputs"])) for v, d in known.items()}, made)
    out = None
    for var in wanted:
        one = m.get(var).drop("_seq")
        out = one if out is None else out.unionByName(one)
    return out
