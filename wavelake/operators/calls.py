"""Depths, trees and parents of calls, from rows of entering and leaving in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def depths(events: DataFrame, keys: list[str], order: list[str], is_enter: str = "is_enter", name: str = "depth") -> DataFrame:
    """Events with the depth of their call, from 0. Leaving without a call stays at 0: a running sum, reflected at its smallest value so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(F.col(is_enter), 1).otherwise(-1)).over(w)
    summed = events.withColumn(f"{name}__sum", total)
    level = F.col(f"{name}__sum") - F.least(F.lit(0), F.min(f"{name}__sum").over(w))
    return summed.withColumn(name, (level - F.when(F.col(is_enter), 1).otherwise(0)).cast("long")).drop(f"{name}__sum")


def tree(events: DataFrame, keys: list[str], order: str, is_enter: str = "is_enter", results: tuple[str, ...] = ()) -> DataFrame:
    """One row for each call: the entering row's columns, `depth`, `end` (the order of its leaving, null while open), `parent` (that of the enclosing call, null at the top) and the `results` columns of its leaving, as end_<name>."""
    d = depths(events, keys, [order], is_enter)
    same = Window.partitionBy(*keys, "depth").orderBy(order)
    after = {f"end_{c}": F.lead(c).over(same) for c in results}
    left = ~F.lead(is_enter).over(same)
    paired = d.withColumns({"end": F.when(left, F.lead(order).over(same)), **{k: F.when(left, v) for k, v in after.items()}}).where(is_enter)
    # a call's parent is the last call entered before it one level up: calls look up one level, where all calls of that level stand
    looks = paired.withColumn("_level", F.explode(F.array(F.col("depth"), F.col("depth") - 1))).withColumn("_own", F.col("_level") == F.col("depth"))
    up = Window.partitionBy(*keys, "_level").orderBy(F.col(order), F.col("_own")).rowsBetween(Window.unboundedPreceding, 0)
    found = looks.withColumn("parent", F.last(F.when(F.col("_own"), F.col(order)), ignorenulls=True).over(up))
    return found.where("not _own").drop("_level", "_own")
