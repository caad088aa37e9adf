"""Hierarchies as rows: paths, levels, glob filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.session import stored

#: Patterns that a filter may have.
MOST_PATTERNS = 64


def paths(nodes: DataFrame, keys: tuple[str, ...] = (), node: str = "id", parent: str = "parent", name: str = "name", most_levels: int = 10_000) -> DataFrame:
    """nodes with `path`, names joined by dots from the top, and `depth`, level by level: one equi-join and one stored table for each level, without a limit of rows. A name that is an index in brackets joins without a dot. Nodes that hang below none of the top are left out."""
    n = nodes.select(*keys, F.col(node).alias("_n"), F.col(parent).alias("_p"), F.col(name).alias("_name"))
    level = stored(n.where("_p is null").select(*keys, "_n", F.col("_name").alias("path"), F.lit(0).alias("depth")), "paths")
    found = level
    for depth in range(1, most_levels):
        above = level.select(*keys, F.col("_n").alias("_p"), F.col("path").alias("_path"))
        joint = F.when(F.col("_name").startswith("["), "").otherwise(".")
        level = stored(n.join(above, [*keys, "_p"]).select(*keys, "_n", F.concat("_path", joint, "_name").alias("path"), F.lit(depth).alias("depth")), "paths")
        if level.isEmpty():
            return nodes.join(found.withColumnRenamed("_n", node), [*keys, node])
        found = found.unionByName(level)
    raise ValueError("more levels than allowed, or a cycle")


def glob(pattern: str) -> str:
    """A regular expression of a shell pattern, in which a star also crosses dots."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c in "*?":
            out.append("." + "*" * (c == "*"))
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] in "!^"))) > 0:
            own, i = pattern[i:end], end + 1
            out.append("[" + ("^" + own[1:] if own[0] in "!^" else own).replace("\\", "\\\\").replace("[", "\\[") + "]")
        else:
            out.append(re.escape(c))
    return "".join(out)


def matches(path: Column, patterns: str) -> Column:
    """Whether a path fits one of the patterns, joined by commas; no pattern takes all."""
    own = [p for p in patterns.split(",") if p]
    if len(own) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    return path.rlike("^(?s:" + "|".join(map(glob, own)) + ")$") if own else F.lit(True)
