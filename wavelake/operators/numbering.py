"""Row numbers over a whole table, without a window that puts all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.session import stored

#: Bytes of one range, about, by the planner's estimate.
RANGE_BYTES = 128 << 20


def numbered(rows: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """`rows` with their place from 1 in `order`, which must tell rows apart for the numbers to be defined; nulls come first.

    Rows are dealt by ranges of `order`, sorted and stored, one file for each range; a row's number is its place in
    its file and the number of rows in the files before, so that one shuffle is all. The ranges follow the table's
    size; the driver gets one count for each.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES), 1_000_000)
    dealt = stored(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order), "numbered")
    placed = dealt.select("*", F.col("_metadata.file_name").alias("_numbered_file"), F.col("_metadata.row_index").alias("_numbered_at"))
    # names hold the task's number, and that of the file if a task wrote several
    part = F.regexp_extract("f", "^part-([0-9]+)", 1).cast("long"), F.regexp_extract("f", "-c([0-9]+)", 1).cast("long")
    counts = placed.groupBy(F.col("_numbered_file").alias("f")).count().select("f", *part, "count").collect()
    before, starts = 0, []
    for f, _, _, n in sorted(counts, key=lambda r: (r[1], r[2] or 0)):
        starts.append((f, before))
        before += n
    offsets = spark.createDataFrame(starts, "_numbered_file string, _numbered_before long")
    joined = placed.join(F.broadcast(offsets), "_numbered_file")
    return joined.withColumn(name, F.col("_numbered_at") + F.col("_numbered_before") + 1).drop("_numbered_file", "_numbered_at", "_numbered_before")
