"""Ranged numbering, byte planes and state over micro-batches, each against a plain version."""

import struct

from pyspark.sql import functions as F

from wavelake import catalogue
from wavelake.operators import planes
from wavelake.operators.numbering import numbered
from wavelake.streaming import capture

SF = "/root/testdata/sf0.001"


def test_numbers_are_dense(spark):
    rows = spark.range(1000).withColumn("k", F.expr("(id * 7919) % 1009"))
    got = [r.rn for r in numbered(rows, ["k"]).orderBy("k").collect()]
    assert got == list(range(1, 1001))
    assert numbered(rows.where("id < 0"), ["k"]).count() == 0


def test_planes_round_trip(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5, 0.0]), (2, []), (3, None)], "vec_id long, embedding array<float>")
    split = planes.split(rows, "embedding", keys=("vec_id",))
    raw = struct.pack("<3f", 1.0, -2.5, 0.0)
    assert bytes(split.where("vec_id = 1").first().planes) == b"".join(raw[i::4] for i in range(4))
    back = planes.unsplit(split, keys=("vec_id",)).orderBy("vec_id").collect()
    assert [r["values"] for r in back] == [[1.0, -2.5, 0.0], [], None]
    assert catalogue.queries()["byte_split"](spark, SF).count() == 500


def test_pairs_over_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
    for i in range(3):
        part = events.where(f"event_id % 1000 between {i * 334} and {i * 334 + 333}").coalesce(1)
        part.write.parquet(str(tmp_path / f"p{i}"))
        next((tmp_path / f"p{i}").glob("part-*")).rename(tmp_path / f"{i}-events.parquet")
    schema = events.schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*-events.parquet").option("maxFilesPerTrigger", 1).parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))
    got = capture.run_available(capture.pairs(stream, "view", "purchase"), "append").collect()
    want = catalogue.queries()["txn_begin_end_pair"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
