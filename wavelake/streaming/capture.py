"""Captured changes as a stream: settling by event time, begin/end pairing with state, and running what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from wavelake.session import shared_path, table


def changes(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 100) -> DataFrame:
    """A table's change files as a stream, whether the table is one file or a folder of them; event time is a timestamp with zone, as watermarks need."""
    own = f"{folder.rstrip('/')}/{name}.parquet"
    schema = table(spark, folder, name).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    rows = stream.parquet(own) if whole else stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def settle(rows: DataFrame, keys: list[str], step: str = "1 hour", late: str | None = "1 day") -> DataFrame:
    """The last value of each key and time step, with how many changes there were. A step leaves the state once the watermark has passed it, and later rows are dropped; without `late` there is no watermark and nothing is dropped, which suits bounded input."""
    timed = rows.withWatermark("ts", late) if late else rows
    return timed.groupBy(*keys, F.window("ts", step).alias("w")).agg(F.max_by("value", "event_id").alias("value"), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("h"), "value", "n")


def pairs(rows: DataFrame, begin: str, end: str, late: str | None = None) -> DataFrame:
    """(event_id, end_id): each user's begin whose next begin or end is an end, also over micro-batches.

    The state is one open begin for each user; changes must arrive in order from batch to batch, within one they are
    sorted. With `late`, an open begin is given up once the watermark is that far beyond it.
    """

    def step(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat(list(frames)).sort_values(["ts", "event_id"])[["event_type", "event_id"]]
        if state.exists:
            got = pd.concat([pd.DataFrame({"event_type": [begin], "event_id": [state.get[0]]}), got])
        paired = (got["event_type"] == begin) & (got["event_type"].shift(-1) == end)
        out = pd.DataFrame({"event_id": got["event_id"], "end_id": got["event_id"].shift(-1)})[paired].astype("int64")
        if got["event_type"].iloc[-1] == begin:
            state.update((int(got["event_id"].iloc[-1]),))
            if late:
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1 + int(pd.Timedelta(late).total_seconds() * 1000))
        elif state.exists:
            state.remove()
        yield out

    timed = rows.withWatermark("ts", late) if late else rows
    wanted = timed.where(F.col("event_type").isin(begin, end)).select("user_id", "ts", "event_id", "event_type")
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return wanted.groupBy("user_id").applyInPandasWithState(step, "event_id long, end_id long", "open_id long", "append", timeout)


def options(arguments: list[str], prefix: str = "capture_") -> dict:
    """Capture options from simulator arguments such as +capture_flush_interval=1000: file, two_state, flush_interval, compress, scope_grouped, signals; others are left out."""
    out: dict = {"two_state": False, "flush_interval": 100_000, "compress": "zlib", "scope_grouped": False, "signals": ""}
    for a in arguments:
        name, _, value = a.removeprefix("+").partition("=")
        name = {"2state": "two_state"}.get(name.removeprefix(prefix), name.removeprefix(prefix)) if name.startswith(prefix) else ""
        if name in ("two_state", "scope_grouped"):
            out[name] = True
        elif name == "flush_interval" and value:
            out[name] = int(value)
        elif name == "compress":
            out[name] = None if value == "none" else "zlib"
        elif name in ("file", "signals") and value:
            out[name] = value
    return out


def run_available(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives for all data there is. Each micro-batch replaces its own folder, so a repeated one counts once; with keys (update mode) a key's latest row stays."""
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    got = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(out)
    if not keys:
        return got.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
