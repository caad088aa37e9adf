"""Session construction and small session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every local run uses; a cluster session keeps its own sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "wavelake", cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings above."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path may live in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip(os.sep)}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "wavelake-checkpoints"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get()
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a written table, so that they are the same at each reading and survive lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
