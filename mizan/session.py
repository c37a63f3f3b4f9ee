"""Session helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "mizan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for (AQE on, UTC)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # small tables of long texts: bytes say little about the work, so all cores get a share
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as a lazily read Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(have)
        return have
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"mizan-checkpoint-{uuid.uuid4().hex}")
    sc.setCheckpointDir(own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise_files(df: DataFrame) -> DataFrame:
    """Written once to the shared folder as Parquet, which takes less room there than a checkpoint's rows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/mizan_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, key: str) -> DataFrame:
    """Written once to the shared folder as a table bucketed by `key`, so that what groups by it later needs no
    shuffle. `df` has to come partitioned by `key` into `shuffle_partitions` parts."""
    spark, name = df.sparkSession, f"mizan_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").bucketBy(shuffle_partitions(spark), key).option("path", path).saveAsTable(name)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
