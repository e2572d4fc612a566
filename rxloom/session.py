"""Session defaults and materialisation of intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# AQE splits skewed join partitions; `force` keeps that on when the join output
# feeds an aggregate that could have reused the join's partitioning.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "rxloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the engine's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_STORED: list[str] = []
_LOCAL: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, read from spark.checkpoint.dir."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not _LOCAL:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return _LOCAL[0]


def use_local_folder(spark: SparkSession) -> None:
    """For tests, benches and single-machine runs: name a temporary folder where none is set and the master is local."""
    if not spark.conf.get(CHECKPOINT_CONF, None) and spark.sparkContext.master.startswith("local[") and not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="rxloom-"))


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _STORED.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage so that a result used several times is computed once, survives
    the loss of executors, and carries true sizes for the planner's join choice.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was stored inside; read or write results before that."""
    first = len(_STORED)
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for name in _STORED[first:]:
            path = hadoop.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _STORED[first:]
