"""Table sinks: versioned snapshots, append logs, CSV and JSON output, table copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rxloom.operators.catalogue import insert_or_ignore
from rxloom.schemas import conform


class SnapshotTable:
    """A table kept as complete Parquet snapshots `<path>/v=<n>`; readers see the newest complete one.

    A snapshot is complete once its commit marker exists, so a job that dies half-way
    leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        done = lambda v: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}/_SUCCESS"))
        return sorted(v for v in found if done(v))

    def version(self) -> int | None:
        found = self._versions()
        return found[-1] if found else None

    def read(self) -> DataFrame:
        """Newest snapshot; columns added to the schema since it was written arrive as nulls."""
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], self.schema)
        return conform(self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/v={v}"), self.schema)

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next snapshot. A given version that is already complete is left alone (replay)."""
        current = self.version()
        target = version if version is not None else (0 if current is None else current + 1)
        if target in self._versions():
            return target
        df.write.mode("overwrite").parquet(f"{self.path}/v={target}")
        return target


def append_by_day(df: DataFrame, path: str, ts: str) -> None:
    """Append a log partitioned by the day of `ts`."""
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def summarise_days(log: DataFrame, by: str, sums: dict[str, Column]) -> DataFrame:
    """Running summary of a log kept by day: per day and `by`, the number of rows and the given sums."""
    return log.groupBy("date", by).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in sums.items()])


def append_archive(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """CSV with one header per file and a byte-order mark before the first column name."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def copy_tables(sources: dict[str, DataFrame], targets: dict[str, SnapshotTable], key: str = "id") -> dict[str, int]:
    """Copy tables row by row into snapshot tables, ids preserved, rows already present ignored."""
    versions = {}
    for name, df in sources.items():
        target = targets[name]
        order: list[Column] = [F.col(key)]
        versions[name] = target.write(insert_or_ignore(target.read(), conform(df, target.schema), [key], order))
    return versions
