"""Continuous ingest: every arriving log file is folded into the knowledge-base snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from rxloom.operators.knowledge import (
    batch_stats, build_kb, compact_log, lookup_disease_ref, prepare_log, upsert_kb,
)
from rxloom.session import materialise
from rxloom.sources.files import LOG_ALIASES, resolve_log_columns
from rxloom.sources.tables import SnapshotTable


def log_schema(header: list[str]) -> StructType:
    """All-string schema of a log file with the given header."""
    known = {a for names in LOG_ALIASES.values() for a in names}
    if not known & set(header):
        raise ValueError("no known column in the header")
    return StructType([StructField(name, StringType()) for name in header])


def ingested_files(kb: SnapshotTable) -> DataFrame:
    """(source_file, modified, version) of the files folded into complete snapshots."""
    spark, done = kb.spark, kb.version()
    schema = "source_file string, modified timestamp, version int"
    if done is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{kb.path}/files").where(F.col("version") <= done)


def apply_batch(log: DataFrame, diseases: DataFrame, kb: SnapshotTable, stats_path: str, archive_path: str | None = None) -> None:
    """Fold one micro-batch, skipping files (path and modification time) that a complete snapshot already holds.

    The manifest of a snapshot is written before the snapshot and counts only once that is complete. So a replay changes
    nothing, whatever happened to the checkpoint, and a new file is never skipped. Order in a file is `row`.
    """
    at = ["source_file", "modified"]
    fresh = materialise(log.join(ingested_files(kb), at, "left_anti"), "batch")
    if fresh.isEmpty():
        return
    old_version = kb.version()
    version = 0 if old_version is None else old_version + 1
    fresh.select(*at).distinct().withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{kb.path}/files/{version}")
    batch, now = F.lit(f"batch-{version}"), F.current_timestamp()
    rows = resolve_log_columns(fresh.withColumn("pos", F.concat_ws("#", "source_file", F.lpad(F.col("row").cast("string"), 20, "0"))))
    old = kb.read()
    fold = build_kb(rows, diseases, batch, now)
    parsed = prepare_log(compact_log(rows, batch), F.col("batch_id"))
    parsed = lookup_disease_ref(parsed, diseases, "disease_icd", "disease_ref_id")
    stats = batch_stats(rows, parsed, old).withColumns({"batch_id": batch, "version": F.lit(version)})
    stats.write.mode("overwrite").parquet(f"{stats_path}/batch={version}")
    if archive_path:
        content = [c for c in fresh.columns if c not in ("row", "source_file", "modified")]
        raw = fresh.select(batch.alias("batch_id"), F.to_json(F.struct(*content)).alias("raw_content"), F.col("source_file").alias("source_ip"), now.alias("created_at"))
        raw.write.mode("overwrite").parquet(f"{archive_path}/batch={version}")
    kb.write(upsert_kb(old, fold), version=version)


def start_ingest(spark: SparkSession, inbox: str, header: list[str], diseases: DataFrame, kb: SnapshotTable, checkpoint: str,
                 stats_path: str, archive_path: str | None = None, files_per_batch: int = 1, once: bool = True) -> StreamingQuery:
    """Watch `inbox` for CSV files of one header form; each micro-batch is one ingest batch."""
    source = (
        spark.readStream.schema(log_schema(header)).option("header", True).option("multiLine", True).option("escape", '"')
        .option("maxFilesPerTrigger", files_per_batch).csv(inbox)
        .withColumns({"source_file": F.col("_metadata.file_path"), "modified": F.col("_metadata.file_modification_time")})
    )

    def run(batch: DataFrame, epoch: int) -> None:
        apply_batch(batch.withColumn("row", F.monotonically_increasing_id()), diseases, kb, stats_path, archive_path)

    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
