"""Live request metrics per tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rxloom.operators.monitor import traffic_aggregates, with_traffic_rates
from rxloom.operators.ranking import top_per_key


def windowed_metrics(logs: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", by: list[str] | None = None,
                     event_id: str | None = None) -> DataFrame:
    """Traffic statistics per event-time window (batch or streaming); rows later than the watermark are dropped.

    With `event_id` a stream counts an event once, however often it comes within the watermark's delay.
    """
    timed = logs.withWatermark("created_at", lateness)
    if event_id:
        timed = timed.dropDuplicatesWithinWatermark([event_id]) if logs.isStreaming else timed.dropDuplicates([event_id])
    keyed = timed.groupBy(F.window("created_at", window), *(by or []))
    stats = keyed.agg(*traffic_aggregates())
    out = with_traffic_rates(stats).withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
    return out.drop("window")


def start_metrics(logs: DataFrame, path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Write changed windows of every micro-batch under `path/epoch=<n>`; replays overwrite their own epoch."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = windowed_metrics(logs, **options).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def store_progress(spark: SparkSession, query: StreamingQuery, path: str) -> None:
    """Write (epoch, operator, rows_dropped) of the micro-batches the query still remembers, each epoch to its own folder.

    Rows dropped are those behind the watermark. Call it after a run, or now and then during one: an epoch's folder is replaced.
    """
    for p in query.recentProgress:
        rows = [(p.batchId, s.operatorName, s.numRowsDroppedByWatermark) for s in p.stateOperators]
        if rows:
            frame = spark.createDataFrame(rows, "epoch long, operator string, rows_dropped long")
            frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={p.batchId}")


def read_dropped(spark: SparkSession, path: str) -> DataFrame:
    """Rows dropped as late per epoch, over all stateful operators."""
    return spark.read.parquet(path).groupBy("epoch").agg(F.sum("rows_dropped").alias("rows_dropped"))


def read_metrics(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """Latest state of every window."""
    rows = spark.read.parquet(path)
    return top_per_key(rows, ["window_start", *(by or [])], [F.desc("epoch")]).drop("epoch")
