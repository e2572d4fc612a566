"""Ingestion, request and token metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(ts: str, now: Column, period: str | int | None) -> Column:
    """Time filter: 'today', 'week', 'month', a number of days, or everything."""
    if period is None:
        return F.lit(True)
    if period == "today":
        return F.to_date(ts) == F.to_date(now)
    days = {"week": 7, "month": 30}.get(period, period)
    return F.col(ts) >= now - F.make_dt_interval(F.lit(int(days)))


def filter_logs(logs: DataFrame, now: Column, endpoint: str | None = None, period: str | int | None = None,
                ts: str = "created_at") -> DataFrame:
    kept = logs.where(in_range(ts, now, period))
    return kept.where(F.contains("endpoint", F.lit(endpoint))) if endpoint else kept


def recent_logs(logs: DataFrame, limit: int = 20, ts: str = "created_at") -> DataFrame:
    return logs.orderBy(F.desc(ts), F.desc("id")).limit(limit)


def ingestion_stats(kb: DataFrame, limit: int = 50) -> DataFrame:
    """Rows, first and last update and distinct drugs and codes per batch, newest batches first."""
    return (
        kb.where(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(F.count("*").alias("total_rows"), F.min("last_updated").alias("started_at"),
             F.max("last_updated").alias("completed_at"), F.count_distinct("drug_name_norm").alias("unique_drugs"),
             F.count_distinct("disease_icd").alias("unique_diseases"))
        .orderBy(F.desc("completed_at"), "batch_id")
        .limit(limit)
    )


def api_health(logs: DataFrame, now: Column, endpoint: str, days: int = 1) -> DataFrame:
    """Total, success rate (5xx is an error; 100 without traffic) and average latency."""
    c = filter_logs(logs, now, endpoint, days).agg(
        F.count("*").alias("total_requests"), F.count_if(F.col("status_code") >= 500).alias("errors"),
        F.avg("latency_ms").alias("latency"))
    total = F.col("total_requests")
    return c.select(
        "total_requests",
        F.round(F.when(total > 0, (total - F.col("errors")) / total * 100).otherwise(100.0), 2).alias("success_rate"),
        F.coalesce(F.round("latency", 2), F.lit(0.0)).alias("avg_latency"))


def requests_per_endpoint(logs: DataFrame) -> DataFrame:
    return logs.groupBy("endpoint").agg(F.count("*").alias("requests"))


def traffic_aggregates() -> list[Column]:
    """Aggregates of the detailed statistics, shared by the batch and the streaming job."""
    return [
        F.count("*").alias("total_requests"),
        F.count_if(F.col("status_code") < 400).alias("success_count"),
        F.count_if(F.col("status_code") >= 400).alias("failure_count"),
        F.coalesce(F.sum("matched_count"), F.lit(0)).alias("total_matched"),
        F.coalesce(F.sum("unmatched_count"), F.lit(0)).alias("total_unmatched"),
        F.avg("latency_ms").alias("latency"),
    ]


def with_traffic_rates(stats: DataFrame) -> DataFrame:
    total, seen = F.col("total_requests"), F.col("total_matched") + F.col("total_unmatched")
    return stats.withColumns({
        "success_rate": F.round(F.when(total > 0, F.col("success_count") / total * 100).otherwise(100.0), 1),
        "coverage_rate": F.round(F.when(seen > 0, F.col("total_matched") / seen * 100).otherwise(0.0), 1),
        "avg_latency_ms": F.round(F.coalesce("latency", F.lit(0.0)), 0),
    }).drop("latency")


def detailed_stats(logs: DataFrame, now: Column, endpoint: str | None = None, period: str | int | None = None) -> DataFrame:
    return with_traffic_rates(filter_logs(logs, now, endpoint, period).agg(*traffic_aggregates()))


def token_usage_summary(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
