"""Request, ingestion and token metrics over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxloom.functions.fields import token_cost
from rxloom.operators import monitor, ranking
from rxloom.plans import domain as d
from rxloom.plans.registry import query

AT = "2024-01-29 00:00:00"


def _at():
    return F.to_timestamp(F.lit(AT))


@query("ingestion_stats", "A4", d.ctes(*d.KB_CTES) + """
SELECT batch_id, count(*) AS total_rows, min(last_updated) AS started_at, max(last_updated) AS completed_at, count(DISTINCT drug_name_norm) AS unique_drugs,
  count(DISTINCT disease_icd) AS unique_diseases FROM kb WHERE batch_id IS NOT NULL GROUP BY 1 ORDER BY completed_at DESC, batch_id LIMIT 50""")
def ingestion_stats(spark, sf):
    return monitor.ingestion_stats(d.kb(spark, sf))


@query("api_health", "A5 P5", d.ctes(d.REQUEST_LOGS) + f"""
SELECT count(*) AS total_requests, round(CASE WHEN count(*) > 0 THEN (count(*) - count(*) FILTER (status_code >= 500)) / count(*) * 100 ELSE 100.0 END, 2) AS success_rate,
  coalesce(round(avg(latency_ms), 2), 0.0) AS avg_latency FROM request_logs WHERE contains(endpoint, '/api/v1/') AND created_at >= TIMESTAMP '{AT}' - INTERVAL 10 DAYS""")
def api_health(spark, sf):
    return monitor.api_health(d.request_logs(spark, sf), _at(), "/api/v1/", 10)


@query("requests_per_endpoint", "A6", d.ctes(d.REQUEST_LOGS) + " SELECT endpoint, count(*) AS requests FROM request_logs GROUP BY 1")
def requests_per_endpoint(spark, sf):
    return monitor.requests_per_endpoint(d.request_logs(spark, sf))


def _sql_detail(where: str, group: str = "") -> str:
    head = f"{group}, " if group else ""
    return f"""SELECT {head}count(*) AS total_requests, count(*) FILTER (status_code < 400) AS success_count, count(*) FILTER (status_code >= 400) AS failure_count,
  coalesce(sum(matched_count), 0)::BIGINT AS total_matched, coalesce(sum(unmatched_count), 0)::BIGINT AS total_unmatched,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (status_code < 400) / count(*) * 100 ELSE 100.0 END, 1) AS success_rate,
  round(CASE WHEN sum(matched_count) + sum(unmatched_count) > 0 THEN sum(matched_count) / (sum(matched_count) + sum(unmatched_count)) * 100 ELSE 0.0 END, 1) AS coverage_rate,
  round(coalesce(avg(latency_ms), 0.0), 0) AS avg_latency_ms FROM request_logs WHERE {where} {f'GROUP BY {group}' if group else ''}"""


@query("detailed_stats", "A7", d.ctes(d.REQUEST_LOGS) + " " + _sql_detail("TRUE"))
def detailed_stats(spark, sf):
    return monitor.detailed_stats(d.request_logs(spark, sf), _at())


@query("detailed_stats_week", "A7 P5", d.ctes(d.REQUEST_LOGS) + " " + _sql_detail(
    f"contains(endpoint, 'click') AND created_at >= TIMESTAMP '{AT}' - INTERVAL 7 DAYS"))
def detailed_stats_week(spark, sf):
    return monitor.detailed_stats(d.request_logs(spark, sf), _at(), "click", "week")


@query("logs_today", "P5 O4", d.ctes(d.REQUEST_LOGS) + f"""
SELECT id, endpoint, status_code, created_at FROM request_logs WHERE created_at::DATE = DATE '{AT[:10]}' ORDER BY created_at DESC, id DESC LIMIT 20""")
def logs_today(spark, sf):
    kept = monitor.filter_logs(d.request_logs(spark, sf), _at(), period="today")
    return monitor.recent_logs(kept.select("id", "endpoint", "status_code", "created_at"))


@query("recent_logs", "O4", d.ctes(d.REQUEST_LOGS) + " SELECT id, endpoint, created_at FROM request_logs ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_logs(spark, sf):
    return monitor.recent_logs(d.request_logs(spark, sf).select("id", "endpoint", "created_at"), 50)


USAGE = "usage AS (SELECT ts, user_id * 1000 AS tin, event_id % 500 AS tout FROM events)"


@query("token_usage", "A12 F39", f"""WITH {USAGE}
SELECT ts::DATE AS day, count(*) AS calls, sum(tin)::BIGINT AS input_tokens, sum(tout)::BIGINT AS output_tokens,
  round(sum(round(tin / 1e6 * 0.15::DOUBLE + tout / 1e6 * 0.60::DOUBLE, 8)), 6) AS cost_usd FROM usage GROUP BY 1""")
def token_usage(spark, sf):
    tin, tout = F.col("user_id") * 1000, F.col("event_id") % 500
    usage = d.table(spark, sf, "events").select(
        F.col("ts").alias("timestamp"), tin.alias("input_tokens"), tout.alias("output_tokens"), token_cost(tin, tout).alias("cost_usd"))
    return monitor.token_usage_summary(usage)


@query("link_union", "U4", """
WITH a AS (SELECT url, 0 AS frame, page_id AS pos FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 1, page_id FROM pages UNION ALL SELECT split_part(url, '?', 1), 2, page_id FROM pages)
SELECT url, frame, pos FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY frame, pos) = 1 ORDER BY frame, pos, url LIMIT 40""")
def link_union(spark, sf):
    p = d.table(spark, sf, "pages").select("url", F.col("page_id").alias("pos"))
    bare = p.select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), "pos")
    return ranking.union_ordered(p.where("pos % 2 = 0"), p, bare, value="url", pos="pos", cap=40)
