"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rxloom.plans.registry import load_all
from rxloom.session import build_session, stored_tables, use_local_folder

HEADLINE = [
    "normalize_documents", "kb_fold", "kb_upsert", "catalogue_enrich", "exact_match", "substring_match", "fuzzy_match",
    "cosine_match", "bm25_match", "match_cascade", "kb_name_match", "reconcile_summary", "consultation",
    "identify_batch", "fulltext_prefix", "detailed_stats", "approve_drugs", "page_fields",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    registry = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with stored_tables(spark):
            registry[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
