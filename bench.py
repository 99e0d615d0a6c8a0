"""Time the headline queries: ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``; prints one JSON line.

One untimed run of the flagship query warms the JVM up. Each time covers building the query, reading its
tables and running it into Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from querywarden.plans.catalog import QUERIES
from querywarden.session import build_session

HEADLINE = [
    "risk_by_project", "sql_fingerprint", "first_occurrence_dedup", "statement_delta", "full_scan_upsert",
    "incremental_scan_upsert", "scan_batch_summary", "latest_analysis", "reuse_prior_analysis", "reuse_within_ttl",
    "retire_duplicates", "table_refs", "ddl_context", "column_cardinality", "exemption_match", "knowledge_by_table",
    "vector_topk", "retrieve_context", "rule_risk_level", "batch_score", "assessment_parse", "failure_streaks",
    "dashboard_overview", "risky_statements", "analysis_detail", "keyword_search", "handle_status_apply",
    "fill_missing_owners", "remind_message", "mapper_statement_extract", "annotation_sql_extract",
    "wrapper_statements", "pseudo_sql_assemble", "push_event_route",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "querywarden.inputPartitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
