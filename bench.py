"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], median of RUNS; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from claimgrid import catalog
from claimgrid.session import get_spark

RUNS = 3
HEADLINE = [
    "claim_adjudication",
    "claim_item_totals",
    "item_classification",
    "classifier_claim_totals",
    "deterministic_inclusion",
    "daily_dashboard",
    "batch_evaluation_view",
    "decision_accuracy",
    "engine_version_scorecard",
    "latest_active_decision",
    "supersede_chain",
    "evaluation_metrics",
    "variance_summary",
    "items_fitted_to_cap",
    "invoice_line_items",
    "document_search_any",
    "indexed_search_any",
    "claims_by_status",
    "month_by_status",
    "next_work_items",
    "sla_metrics",
    "error_budget",
    "personal_data_counts",
    "ruleset_ab_summary",
    "decision_audit_log",
    "result_reuse",
    "stream_sla_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    catalog.run("claims_by_status", spark, folder).collect()  # start the JVM's readers
    picked = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in picked:
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    claims = spark.read.parquet(f"{folder}/orders.parquet").count()
    items = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    rates = {}
    if "claim_adjudication" in times:
        rates["claims_per_hour"] = round(claims / times["claim_adjudication"] * 3600)
    if "item_classification" in times:
        rates["items_per_sec"] = round(items / times["item_classification"])
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").split("sf")[-1],
                **rates,
            }
        )
    )


if __name__ == "__main__":
    main()
