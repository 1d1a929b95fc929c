"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_RUNS (timed runs after one warm-up of all queries),
BENCH_QUERIES (comma-separated names). A query's figure is the median of its timed runs, from building
the DataFrame to the last row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larder.plans.catalog import QUERIES  # noqa: E402
from larder.session import build_session  # noqa: E402

HEADLINE = (
    "supplier_performance", "order_status", "sum_money", "inventory", "rolling_features", "shortage_label",
    "training_set", "scoring_set", "current_position", "watch_list", "health_summary", "explain", "trend",
    "escalation", "transfer_candidates", "alternate_suppliers", "disruption_days", "risk_by", "high_risk_by_supplier",
    "monthly_prevalence", "backtest", "roc_auc", "pr_auc", "calibration", "latency_summary", "latency_by_name",
    "throughput", "stream_request_rates", "stream_sessions", "fold_messages", "fold_tool_calls", "dedup_messages",
    "chat_list", "transcript", "retrieve_vectors", "retrieve_top_k", "orphan_report", "duplicate_keys", "panel_gaps",
    "rule_checks",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    runs = max(1, int(os.environ.get("BENCH_RUNS", "1")))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "larder-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    for name in names:
        once(name)
    seconds = {n: round(statistics.median(once(n) for _ in range(runs)), 3) for n in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
