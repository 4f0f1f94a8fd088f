"""Times the headline queries and prints one JSON line.

Every query is run to its end (all rows and columns, no collection) once cold
and then ``BENCH_RUNS`` times; the reported figure is the best of those.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stocklens.plans.revenue import build_revenue_aggregate, stored_revenue_by_day  # noqa: E402
from stocklens.registry import END, QUERIES, START  # noqa: E402
from stocklens.session import fresh_dir, local_session  # noqa: E402
from stocklens.sources.shop import shop_tables  # noqa: E402

HEADLINE = [
    "turnover_top_locations",
    "turnover_all_locations",
    "revenue_by_day",
    "revenue_all_days",
    "revenue_by_day_stored",
    "revenue_report_from_aggregate",
    "order_document_lines",
    "current_movements",
    "current_from_envelopes",
    "stream_current_movements",
    "kpi_total_quantity",
    "daily_by_type",
    "top_locations",
    "type_share",
    "upsert_customers",
    "backfill_order_totals",
    "created_orders",
    "created_order_items",
    "status_changes_orders",
    "status_changes_events",
    "logged_status_events",
    "stream_status_orders",
    "numbered_notes",
    "counter_rates",
    "cache_hit_ratio",
    "latency_by_profile",
    "order_document_parts",
    "turnover_best_sellers",
]


def seconds(spark, query, folder: str) -> float:
    begin = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    queries = dict(QUERIES)
    if "revenue_report_from_aggregate" in chosen:
        # The aggregate is built outside the timing: this is the reading side alone.
        path = fresh_dir(spark, "bench-revenue")
        build_revenue_aggregate(shop_tables(spark, folder), path)
        queries["revenue_report_from_aggregate"] = lambda s, _: stored_revenue_by_day(s, path, START, END)
    cold, warm = {}, {}
    for name in chosen:
        cold[name] = round(seconds(spark, queries[name], folder), 3)
        warm[name] = round(min(seconds(spark, queries[name], folder) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "sum of warm query times",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
