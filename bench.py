"""Run the headline queries once each and print one JSON line of seconds."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadastra.plans.catalog import QUERIES  # noqa: E402
from cadastra.session import local_session  # noqa: E402

# One query per family of the product: market pack, identity, readings, resale, valuation, listings,
# forecast, developers, issuers, panels, vintages, quality.
HEADLINE = (
    "monthly_series", "sales_stats", "headline", "area_league", "developer_league", "yield_map", "rent_stats", "merge_duplicates", "registration_keys",
    "latest_as_of", "moves", "supply_market", "delay_flags", "resale_pairs", "resale_stats", "repeat_sales_index", "valuation_calibration",
    "validated_drops", "market_forecast", "developer_profile", "issuer_register", "escrow_totals", "first_sales_panel", "registrations_panel",
    "vintage_by_month", "gained_groups", "quality_report", "area_stats", "peer_sets",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "cadastra-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, rows = {}, {}
    for name in names:
        started = time.perf_counter()
        rows[name] = len(QUERIES[name](spark, sf_dir).toArrow())
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows,
    }))


if __name__ == "__main__":
    main()
