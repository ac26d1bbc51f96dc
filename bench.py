"""Benchmark: run the headline queries on $BENCH_SF_DIR (default sf0.1) with
local[$BENCH_CPUS] and print one JSON line with per-query wall seconds.

Each query is executed in full into Spark's ``noop`` sink (every stage runs,
nothing is pulled into Python), so timings measure the engine, not a
driver-side collect of millions of rows. Plan-time jobs (checkpoints, model
fits) are inside the timed region."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ohmflow.plans import QUERIES  # noqa: E402
from ohmflow.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_critical",     # clean + per-user windows + baseline z + status
    "temporal_all",          # 140 temporal features over one global series (halo blocks)
    "edge_load",             # graph features
    "node_status",           # z-scores + alert rules
    "stratified_split",      # exact stratified split (ordinal ranks)
    "standard_scale",        # fit on train, apply
    "roc_auc",               # distributed curve metric
    "best_threshold",        # PR curve + selection
    "cv_summary",            # per-fold metrics + summary
    "feed_summary",          # dashboard aggregate over the ordered feed
    "export_rows",           # z-scores + top deviations + export text
    "boxplot_by_class",      # exact quantiles by class
]
EXTRA = [q for q in ("isolation_forest", "smote_balance", "schedule_overlay", "stream_alerts")
         if q in QUERIES]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    names = [q for q in HEADLINE + EXTRA if q in QUERIES]
    only = os.environ.get("BENCH_QUERIES")
    if only:
        names = [q for q in only.split(",") if q in QUERIES]
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
