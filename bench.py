"""Seconds of the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from tidewatch.plans import queries as plans
from tidewatch.session import session

HEADLINE = ("series_grid", "rolling_backfill", "rolling_sigma_flags", "persistence_filter", "event_metrics", "threshold_sweep", "threshold_best", "pr_auc", "acf", "bocpd_cp_prob", "stl_decompose")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()  # not the session's start
    took = {}
    for name in HEADLINE:
        began = time.time()
        plans.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
