"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from tideline import catalog
from tideline.session import local_session

HEADLINE = [
    "expand_growth",
    "flagship_weekly_forecast",
    "weekly_supervised",
    "lag_set",
    "lag_set_unbounded_keys",
    "rolling_strict",
    "rolling_unbounded_keys",
    "streak_unbounded_keys",
    "interpolate_linear",
    "ffill_unbounded_keys",
    "attach_daily_series",
    "range_totals_unbounded_keys",
    "rows_after_events",
    "delayed_response",
    "detection_leads",
    "state_transitions_unbounded_keys",
    "lag_correlation",
    "exact_quantiles_by_group",
    "median_impute_train_scope",
    "column_profile",
    "recommendations_exploded",
    "rules_all_matches_flat",
    "oversample_to_target",
    "expanding_folds",
    "alert_metrics",
    "roc_auc",
    "threshold_sweep",
    "threshold_pair_search",
    "conformal_alert_sets",
    "smoothing_baseline",
    "tag_documents",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("OFF")
    fns = catalog.queries()
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderpriority").count().collect()
    times = {}
    for name in wanted:
        start = time.time()
        fns[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
