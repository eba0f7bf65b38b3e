"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion into Spark's ``noop`` sink (full execution, no
driver collection).  Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Timings are warm: a small untimed job warms the JVM first.  The derivation of the
client table, which all analyses share, is timed by itself as ``client_table``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from credrisk.plans.catalog import QUERIES, clients, load_all  # noqa: E402
from credrisk.session import local_session  # noqa: E402

HEADLINE = [
    "ingest", "features_train", "default_rate_by_education", "default_rate_breakdowns",
    "profile_numeric", "histogram_by_class", "box_by_class", "corr_matrix", "corr_with_target",
    "stratified_split", "roc_auc", "pr_curve", "metrics_by_threshold", "leaderboard",
    "factor_analysis", "tier_distribution", "prep_yeo_johnson", "model_logistic", "smote",
    "score_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    spark.range(1_000_000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    t = time.perf_counter()
    clients(spark, sf_dir)
    times = {"client_table": round(time.perf_counter() - t, 3)}
    for name in names:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
