"""Bench: wall time of the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints ONE JSON line.  Each query is executed completely with the ``noop``
sink (no collect).  One untimed pass over all headline queries warms the JVM
(class loading, code generation); a timed query then runs from scratch: all
caches are dropped before it, so its time holds the scans, joins and
aggregations that build the subscriber table, the fits and all jobs.  With
BENCH_REPEATS (default 3) timed passes, each query reports the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["scan_subscriber", "treat_all", "derive_features", "segment_sizes", "profile_describe", "risk_ranking",
            "roc_200", "auc_roc", "sweep_recall", "recommend", "learning_curve",
            "campaign_by_segment", "client_detail", "next_best_offer"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from churnkit.plans.context import forget
    from churnkit.plans.registry import QUERIES
    from churnkit.session import get_session

    # one JVM: every task is process-local, so no locality wait is needed
    extra = {"spark.locality.wait": os.environ.get("BENCH_LOCALITY_WAIT", "0s")}
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), extra_conf=extra)
    # warm-up pass (untimed): JVM, code generation, parquet footers, raw table
    if os.environ.get("BENCH_WARMUP", "1") == "1":
        for name in HEADLINE:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "3")))
    runs: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for _ in range(repeats):
        for name in HEADLINE:
            forget(spark)
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - t0)
    times = {name: round(statistics.median(v), 3) for name, v in runs.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_wall_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
