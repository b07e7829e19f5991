"""Benchmark the headline jobs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

t = 0.60, checkpoint groups + consolidation plan, monitor snapshot, and the full
optimization job (filter -> dedup keep_latest -> monitor) writing snapshots.
Each query is timed to completion of a full write to a no-op sink (``noop`` format),
so every row is produced; session start-up is excluded.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from scrubjay.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="scrubjay-bench", shuffle_partitions=int(cpus) * 2,
                      conf={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    from scrubjay import jobs
    from scrubjay.config import DedupConfig
    from scrubjay.operators import checkpoints as C
    from scrubjay.operators import dedup as D
    from scrubjay.queries import QUERIES
    from scrubjay.sources.observations import obs_checkpoints, obs_documents

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    work = tempfile.mkdtemp(prefix="scrubjay-bench-")
    # the test tables are single row groups, which a scan cannot split
    parts = 2 * int(cpus)
    docs, ticks = obs_documents(spark, sf_dir), obs_checkpoints(spark, sf_dir)
    plan = {
        "exact_dedup_groups": lambda: sink(D.find_groups(docs, partitions=parts)),
        "exact_dedup_totals": lambda: sink(D.summarize(docs, partitions=parts)),
        "fuzzy_dedup_t060": lambda: sink(D.find_groups(docs, DedupConfig(similarity_threshold=0.60), partitions=parts)),
        "checkpoint_groups": lambda: sink(C.checkpoint_groups(C.annotate(ticks, partitions=parts))),
        "consolidation_plan": lambda: sink(C.consolidation_plan(C.annotate(ticks, partitions=parts))),
        "monitor_snapshot": lambda: sink(QUERIES["monitor_snapshot"](spark, sf_dir)),
        "history_trends": lambda: sink(QUERIES["history_trends"](spark, sf_dir)),
        "full_optimization": lambda: jobs.bench_optimize(spark, sf_dir, os.path.join(work, "opt"), parts),
    }
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    # warm-up (not timed): JIT, regex and Python-worker start-up on the smallest tables
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small) and os.path.abspath(small) != os.path.abspath(sf_dir):
        for q in ("dedup_exact_groups", "dedup_groups", "consolidation_plan", "monitor_snapshot",
                  "history_trends"):
            sink(QUERIES[q](spark, small))
        spark.catalog.clearCache()
    times = {}
    for name, fn in plan.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_clock", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
