"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully materialised with the ``noop`` sink (no collect) and timed
warm (best of $BENCH_REPEATS, default 2).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dwell.plans import catalog  # noqa: E402
from dwell.session import local_session  # noqa: E402

HEADLINE = [
    "pair_next", "pair_ledger", "pair_breakdown", "event_pairs", "core_metrics", "metrics_by_decile",
    "compare_variants", "pr_curve", "classifier_metrics", "classifier_by_group", "reliability_table",
    "spearman", "rank_preserving", "controlled_effect", "feature_contrast", "over_representation",
    "group_median_lookup", "overlapping_stays", "transitions", "varies_across_visits", "parse_part_text",
    "wall_clock", "timeline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    scratch = tempfile.mkdtemp(prefix="dwell-bench-")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2)),
                          driver_memory="16g")
    if not spark.sparkContext.getCheckpointDir():  # set only where unset
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    qs = catalog.queries()
    # warm the JVM and the parquet footers once
    qs["duration_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(repeats):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_headline_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
