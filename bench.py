"""Benchmark: run the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and
print one JSON line. Each query is forced through the full plan with the ``noop`` sink
(no driver collect), after one warm-up pass over a small table.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g9_decision_summary",      # flagship: every message: threads -> rules -> clusters -> pools -> TF-IDF top-k -> gates -> route -> decide
    "j1_strict_threads",
    "r1_resolution_type",
    "r3_first_pass_intent",
    "r8_overrides",
    "x4_normalize",
    "w4_dual_cap",
    "w6_assemble_strata",
    "v3_dense_topk",
    "g2_gates",
    "v3_sparse_topk",
    "e7_weighted_kappa",
    "e5_e6_prevalence",
    "v6_near_dup_pairs",
    "v6_components",
    "corpus_job",
    "v9_text_classifier",       # the slowest query of the catalog
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from parley.plans.registry import QUERIES
    from parley.session import get_session
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * int(cpus)),
                        app_name="parley-bench")
    spark.read.parquet(os.path.join(sf_dir, "region.parquet")).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}))


if __name__ == "__main__":
    main()
