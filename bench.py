"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "k16_quota_selection",
    "n05_scale_quota_selection",
    "g07_cluster_values",
    "h01_average_rank",
    "i01_global_top_k",
    "k08_rds_plus",
    "k12_less",
    "g04_utilities",
    "g05_ranknorm",
    "g06_labels",
    "b01_exact_dedup",
    "b02_normalised_dedup",
    "b03_near_duplicates",
    "b06_gram_decontaminated_pool",
    "b09_nearest_neighbours",
    "c01_lengths",
    "c13_model_stats",
    "d04_sketch",
    "d08_coverage_triples",
    "e12_condition_vector",
    "g08_result_aggregate",
    "p03_kendall_tau",
    "t10_transfer_matrix",
]


def main() -> None:
    from siftwork.plans import all_queries
    from siftwork.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "siftwork-bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # session warm-up
    q = all_queries()
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
