"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldtrends.session import local_session  # noqa: E402
from fieldtrends.suite import load  # noqa: E402

# one per pipeline step: cleaning, tagging, masks, selection, sampling, model input, fit, resolution, classes, reports
HEADLINE = [
    "c04_list_length", "c14_completeness", "c15_vagrants_kept", "g01_tag_points", "g04_apply_mask", "q03_long_term_qualifiers",
    "q07_restricted_valid", "r02_replicates", "t05_compress", "t06_fixed_model", "t07_mixed_model", "o10_occupancy_model", "v02_combine_sims", "v05_ratio_interval",
    "v10_slope_interval", "v11_slope_sensitivity", "v13_combine_series", "c06_remove_mistakes", "o09_detection_history", "k08_priority_status", "m12_key_species", "m28_release_delta",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start executors and the file cache
    times = {}
    for name in HEADLINE:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
