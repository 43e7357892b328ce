"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query is run once to
warm up the session's code paths on the smallest data set beside the given one, then timed once on the given data, with a
sink that takes every column and stores nothing. BENCH_QUERIES limits the list.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pixelweave.plans.catalog import full_catalog
from pixelweave.session import build_session

HEADLINE = ("pq", "compute_metrics", "benchmark_per_type", "confusion_matrix", "dice_loss", "label", "fix_duplicates", "remove_debris",
            "instance_table", "majority_type", "hover_maps", "opening_once", "contours", "distance_map", "percentile_normalize", "dataset_mean_std",
            "niblack_mask", "gaussian_filter", "ssim", "extract_patches", "stitch_mean", "rasterize", "paint_instances", "split_pairs", "merge_cells", "outline", "follow_flows")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or list(HEADLINE)
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = full_catalog().queries
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    run(queries["pq"](spark, small if os.path.isdir(small) else sf_dir))
    run(queries["label"](spark, small if os.path.isdir(small) else sf_dir))
    seconds = {}
    for name in names:
        start = time.time()
        run(queries[name](spark, sf_dir))
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
