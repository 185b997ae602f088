"""One JSON line: seconds of the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Each query runs ``RUNS`` times from the files, nothing cached between runs; its figure is the median (of two, their mean).
"""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

from tessera.plans.queries import QUERIES  # noqa: E402
from tessera.session import local_session  # noqa: E402

RUNS = 2
HEADLINE = (
    "corpus_stats",
    "inverted_list",
    "weight_pruned_graph",
    "similarity_graph",
    "threshold_sweep",
    "cluster_pairs",
    "cluster_overlap_graph",
    "cluster_feature_graph",
    "candidate_graph",
    "overlapping_cluster_graph",
    "filter_graph",
    "progressive_graph",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 16, **{"spark.driver.memory": "16g"})
    QUERIES["corpus_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(RUNS):
            spark.catalog.clearCache()
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.time() - began)
        took[name] = round(median(seconds), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
