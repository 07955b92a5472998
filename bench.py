"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then BENCH_RUNS times into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from shelfwise.session import local_session  # noqa: E402

HEADLINES = [
    "session_features",
    "trending",
    "coldstart_clusters",
    "basket_rules",
    "cart_recommend",
    "content_neighbors",
    "vector_topk",
    "bias_scores",
    "eval_f1",
    "weight_sweep",
    "knn_baseline",
    "slope_one",
    "session_recommend",
    "coldstart_recommend",
    "name_similarity",
    "sample_fraction",
]


def seconds(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "shelfwise-bench")
    names = sys.argv[1:] or HEADLINES
    out = {}
    for name in names:
        seconds(spark, sf, name)
        out[name] = round(statistics.median(seconds(spark, sf, name) for _ in range(runs)), 3)
        print(name, out[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total seconds over headline queries",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "sf": os.path.basename(sf.rstrip("/")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
