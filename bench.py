"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from millrace.plans import catalog
from millrace.session import get_spark

HEADLINE = [
    "top_items_by_count",
    "top_items_by_mean",
    "doc_freq",
    "term_freq",
    "tfidf_weights",
    "postings",
    "search_topk",
    "search_hydrate",
    "minhash_sig",
    "lsh_candidates",
    "lsh_pairs",
    "jaccard_pairs",
    "lsh_quality",
    "ffill",
    "grid_fill",
    "interpolate",
    "daily_bars",
    "sliding_windows",
    "lag_mae",
    "prefix_rates",
    "ledger_replay",
    "kmeans1d",
    "cluster_sse",
    "page_links",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total_headline_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
