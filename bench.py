"""Time the headline queries on ``$BENCH_SF_DIR`` and print one JSON line.

Each query runs twice: the first run includes planning and code generation for new
expressions, the second is the reported time. Results go to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from occupipe.plans import QUERIES
from occupipe.session import clear_scratch, local_session

HEADLINE = [
    "best_list_per_page",
    "extracted_tasks",
    "clean_final_documents",
    "flattened_records",
    "title_search",
    "similar_vectors",
    "stratified_split_skewed",
    "encode_labels",
    "others_fallback",
    "nested_result",
    "accuracy_by_code",
    "top_n_curve",
    "class_report",
    "titles_per_code",
    "encoded_tokens",
    "packed_blocks",
    "synonym_substitution",
    "augmented_rows",
    "cascade_scores",
    "stream_weekly_counts",
]


def timed(job) -> float:
    begun = time.perf_counter()
    job().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in chosen:
        job = lambda: QUERIES[name](spark, folder)
        cold[name] = round(timed(job), 3)
        warm[name] = round(timed(job), 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
