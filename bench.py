"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codeloom.plans.catalog import REGISTRY
from codeloom.session import build_session

HEADLINE = [
    "ingest_clean", "ingest_metadata", "ingest_report", "label_counts", "open_codes", "resume_pending", "response_extract",
    "coding_valid", "category_valid", "axial_valid", "label_pairs_sparse", "vector_pairs", "merge_vectors_030", "merge_vectors_090",
    "merge_labels", "enrich_insights", "evidence_by_category", "evidence_text", "evidence_parts", "lineage", "categories_by_name",
    "best_fit_keywords", "best_fit_vectors", "code_batches", "prompt_coding", "prompt_axial", "full_narrative", "corpus_text",
    "narrative_blocks", "cluster_rollup", "study_run", "stream_resume",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "codeloom-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the executors and file listing
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
