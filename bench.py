"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quizloom.plans import registered
from quizloom.session import build_session

HEADLINE = [
    "set_metrics",
    "semantic_uniqueness",
    "bank_statistics",
    "rule_engine",
    "stage_chain",
    "quality_pass",
    "exact_duplicates",
    "cosine_duplicates",
    "semantic_duplicates",
    "vector_top_k_filtered",
    "retrieval",
    "answer_leaks",
    "quota_acceptance",
    "answer_position_enforcement",
    "set_allocation",
    "answer_key",
    "set_documents",
    "tagged_sections",
    "question_chunks",
    "recursive_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", cores)
    queries = registered.queries()
    # One small query starts the workers and the code generator; it is not counted.
    queries["set_listing"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
