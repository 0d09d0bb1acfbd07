"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; its value is the median. Results go to the
``noop`` sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docquarry.plans import catalog  # noqa: E402
from docquarry.session import build_session  # noqa: E402

HEADLINES = (
    "content_hash",
    "html_text",
    "html_headings",
    "markdown_headings",
    "char_windows",
    "token_windows",
    "recursive_split",
    "markdown_sections",
    "split_documents",
    "nearest_heading",
    "dedup_exact",
    "incremental_chunks",
    "reindex_diff",
    "hash_embedding",
    "embedding_cache",
    "topk_l2",
    "topk_cosine",
    "topk_text",
    "bm25_topk",
    "term_weights",
    "keyword_rerank",
    "rrf_fusion",
    "pack_context",
    "extract_citations",
    "search_terms_and",
    "source_chunk_counts",
    "ordered_chunks",
    "ir_metrics",
    "stored_round_trip",
    "answer_questions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINES
    spark = build_session(
        "docquarry-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__driver__host="127.0.0.1",
    )
    known, _ = catalog.load()
    medians = {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        medians[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {medians[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of warm medians",
                "value": round(sum(medians.values()), 3),
                "unit": "sec",
                "queries": medians,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
