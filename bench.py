"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarn.operators import index  # noqa: E402
from tarn.plans import registry, retrieval  # noqa: E402
from tarn.session import local_session  # noqa: E402

HEADLINE = [
    "keyword_topk", "vector_topk", "retrieval_metrics", "metrics_grouping_sets", "strategy_delta",
    "chunk_fixed", "chunk_recursive", "chunk_section_raw", "chunk_section_based", "chunk_section_semantic_overlap", "chunk_diagnostics", "tokenize_docs", "term_stats",
    "evidence_match", "evidence_coverage", "report_quality", "json_recovery", "corpus_issues", "parity", "route_problem",
]
#: Searches of stored BM25 indexes, by index; building those is timed apart.
INDEXED = {
    "base": {"bm25_topk": retrieval.bm25_list, "linear_fusion": retrieval.linear, "rrf_fusion": retrieval.rrf, "two_stage_topk": retrieval.two_stage},
    "weighted": {"bm25_weighted_topk": retrieval.bm25_list},
    "with_vectors": {"hybrid_topk": retrieval.hybrid_topk, "hybrid_linear_topk": retrieval.hybrid_linear},
}
#: Runs of each query, the median of which counts, after one that starts workers and compiles; longer queries run once.
RUNS, ONCE_OVER = 3, 5


def timed(run) -> float:
    begun = time.time()
    run().write.format("noop").mode("overwrite").save()
    return time.time() - begun


def measured(run) -> float:
    first = timed(run)
    return round(first if first > ONCE_OVER else statistics.median(timed(run) for _ in range(RUNS)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tarn-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds, folder = registry.queries(), {}, tempfile.mkdtemp(prefix="tarn-bench-")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()  # start the workers
    for name, searches in INDEXED.items():
        docs = retrieval._vector_texts(spark, sf_dir) if name == "with_vectors" else retrieval._docs(spark, sf_dir)
        begun = time.time()
        index.write_bm25_index(docs, f"{folder}/{name}", doc_text=retrieval.document_text("weighted" if name == "weighted" else "base"))
        seconds[f"index_build_{name}"] = round(time.time() - begun, 3)
        stored = index.read_bm25_index(spark, f"{folder}/{name}").cache()
        for query, run in searches.items():
            seconds[query] = measured(lambda run=run, stored=stored: run(spark, sf_dir, stored=stored))
        stored.reset()
    for name in HEADLINE:
        seconds[name] = measured(lambda name=name: queries[name](spark, sf_dir))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
