"""The retrieval pipeline: retrievers by name, fused by rank, optionally reranked.

A retriever is a function of (queries, k) that returns ranked rows (query_id, key, score, rank) with any attributes of the
results; queries are a table of query_id and what the retrievers read. All queries go through each step at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import fixed_values as V
from tarn.operators import fusion
from tarn.operators.retrieval import top_k

Retriever = Callable[[DataFrame, int], DataFrame]

MODES = ("hybrid", "hybrid_rerank")
#: Candidates that a list gives for each result wanted, at least so many, and those of the production pipeline.
CANDIDATES_EACH, LEAST_CANDIDATES, SOURCE_K = 5, 25, 100
#: Attributes of a result that a later list fills in where the earlier one has none.
ATTRIBUTES = ("chapter_id", "section_id", "chapter_number", "section_number", "summary")


def result_key(source: Column, chunk_index: Column) -> Column:
    """``source:chunk_index``, or the source alone."""
    source = F.coalesce(source, F.lit(""))
    return F.when(chunk_index.isNotNull(), F.concat_ws(":", source, chunk_index.cast("string"))).otherwise(source)


def candidates_for(k: int) -> int:
    return max(CANDIDATES_EACH * k, LEAST_CANDIDATES)


def ranked_lists(retrievers: dict[str, Retriever], queries: DataFrame, k: int) -> DataFrame:
    """The lists of all retrievers, as (query_id, key, method, score, rank, attributes)."""
    out = None
    for name, retriever in retrievers.items():
        rows = retriever(queries, k)
        there = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ATTRIBUTES]
        rows = rows.select("query_id", "key", F.lit(name).alias("method"), "score", "rank", *there)
        out = rows if out is None else out.unionByName(rows)
    return out


def grid(methods: dict[str, Retriever], queries: DataFrame, k: int) -> DataFrame:
    """Every query by every method: (query_id, key, method, method_order, score, rank), for a benchmark of methods in order."""
    order = F.array_position(F.array(*map(F.lit, methods)), F.col("method")) - 1
    return ranked_lists(methods, queries, k).drop(*ATTRIBUTES).withColumn("method_order", order.cast("int"))


def with_numbers(results: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Display numbers from ids (``ch03`` is 03, ``s01`` 01) and summaries (source, summary) by key, where there are none yet."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    out = results.withColumn("chapter_number", F.coalesce(filled("chapter_number"), F.regexp_replace("chapter_id", "^ch", "")))
    out = out.withColumn("section_number", F.coalesce(filled("section_number"), F.regexp_replace("section_id", "^s", "")))
    if summaries is None:
        return out
    found = summaries.select(F.col("source").alias("key"), F.col("summary").alias("__summary"))
    return out.join(found, "key", "left").withColumn("summary", F.coalesce(filled("summary"), "__summary")).drop("__summary")


def _label(methods: list[str], several: str) -> Column:
    """Which lists a result comes from, as one word."""
    one = F.coalesce(*[F.when(F.col(f"{m}_rank").isNotNull(), F.lit("keyword" if m == "bm25" else m)) for m in reversed(methods)])
    return F.when(F.size("sources") > 1, several).otherwise(one)


def rrf(retrievers: dict[str, Retriever], queries: DataFrame, k: int = 5, source_k: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion with the scores and ranks of each list, its attributes and ``retrieval_method``."""
    methods = list(retrievers)
    lists = ranked_lists(retrievers, queries, source_k or candidates_for(k))
    best = fusion.rrf_fusion(lists, methods, k=k, attributes=ATTRIBUTES)
    return with_numbers(best.withColumn("retrieval_method", _label(methods, "hybrid_rrf")))


def linear(retrievers: dict[str, Retriever], queries: DataFrame, k: int = 5, source_k: int | None = None, weights: dict[str, float] = V.LINEAR_WEIGHTS) -> DataFrame:
    """Weighted sum of normalised scores, with ``retrieval_method``."""
    methods = list(retrievers)
    lists = ranked_lists(retrievers, queries, source_k or candidates_for(k))
    best = fusion.linear_fusion(lists, weights, k, methods, ATTRIBUTES)
    return best.withColumn("retrieval_method", _label(methods, "hybrid"))


def retrieve(
    retrievers: dict[str, Retriever],
    queries: DataFrame,
    mode: str = "hybrid",
    final_k: int = 5,
    source_k: int | None = None,
    candidate_k: int | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
    fuse: Callable[..., DataFrame] = rrf,
) -> DataFrame:
    """The pipeline: ``hybrid`` fuses the lists, ``hybrid_rerank`` orders the best candidates by ``score``.

    ``score`` adds a column rerank_score to candidates (query_id, key, ...); ``fuse`` may replace the fusion. No result is
    wanted of a k of 0 or less.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if final_k <= 0:
        return retrieve(retrievers, queries, mode, 1, 1, 1, score, fuse).limit(0)
    if mode == "hybrid":
        return fuse(retrievers, queries, final_k, source_k or SOURCE_K)
    if score is None:
        raise ValueError("hybrid_rerank needs a score")
    candidates = fuse(retrievers, queries, candidates_for(final_k) if candidate_k is None else candidate_k, source_k or SOURCE_K).drop("rank")
    best = top_k(score(candidates), final_k, ["query_id"], ["key"], "rerank_score")
    return best.withColumns({"score": F.col("rerank_score").cast("double"), "retrieval_method": F.lit("hybrid_rerank")})


def observation(results: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, status, chunk_count, top_score, top_embedding_score, chunks): what a retrieval gave, with a record for each result."""
    have = set(results.columns)
    score = lambda *names: F.coalesce(*[F.col(n).cast("double") for n in names if n in have], F.lit(0.0))
    plain = lambda n, t: (F.col(n) if n in have else F.lit(None)).cast(t)
    item = F.struct(
        plain("rank", "int").alias("rank"), plain("retrieval_method", "string").alias("retrieval_method"),
        score("bm25_score", "keyword_score").alias("bm25_score"), score("embedding_cosine_score", "embedding_score").alias("embedding_cosine_score"),
        score("normalized_bm25_score", "normalized_keyword_score").alias("normalized_bm25_score"),
        score("normalized_embedding_cosine_score", "normalized_embedding_score").alias("normalized_embedding_cosine_score"),
        plain("hybrid_score", "double").alias("hybrid_score"), plain("rrf_score", "double").alias("rrf_score"),
        plain("bm25_rank", "int").alias("keyword_rank"), plain("embedding_rank", "int").alias("embedding_rank"),
    )
    rows = results.select(by, score("score").alias("s"), score("embedding_score").alias("e"), item.alias("item"))
    grouped = rows.groupBy(by).agg(F.count("*").alias("chunk_count"), F.max("s").alias("top_score"), F.max("e").alias("top_embedding_score"), F.array_sort(F.collect_list("item")).alias("chunks"))
    return grouped.select(by, F.lit("observation").alias("status"), "chunk_count", "top_score", "top_embedding_score", "chunks")
