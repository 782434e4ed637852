"""Merging ranked lists (query_id, key, method, score, rank): normalising, linear and reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions import fixed_values as V
from tarn.operators.retrieval import DIGITS, top_k


def normalize_scores(lists: DataFrame) -> DataFrame:
    """``normalized``: score over the best score of its query and method; 0 if that isn't positive."""
    best = F.max("score").over(Window.partitionBy("query_id", "method"))
    return lists.withColumn("normalized", F.when(best > 0, F.col("score") / best).otherwise(0.0))


def _place(methods: list[str] | None) -> Column:
    """Which list, in order, a row is of; without an order, by name."""
    return F.col("method") if methods is None else F.array_position(F.array(*map(F.lit, methods)), F.col("method"))


def _merged(lists: DataFrame, methods: list[str], attributes: tuple[str, ...] = (), scores: tuple[str, ...] = ("score", "rank")) -> list[Column]:
    """Aggregates of a result over its lists: scores and ranks by method, and of each attribute the first that isn't empty, in list order."""
    each = [F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}") for m in methods for c in scores]
    first = lambda c: F.min(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(_place(methods), F.col(c).alias("v"))))["v"].alias(c)
    return [*each, *map(first, attributes)]


def merge_ranked(lists: DataFrame, methods: list[str], attributes: tuple[str, ...] = ()) -> DataFrame:
    """A row for each query and key with ``<method>_score`` and ``<method>_rank``: a full outer merge in one aggregation.

    Of each attribute the first list that has one gives it.
    """
    return lists.groupBy("query_id", "key").agg(*_merged(lists, methods, attributes))


def linear_fusion(lists: DataFrame, weights: dict[str, float] = V.LINEAR_WEIGHTS, k: int = 5, methods: list[str] | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, key, score, rank): weighted sum of normalised scores, 0 where a method lacks the key.

    With ``methods`` also the scores, ranks and normalised scores of each list, ``sources`` in list order, and the attributes.
    """
    weight = F.coalesce(*[F.when(F.col("method") == m, F.lit(w)) for m, w in weights.items()], F.lit(0.0))
    total = F.round(F.sum(weight * F.col("normalized")), DIGITS)
    more = [_sources(methods), *_merged(lists, methods, attributes, ("score", "rank", "normalized"))] if methods else []
    return top_k(normalize_scores(lists).groupBy("query_id", "key").agg(total.alias("score"), *more), k, ["query_id"], ["key"])


def _sources(methods: list[str] | None) -> Column:
    return F.transform(F.array_sort(F.collect_set(F.struct(_place(methods).alias("at"), "method"))), lambda s: s["method"]).alias("sources")


def rrf_fusion(lists: DataFrame, methods: list[str] | None = None, rrf_k: int = V.RRF_K, k: int = 5, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, key, score, sources, <method>_score, <method>_rank, attributes, rank): sum of 1 / (rrf_k + rank); sources are in list order."""
    score = F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), DIGITS)
    fused = lists.groupBy("query_id", "key").agg(score.alias("score"), _sources(methods), *_merged(lists, methods or [], attributes))
    return top_k(fused, k, ["query_id"], ["key"])


def candidate_union(lists: DataFrame) -> DataFrame:
    """(query_id, key, best_rank, position): distinct candidates ordered by their best rank in any list."""
    best = lists.groupBy("query_id", "key").agg(F.min("rank").alias("best_rank"))
    return best.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank", "key")))


def candidate_overlap(lists: DataFrame, base: str, other: str) -> DataFrame:
    """(query_id, base, other, shared, added, jaccard): sizes of two candidate pools."""
    pools = lists.groupBy("query_id").agg(F.collect_set(F.when(F.col("method") == base, F.col("key"))).alias("a"), F.collect_set(F.when(F.col("method") == other, F.col("key"))).alias("b"))
    shared, whole = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return pools.select("query_id", F.size("a").alias(base), F.size("b").alias(other), shared.alias("shared"), F.size(F.array_except("b", "a")).alias("added"), F.when(whole > 0, F.round(shared / whole, DIGITS)).otherwise(0.0).alias("jaccard"))


def rank_change(before: DataFrame, after: DataFrame, cut: int = 5) -> DataFrame:
    """(query_id, key, before, after, change, moved): ranks in two lists of (query_id, key, rank); moved tells who enters or leaves the cut."""
    both = before.select("query_id", "key", F.col("rank").alias("before")).join(after.select("query_id", "key", F.col("rank").alias("after")), ["query_id", "key"], "full_outer")
    was, now = F.coalesce(F.col("before") <= cut, F.lit(False)), F.coalesce(F.col("after") <= cut, F.lit(False))
    return both.select("*", (F.col("after") - F.col("before")).alias("change"), F.when(was & ~now, "out").when(now & ~was, "in").otherwise("same").alias("moved"))
