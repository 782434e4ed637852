"""Information-retrieval metrics over (case_id, rank, evidence matches), and experiment summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType
from pyspark.sql.window import Window

from tarn.functions.text import evidence_units, normalize_evidence
from tarn.operators.retrieval import DIGITS


def hits_to_metrics(cases: DataFrame, ranked: DataFrame, matches: DataFrame, ks: tuple[int, ...] = (1, 3, 5), by: list[str] = ["case_id"]) -> DataFrame:  # noqa: B006
    """Long (by..., metric, value).

    cases: (by..., n_evidence); ranked: (by..., rank); matches: (by..., rank, evidence), a row for each evidence that a result holds.
    ``recall_ref`` is 0 if fewer than k results came back, ``recall`` isn't. An evidence gains at the first rank that holds it.
    """
    returned = ranked.groupBy(*by).agg(F.max("rank").alias("returned"))
    first = matches.groupBy(*by, "evidence").agg(F.min("rank").alias("rank"))
    gains = first.groupBy(*by).agg(F.collect_list("rank").alias("first_ranks"))
    relevant = matches.groupBy(*by).agg(F.array_sort(F.collect_set("rank")).alias("relevant"))
    none = F.array().cast("array<int>")
    rows = cases.join(returned, by, "left").join(gains, by, "left").join(relevant, by, "left")
    rows = rows.withColumns({"returned": F.coalesce("returned", F.lit(0)), "first_ranks": F.coalesce(F.col("first_ranks").cast("array<int>"), none), "relevant": F.coalesce(F.col("relevant").cast("array<int>"), none)})
    value = {}
    for k in ks:
        within = lambda column, k=k: F.filter(column, lambda r: r <= k)
        share = lambda n: F.when(F.col("n_evidence") > 0, n / F.col("n_evidence")).otherwise(0.0)
        covered = F.size(within("first_ranks")).cast("double")
        dcg = F.aggregate(F.array_distinct(within("first_ranks")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r.cast("double") + 1))
        ideal = F.least(F.col("n_evidence"), F.lit(k)).cast("int")
        idcg = F.aggregate(F.when(ideal > 0, F.sequence(F.lit(1), ideal)).otherwise(none), F.lit(0.0), lambda s, r: s + 1 / F.log2(r.cast("double") + 1))
        value[f"hit@{k}"] = (F.size(within("relevant")) > 0).cast("double")
        value[f"precision@{k}"] = F.size(within("relevant")) / k
        value[f"recall@{k}"] = share(covered)
        value[f"recall_ref@{k}"] = F.when(F.col("returned") >= k, share(covered)).otherwise(0.0)
        value[f"ndcg@{k}"] = F.when(idcg > 0, dcg / idcg).otherwise(0.0)
    first_rank = F.get("relevant", F.lit(0))
    value["mrr"] = F.coalesce(1 / first_rank, F.lit(0.0))
    value["mrr@5"] = F.when(first_rank <= 5, 1 / first_rank).otherwise(0.0)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(v, DIGITS).alias("value")) for m, v in value.items()])
    return rows.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")


def candidate_coverage(lists: DataFrame, matches: DataFrame, limits: tuple[int, ...] = (20, 50)) -> DataFrame:
    """(case_id, list, limit, covered): distinct evidence among the first ``limit`` of each list and of their union in order of best rank.

    lists: (case_id, key, method, rank); matches: (case_id, key, evidence), a row for each evidence that a result holds.
    """
    best = lists.groupBy("case_id", "key").agg(F.min("rank").alias("best"), F.min(F.struct("rank", "method"))["method"].alias("of"))
    union = best.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("best", "of", "key"))).select("case_id", "key", F.lit("union").alias("method"), "rank")
    every = lists.select("case_id", "key", "method", "rank").unionByName(union)
    held = every.join(matches, ["case_id", "key"], "left").groupBy("case_id", "method")
    counts = held.agg(*[F.count_distinct(F.when(F.col("rank") <= n, F.col("evidence"))).alias(str(n)) for n in limits])
    pairs = F.array(*[F.struct(F.lit(n).alias("limit"), F.col(str(n)).alias("covered")) for n in limits])
    return counts.select("case_id", F.col("method").alias("list"), F.explode(pairs).alias("p")).select("case_id", "list", "p.limit", "p.covered")


def candidate_pool(cases: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """(case_id, candidate_pool_hit, candidate_pool_recall) of cases (case_id, n_evidence): whether any candidate (case_id, key) is relevant and the share of evidence that they hold."""
    held = candidates.select("case_id", "key").distinct().join(matches, ["case_id", "key"]).groupBy("case_id").agg(F.count_distinct("evidence").alias("held"))
    share = F.when(F.col("n_evidence") > 0, F.coalesce("held", F.lit(0)) / F.col("n_evidence")).otherwise(0.0)
    return cases.join(held, "case_id", "left").select("case_id", (F.coalesce("held", F.lit(0)) > 0).cast("double").alias("candidate_pool_hit"), F.round(share, DIGITS).alias("candidate_pool_recall"))


def summarize(results: DataFrame, dimensions: list[str]) -> DataFrame:
    """Mean of each metric by method, over all cases and for each value of each dimension: grouping sets in one pass."""
    sets = [["method", "metric"], *[["method", "metric", d] for d in dimensions]]
    grouped = results.groupingSets([[F.col(c) for c in s] for s in sets], F.col("method"), F.col("metric"), *map(F.col, dimensions))
    return grouped.agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("cases"))


def distribution(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, extremes and count of ``value``."""
    return results.groupBy(*by).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


def best_method(summary: DataFrame, order: str = "method_order") -> DataFrame:
    """(metric, best, value): the method of highest mean, the first in order on ties."""
    return summary.groupBy("metric").agg(F.max_by("method", F.struct("mean", -F.col(order))).alias("best"), F.max("mean").alias("value"))


def paired_delta(results: DataFrame, base: str) -> DataFrame:
    """(method, metric, mean_delta, better, worse, cases): each method against ``base`` on the same case."""
    b = results.filter(F.col("method") == base).select("case_id", "metric", F.col("value").alias("base"))
    d = results.filter(F.col("method") != base).join(b, ["case_id", "metric"]).withColumn("delta", F.col("value") - F.col("base"))
    return d.groupBy("method", "metric").agg(F.round(F.avg("delta"), 6).alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("better"), F.count_if(F.col("delta") < 0).alias("worse"), F.count("*").alias("cases"))


@F.pandas_udf(LongType())
def overlap_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest end of ``left`` that begins ``right``; ``text.adjacent_overlap`` says the same in column functions, for short texts."""
    return pd.Series([_overlap(a, b) for a, b in zip(left, right, strict=True)], dtype="int64")


def _overlap(left: str, right: str) -> int:
    if not right:
        return 0
    at = left.find(right[0], max(0, len(left) - len(right)))
    while at >= 0 and not right.startswith(left[at:]):
        at = left.find(right[0], at + 1)
    return len(left) - at if at >= 0 else 0


def chunk_diagnostics(chunks: DataFrame, content: str = "content", order: tuple[str, ...] = ("doc_id", "chunk_index"), by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, lengths and exact overlap of neighbours, one row for each ``by``; the overlap is of neighbours of the same first order column."""
    before = F.lag(content).over(Window.partitionBy(order[0], *by).orderBy(*order[1:]))
    rows = chunks.select(*by, F.length(content).alias("n"), F.coalesce(before, F.lit("")).alias("__before"), F.col(content).alias("__content"))
    rows = rows.select(*by, "n", overlap_length("__before", "__content").alias("overlap"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("chunk_count"),
        F.round(F.avg("n"), 6).alias("mean_length"),
        F.round(F.median("n"), 6).alias("median_length"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long").alias("p95_length"),
        F.min("n").cast("long").alias("min_length"),
        F.max("n").cast("long").alias("max_length"),
        F.sum("n").alias("total_chars"),
        F.sum("overlap").alias("overlap_chars"),
        F.round(F.sum("overlap") / F.sum("n"), 6).alias("overlap_ratio"),
    )


@F.pandas_udf(ArrayType(IntegerType()))
def spots(text: pd.Series, needle: pd.Series) -> pd.Series:
    """Offsets of all occurrences of a needle that isn't empty, overlapping ones too."""
    return pd.Series([_spots(t, n) for t, n in zip(text, needle, strict=True)])


def _spots(text: str, needle: str) -> list[int]:
    out, at = [], text.find(needle)
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + 1)
    return out


def _covered(ranges: DataFrame, by: list[str]) -> DataFrame:
    """(by, covered): how many positions the ranges (by, start, stop) hold, each counted once."""
    before = F.max("stop").over(Window.partitionBy(*by).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.col("start"))))
    return ranges.withColumn("new", new).groupBy(*by).agg(F.sum("new").alias("covered"))


def evidence_coverage(ranked: DataFrame, gold: DataFrame, k: int, compose: bool = True) -> DataFrame:
    """(case_id, coverage, density) of ranked (case_id, rank, content) and gold (case_id, evidence, text) at rank k.

    Coverage is the share of gold characters that results hold, each counted once; density the share of the results' characters
    that match gold. Both are of normalised texts; evidence matches as a whole or by its sentences. Matches are ranges of
    positions, a row each, and the ranges of one text are counted by a running end. Needles and contents meet by case.
    """
    norm = lambda c: normalize_evidence(F.col(c), compose)
    contents = ranked.filter(F.col("rank") <= k).select("case_id", "rank", norm("content").alias("c"))
    wanted = gold.select("case_id", norm("text").alias("n"), evidence_units(F.col("text")).alias("units")).filter("n <> ''")
    units = wanted.select("case_id", "n", F.explode("units").alias("u")).select("case_id", "n", norm("u").alias("needle")).filter("needle <> ''")
    needles = units.unionByName(wanted.select("case_id", "n", F.col("n").alias("needle"))).distinct()
    found = contents.join(needles, "case_id").filter(F.contains("c", "needle")).select("case_id", "n", "needle", "rank", "c")
    ranges = lambda rows, text, by: rows.select(*by, "needle", F.explode(spots(text, "needle")).alias("start")).withColumn("stop", F.col("start") + F.length("needle"))
    shared = _covered(ranges(found, "c", ["case_id", "n", "rank"]), ["case_id", "n", "rank"]).groupBy("case_id").agg(F.sum("covered").alias("shared"))
    mine = _covered(ranges(found.select("case_id", "n", "needle").distinct(), "n", ["case_id", "n"]), ["case_id", "n"]).groupBy("case_id").agg(F.sum("covered").alias("covered"))
    total = wanted.select("case_id", "n").distinct().groupBy("case_id").agg(F.sum(F.length("n")).alias("total"))
    chars = contents.groupBy("case_id").agg(F.sum(F.length("c")).alias("chars"))
    rows = gold.select("case_id").distinct().join(total, "case_id", "left").join(chars, "case_id", "left").join(mine, "case_id", "left").join(shared, "case_id", "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.coalesce(a, F.lit(0)) / F.col(b), DIGITS)).otherwise(0.0).alias
    return rows.select("case_id", share("covered", "total")("coverage"), share("shared", "chars")("density"))
