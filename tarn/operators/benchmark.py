"""Benchmarks of retrieval methods: every method over all cases, its metrics, its records and its time a query."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import evaluation as E
from tarn.operators import hybrid, judging


@dataclass
class Benchmark:
    """results (method, method_order, case_id, metric, value), lists (case_id, key, method, method_order, score, rank), and milliseconds a query by method."""

    results: DataFrame
    lists: DataFrame
    milliseconds: dict[str, float] = field(default_factory=dict)

    def summary(self, dimensions: DataFrame | None = None) -> DataFrame:
        """Means over all cases and for each value of each column of ``dimensions`` (case_id, ...)."""
        if dimensions is None:
            return E.summarize(self.results, [])
        names = [c for c in dimensions.columns if c != "case_id"]
        return E.summarize(self.results.join(dimensions, "case_id"), names)

    def best(self) -> DataFrame:
        means = self.results.groupBy("method", "method_order", "metric").agg(F.round(F.avg("value"), 6).alias("mean"))
        return E.best_method(means)

    def deltas(self, base: str) -> DataFrame:
        return E.paired_delta(self.results, base)

    def records(self, config: dict[str, object]) -> DataFrame:
        """(case_id, method, config, results): each case's results under each method, with the run's settings and times."""
        out = None
        for method in [r["method"] for r in self.lists.select("method", "method_order").distinct().orderBy("method_order").collect()]:  # a row for each method
            settings = {**config, "milliseconds": self.milliseconds.get(method, 0.0)}
            rows = judging.case_records(self.lists.filter(F.col("method") == method).select("case_id", "key", "score", "rank"), settings, "case_id")
            rows = rows.select("case_id", F.lit(method).alias("method"), "config", "results")
            out = rows if out is None else out.unionByName(rows)
        return out


def results_of(lists: DataFrame, cases: DataFrame, matches: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(method, method_order, case_id, metric, value): the metrics of lists (case_id, key, method, method_order, rank), each method over all cases."""
    methods = lists.select("method", "method_order").distinct()
    every = cases.crossJoin(F.broadcast(methods.limit(1000)))  # a row for each method
    by = ["method", "method_order", "case_id"]
    return E.hits_to_metrics(every, lists.select(*by, "rank"), lists.join(matches, ["case_id", "key"]).select(*by, "rank", "evidence"), ks, by)


def run(methods: dict[str, hybrid.Retriever], queries: DataFrame, cases: DataFrame, matches: DataFrame, k: int = 20, ks: tuple[int, ...] = (1, 3, 5)) -> Benchmark:
    """Run every method over queries (query_id, ...), one after the other, and hold its lists in memory.

    cases: (case_id, n_evidence), matches: (case_id, key, evidence). All queries of a method go through together, so the time is the
    mean of a batch. ``lists.unpersist()`` frees them.
    """
    n, spent, parts = queries.count(), {}, []
    for name, retriever in methods.items():
        begun = time.perf_counter()
        found = retriever(queries, k).select("query_id", "key", "score", "rank").cache()
        found.count()
        spent[name] = round(1000 * (time.perf_counter() - begun) / max(1, n), 3)
        parts.append((name, found))
    lists = hybrid.grid({name: lambda q, k, found=found: found for name, found in parts}, queries, k).withColumnRenamed("query_id", "case_id").cache()
    lists.count()
    for _, found in parts:
        found.unpersist()
    return Benchmark(results_of(lists, cases, matches, ks), lists, spent)
