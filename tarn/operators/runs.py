"""Workflow runs as an append-only table of events: (run_id, step, node, state, parent_run, at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = ["understanding", "retrieval", "generation", "validation", "persistence"]
MAX_REVISIONS = 1


def next_node(node: Column, valid: Column, passed: Column, revisions: Column) -> Column:
    """Where a run goes after ``node``: an invalid intake ends, a report that fails is written once more."""
    return (
        F.when((node == "understanding") & ~F.coalesce(valid, F.lit(False)), F.lit(None).cast("string"))
        .when(node == "understanding", "retrieval")
        .when(node == "retrieval", "generation")
        .when(node == "generation", "validation")
        .when((node == "validation") & ~F.coalesce(passed, F.lit(False)) & (revisions <= MAX_REVISIONS), "generation")
        .when(node == "validation", "persistence")
    )


def history(events: DataFrame, run_id: str) -> DataFrame:
    """A run's events, latest first."""
    return events.filter(F.col("run_id") == run_id).orderBy(F.desc("step"))


def current(events: DataFrame) -> DataFrame:
    """The latest event of each run."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("step", "node", "state", "parent_run", "at"), "step").alias("e")).select("run_id", "e.*")


def branch(events: DataFrame, run_id: str, step: int, new_run: str) -> DataFrame:
    """The events of a new run that begins as a copy of another one up to a step."""
    return events.filter((F.col("run_id") == run_id) & (F.col("step") <= step)).withColumns({"run_id": F.lit(new_run), "parent_run": F.lit(run_id)})


def observation(retrieved: DataFrame) -> DataFrame:
    """(run_id, chunk_count, top_score, top_bm25, top_embedding) of (run_id, score, bm25_score, embedding_score); absent scores are 0."""
    top = lambda c: F.coalesce(F.max(c), F.lit(0.0))
    return retrieved.groupBy("run_id").agg(F.count("*").alias("chunk_count"), top("score").alias("top_score"), top("bm25_score").alias("top_bm25"), top("embedding_score").alias("top_embedding"))


def pending(cases: DataFrame, completed: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases that no completed result has yet."""
    return cases.join(completed, key, "left_anti")
