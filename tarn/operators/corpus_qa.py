"""Integrity checks of a corpus and parity with a golden one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def corpus_issues(manifest: DataFrame, loaded: DataFrame, metadata: DataFrame) -> DataFrame:
    """(issue, key): missing and unloaded paths, repeated ids, metadata without chunk and chunks without metadata, counts that differ.

    manifest: (source_id, path, char_count); loaded: (path, content); metadata: (source_id).
    """
    row = lambda df, issue, key: df.select(F.lit(issue).alias("issue"), F.col(key).cast("string").alias("key"))
    paths, ids = manifest.filter("path is not null"), metadata.select("source_id")
    counted = paths.join(loaded.select("path", F.length("content").alias("n")), "path")
    checks = [
        row(manifest.filter("path is null"), "no_path", "source_id"),
        row(paths.join(loaded, "path", "left_anti"), "not_loaded", "path"),
        row(loaded.join(paths, "path", "left_anti"), "not_in_manifest", "path"),
        row(duplicates(manifest, "source_id"), "repeated_source_id", "source_id"),
        row(duplicates(ids, "source_id"), "repeated_metadata", "source_id"),
        row(ids.join(manifest, "source_id", "left_anti").distinct(), "orphan_metadata", "source_id"),
        row(manifest.join(ids, "source_id", "left_anti"), "missing_metadata", "source_id"),
        row(counted.filter(~F.col("n").eqNullSafe(F.col("char_count"))), "char_count_differs", "path"),
    ]
    return reduce(DataFrame.unionByName, checks)


def parity(generated: DataFrame, golden: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, differing): ``missing``, ``extra``, ``differs`` (with the fields) or ``same`` for each key of either side."""
    g, h = (df.select(F.col(key), F.struct(*fields).alias(side)) for df, side in ((generated, "g"), (golden, "h")))
    both = g.join(h, key, "full_outer")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"g.{f}").eqNullSafe(F.col(f"h.{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("g").isNull(), "missing").when(F.col("h").isNull(), "extra").when(F.size(differing) > 0, "differs").otherwise("same")
    return both.select(key, status.alias("status"), F.when(F.col("g").isNotNull() & F.col("h").isNotNull(), differing).otherwise(F.array().cast("array<string>")).alias("differing"))


def latest(df: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The latest row of each key: what an upsert by key leaves."""
    newest = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(t) for t in ties])
    return df.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def evidence_of(cases: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(case_id, evidence, text): half-open paragraph ranges [start, end) of sections, joined by blank lines.

    cases: (case_id, expected array<struct<chapter_id, section_id, start, end>>); paragraphs: (chapter_id, section_id, paragraphs array<string>).
    Ranges outside of a section raise when read.
    """
    each = cases.select("case_id", F.posexplode("expected").alias("evidence", "e")).select("case_id", "evidence", "e.*")
    joined = each.join(paragraphs, ["chapter_id", "section_id"], "left")
    valid = F.col("paragraphs").isNotNull() & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.size("paragraphs"))
    text = F.array_join(F.slice("paragraphs", F.col("start") + 1, F.col("end") - F.col("start")), "\n\n")
    return joined.select("case_id", "evidence", F.when(valid, text).otherwise(F.raise_error(F.concat(F.lit("no such evidence: "), F.col("case_id").cast("string")))).alias("text"))
