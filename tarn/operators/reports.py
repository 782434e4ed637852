"""Report sections from model output: parsing, recovery, validation, sources, and generation by dependency level."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tarn.functions import fixed_values as V
from tarn.functions import json_sections as J
from tarn.functions.rules import assemble_section, section_issues

SENTENCES = ArrayType(StructType([StructField("text", StringType()), StructField("source_items", ArrayType(IntegerType()))]))
_PARSED = StructType([StructField("sentences", SENTENCES), StructField("success", BooleanType()), StructField("method", StringType()), StructField("actions", ArrayType(StringType()))])


@F.pandas_udf(_PARSED)
def recovered(raw: pd.Series) -> pd.DataFrame:
    """Sentences, success, method and actions of deterministic recovery."""
    found = [J.recover(x) for x in raw]
    return pd.DataFrame({"sentences": [r.sentences for r in found], "success": [r.success for r in found], "method": [r.method for r in found], "actions": [r.actions for r in found]})


@F.pandas_udf(SENTENCES)
def strictly_parsed(raw: pd.Series) -> pd.Series:
    """Sentences of text that keeps the exact contract, else null."""
    return raw.map(J.parse_strict)


def parse_sections(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """The input with sentences, content, source_items and the parse metrics: strict parsing, then recovery, then the final state."""
    rows = raw.withColumn("__strict", strictly_parsed(raw_col)).withColumn("__found", F.when(F.col("__strict").isNull(), recovered(raw_col)))
    recovered_ok = F.coalesce(F.col("__found.success"), F.lit(False))
    rows = rows.withColumn("sentences", F.coalesce("__strict", F.when(recovered_ok, F.col("__found.sentences")), F.array().cast(SENTENCES)))
    whole = assemble_section(F.col("sentences"))
    return rows.select(
        *raw.columns,
        "sentences",
        whole["content"].alias("content"),
        whole["source_items"].alias("source_items"),
        F.col("__strict").isNotNull().alias("initial_parse_success"),
        (F.col("__strict").isNotNull() | recovered_ok).alias("final_parse_success"),
        F.col("__strict").isNull().alias("recovery_attempted"),
        recovered_ok.alias("recovery_success"),
        F.col("__found.method").alias("recovery_method"),
        F.coalesce(F.col("__found.actions"), F.array().cast("array<string>")).alias("recovery_actions"),
    )


def validate_report(runs: DataFrame, sections: DataFrame) -> DataFrame:
    """(run_id, passed, issues, failed_sections) of runs (run_id, n_retrieved) and sections (run_id, section, content, source_items, done_reason, final_parse_success)."""
    order = F.array(*map(F.lit, V.SECTIONS))
    wanted = runs.select("run_id", "n_retrieved", F.posexplode(order).alias("at", "section"))
    rows = wanted.join(sections.withColumn("__there", F.lit(True)), ["run_id", "section"], "left")
    issues = section_issues(F.col("section"), F.coalesce("__there", F.lit(False)), F.col("content"), F.col("source_items"), F.col("n_retrieved"), F.col("done_reason"), F.col("final_parse_success"))
    four = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("at", "section", issues.alias("issues")))).alias("s"))  # the sections of one run
    all_issues = F.flatten(F.transform("s", lambda x: x["issues"]))
    failed = F.transform(F.filter("s", lambda x: F.size(x["issues"]) > 0), lambda x: x["section"])
    return four.select("run_id", (F.size(all_issues) == 0).alias("passed"), all_issues.alias("issues"), failed.alias("failed_sections"))


def resolve_sources(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(run_id, section, position, chapter_number, section_number, summary): cited items by number, one for each chapter and section title.

    cited: (run_id, section, source_items); retrieved: (run_id, rank, chapter_title, section_title, chapter_number, section_number, summary).
    The first citation sets place and numbers, the first summary that isn't empty the summary.
    """
    items = cited.select("run_id", "section", F.posexplode("source_items").alias("at", "rank"))
    joined = items.join(retrieved, ["run_id", "rank"])
    title = lambda c: F.coalesce(c, F.lit("")).alias(c)
    summary = F.nullif(F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit(""))
    grouped = joined.groupBy("run_id", "section", title("chapter_title"), title("section_title")).agg(
        F.min(F.struct("at", F.coalesce("chapter_number", F.lit("-")).alias("c"), F.coalesce("section_number", F.lit("-")).alias("s"))).alias("first"),
        F.min(F.when(summary.isNotNull(), F.struct("at", summary.alias("summary")))).alias("said"),
    )
    place = F.row_number().over(Window.partitionBy("run_id", "section").orderBy("first.at"))
    return grouped.select("run_id", "section", place.alias("position"), F.col("first.c").alias("chapter_number"), F.col("first.s").alias("section_number"), F.coalesce(F.col("said.summary"), F.lit("")).alias("summary"))


def generate(requests: DataFrame, llm: Callable[[Column, Column], Column], only: list[str] | None = None, kept: DataFrame | None = None) -> DataFrame:
    """(run_id, section, raw): sections written by ``llm`` (a column function of section and prompt), one pass for each dependency level.

    Core diagnosis first, then the sections that read it, then recommendations, which read the root causes. ``only`` writes those
    sections anew; others come from ``kept`` (run_id, section, raw) as they are.
    """
    levels = [["core_diagnosis"], ["management_concepts", "root_causes"], ["recommendations"]]
    before = {"management_concepts": "core_diagnosis", "root_causes": "core_diagnosis", "recommendations": "root_causes"}
    done: DataFrame | None = kept.filter(~F.col("section").isin(only)).select("run_id", "section", "raw") if kept is not None and only else None
    for level in levels:
        for section in [s for s in level if not only or s in only]:
            rows = requests.select("run_id", F.lit(section).alias("section"), "context")
            if section in before and done is not None:
                earlier = done.filter(F.col("section") == before[section]).select("run_id", F.col("raw").alias("earlier"))
                rows = rows.join(earlier, "run_id", "left")
            else:
                rows = rows.withColumn("earlier", F.lit(None).cast("string"))
            prompt = F.to_json(F.struct("section", "context", "earlier"))
            new = rows.select("run_id", "section", llm(F.col("section"), prompt).alias("raw"))
            done = new if done is None else done.unionByName(new)
    return done
