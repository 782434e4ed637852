"""Judging written reports with a model, and records of benchmark runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.retrieval import DIGITS

#: What a judge scores from 0 to 1, each with the steps it takes and what it is shown.
METRICS = {
    "faithfulness": (["Find the claims of the report.", "Hold each against the retrieved knowledge and the description.", "Lower the score for claims that neither supports."], ("input", "output", "context")),
    "answer_relevancy": (["Find what the description asks for.", "See which parts of the report answer it.", "Lower the score for parts that answer something else."], ("input", "output")),
    "diagnosis_quality": (["See whether the main problem is named.", "See whether its causes are explained.", "See whether the actions follow from the causes."], ("input", "output")),
}
#: Results that a judged case holds.
TOP = 5
Judge = Callable[[str, Column], Column]


def judge_prompt(metric: str, query: Column, output: Column, context: Column) -> Column:
    """The steps and what they are about as JSON."""
    steps, shown = METRICS[metric]
    parts = {"input": query, "output": output, "context": context}
    return F.to_json(F.struct(F.array(*map(F.lit, steps)).alias("steps"), *[parts[p].alias(p) for p in shown]))


def evaluate(cases: DataFrame, judge: Judge, metrics: list[str] | None = None) -> DataFrame:
    """(case_id, metric, score, reason) of cases (case_id, query, report, chunks array<struct<content>>).

    ``judge(metric, prompt)`` is a column function that returns struct(score, reason). A case without exactly TOP results,
    or with one without content, fails the query.
    """
    bad = (F.size(F.coalesce("chunks", F.array().cast("array<struct<content:string>>"))) != TOP) | F.exists("chunks", lambda c: c["content"].isNull())
    message = F.concat(F.lit("case "), F.col("case_id").cast("string"), F.lit(f" doesn't hold {TOP} results with content"))
    rows = cases.withColumn("__context", F.when(bad, F.raise_error(message).cast("array<string>")).otherwise(F.transform("chunks", lambda c: c["content"])))
    each = [F.struct(F.lit(m).alias("metric"), judge(m, judge_prompt(m, F.col("query"), F.col("report"), F.col("__context"))).alias("j")) for m in metrics or METRICS]
    rows = rows.select("case_id", F.explode(F.array(*each)).alias("m"))
    return rows.select("case_id", "m.metric", F.col("m.j.score").cast("double").alias("score"), F.col("m.j.reason").alias("reason"))


def summary(judged: DataFrame) -> DataFrame:
    """(metric, mean, median, min, max, count)."""
    score = F.col("score")
    return judged.groupBy("metric").agg(F.round(F.avg(score), DIGITS).alias("mean"), F.round(F.median(score), DIGITS).alias("median"), F.min(score).alias("min"), F.max(score).alias("max"), F.count("*").alias("count"))


def preview(text: Column, limit: int = 240) -> Column:
    """One line of at most ``limit`` characters and a note if there were more."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("... [truncated]"))).otherwise(line)


def cell(value: Column) -> Column:
    """A value for a Markdown table: numbers with three digits, bars escaped, line ends as spaces, ``-`` for null."""
    number = value.try_cast("double")
    text = F.when(number.isNotNull(), F.format_string("%.3f", number)).otherwise(F.replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    return F.coalesce(text, F.lit("-"))


def markdown_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a table's rows as Markdown table rows."""
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |")).alias("line"))


def score_columns(results: DataFrame) -> DataFrame:
    """The columns of results that tell how they were ranked: ids, ranks, scores and methods, without texts."""
    shown = [c for c in results.columns if c in ("case_id", "query_id", "key", "source", "method", "retrieval_method", "sources") or c.endswith(("rank", "score"))]
    return results.select(*shown)


def case_records(results: DataFrame, config: dict[str, object], by: str = "query_id") -> DataFrame:
    """(by, config, results): a record of each case of a run: the run's settings and its results in order of rank."""
    shown = [c for c in score_columns(results).columns if c not in (by, "rank")]
    lists = results.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", *shown))).alias("results"))  # the results of one case
    return lists.select(by, F.struct(*[F.lit(v).alias(k) for k, v in config.items()]).alias("config"), "results")


def sentence_view(sentences: Column, content: Column, source_items: Column) -> Column:
    """array<struct<text, source_items>> for a display with citations: the sentences, or the whole content as one; escaped for HTML."""
    whole = F.array(F.struct(F.coalesce(content, F.lit("")).alias("text"), F.coalesce(source_items, F.array().cast("array<int>")).alias("source_items")))
    shown = F.when(F.size(F.coalesce(sentences, F.array().cast("array<struct<text:string,source_items:array<int>>>"))) > 0, sentences).otherwise(whole)

    def escaped(text: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return text

    return F.transform(shown, lambda s: F.struct(escaped(s["text"]).alias("text"), s["source_items"].alias("source_items")))
