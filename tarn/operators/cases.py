"""Evaluation cases: raw sections that hold their evidence (see ``corpus_qa.evidence_of``), loading, restoring saved results, checks of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions import text as T

# Fixed values. Headings of the raw document: chapters one to nine, sections of level two.
CHAPTER, SECTION, CHAPTER_DIGITS = r"^# 第([一二三四五六七八九])章", r"^## ", "一二三四五六七八九"
#: Fields that a restored result must have.
REQUIRED = ("chapter_title", "section_title", "title", "content")


def fail_unless(rows: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """The rows; one that doesn't meet the condition fails the query with the message."""
    said = F.lit(message) if isinstance(message, str) else message
    return rows.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def raw_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chapter_id, section_id, paragraphs) of raw documents with numbered chapters.

    Lines before the first such chapter, and those between a chapter's heading and its first section, belong to none; a section
    without text has no paragraphs, and of sections with the same ids the last one counts. A document's lines are numbered in
    its row; running counts of headings tell which section a line is of.
    """
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("at", "line"))
    digit = F.regexp_extract("line", CHAPTER, 1)
    lines = lines.withColumns({"chapter": F.when(digit != "", F.instr(F.lit(CHAPTER_DIGITS), digit)), "is_section": F.col("line").rlike(SECTION) & (digit == "")})
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"chapters": F.count("chapter").over(so_far), "chapter": F.last("chapter", ignorenulls=True).over(so_far)}).filter("chapters > 0")
    within = Window.partitionBy("doc_id", "chapters").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("section", F.sum(F.col("is_section").cast("int")).over(within)).filter("section > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("is_section"), F.struct("at", "line"))))  # the lines of one section
    bodies = lines.groupBy("doc_id", "chapters", "chapter", "section").agg(body.alias("lines"))
    last = bodies.groupBy("doc_id", "chapter", "section").agg(F.max_by("lines", "chapters").alias("lines"))
    text_ = T.strip(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return last.select("doc_id", F.format_string("ch%02d", "chapter").alias("chapter_id"), F.format_string("s%02d", F.col("section").cast("int")).alias("section_id"), T.paragraphs(text_).alias("paragraphs"))


def load_cases(spark: SparkSession, path: str, schema: str, expected: int | None = None) -> DataFrame:
    """The cases of one JSON file, an array of objects; a count that isn't the expected one raises."""
    cases = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if expected is not None and (n := cases.count()) != expected:
        raise ValueError(f"expected {expected} cases in {path}, found {n}")
    return cases


def restore(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, rank, source, chunk_index, titles, content): saved results (case_id, rank, source) with what the corpus holds of them.

    A result without a source, a source that the corpus lacks or has twice, or a chunk without a required field fails the query.
    """
    found = chunks.groupBy("source").agg(F.count("*").alias("__n"), F.min(F.struct("chunk_index", *REQUIRED)).alias("__c"))
    rows = ranked.select("case_id", "rank", "source").join(found, "source", "left")
    name = F.concat(F.lit("case "), F.col("case_id").cast("string"), F.lit(": "))
    source = F.coalesce("source", F.lit(""))
    rows = fail_unless(rows, source != "", F.concat(name, F.lit("a result has no source")))
    rows = fail_unless(rows, F.col("__n") == 1, F.concat(name, F.lit("cannot restore "), source))
    whole = F.forall(F.array(*[F.coalesce(F.col(f"__c.{c}"), F.lit("")) for c in REQUIRED]), lambda x: x != "")
    rows = fail_unless(rows, whole, F.concat(name, source, F.lit(" lacks a field")))
    return rows.select("case_id", "rank", "source", "__c.chunk_index", *[f"__c.{c}" for c in REQUIRED])


def with_split(cases: DataFrame, assignments: DataFrame) -> DataFrame:
    """Cases with the split (case_id, split) that each is assigned to; a case without one, or with several, fails the query."""
    one = assignments.groupBy("case_id").agg(F.count("*").alias("__n"), F.first("split").alias("split"))
    rows = cases.join(one, "case_id", "left")
    return fail_unless(rows, F.col("__n") == 1, F.concat(F.lit("no single split of case "), F.col("case_id").cast("string"))).drop("__n")


def id_differences(left: DataFrame, right: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, only_in): ids that one of two tables lacks; empty if the sets are equal."""
    one = lambda a, b, name: a.select(key).distinct().join(b, key, "left_anti").withColumn("only_in", F.lit(name))
    return one(left, right, "left").unionByName(one(right, left, "right"))


def only_cases(cases: DataFrame, ids: list) -> DataFrame:
    """The cases of the given ids, or all without any; an id that is missing raises."""
    if not ids:
        return cases
    wanted = cases.filter(F.col("case_id").isin(ids))
    missing = set(ids) - {r["case_id"] for r in wanted.select("case_id").distinct().collect()}  # as many as were given
    if missing:
        raise ValueError(f"no such cases: {sorted(missing)}")
    return wanted


def saved_results(spark: SparkSession, path: str, strategy: str, schema: str, top: int = 5) -> DataFrame:
    """(case_id, rank, and the fields of ``schema``) of the first results of each case of a strategy in a saved report.

    A case without an id or with fewer results, or two of the same id, fail the query.
    """
    whole = f"strategies struct<`{strategy}`:struct<cases:array<struct<case_id:string,top_k_chunks:array<struct<{schema}>>>>>>"
    cases = spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode(f"strategies.`{strategy}`.cases").alias("c")).select("c.*")
    n = F.count("*").over(Window.partitionBy("case_id"))
    ok = (F.coalesce("case_id", F.lit("")) != "") & (F.size(F.coalesce("top_k_chunks", F.array().cast(cases.schema["top_k_chunks"].dataType))) >= top) & (F.col("__n") == 1)
    cases = fail_unless(cases.withColumn("__n", n), ok, F.concat(F.lit("no usable results of case "), F.coalesce("case_id", F.lit("?"))))
    return cases.select("case_id", F.posexplode(F.slice("top_k_chunks", 1, top)).alias("at", "c")).select("case_id", (F.col("at") + 1).alias("rank"), "c.*")
