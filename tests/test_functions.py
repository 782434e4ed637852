import time

import pytest
from pyspark.sql import functions as F

from tarn.config import Config
from tarn.functions import json_sections as J
from tarn.functions import rules as R
from tarn.functions import sections as S
from tarn.functions import text as T
from tarn.operators.chunking import pack


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_sections():
    lines = ["# 第八章 Title", "intro", "## 第一部分 Part", "body"]
    assert [(s.chapter_id, s.section_id, s.body) for s in S.parse_sections(lines)] == [("ch08", "s00", "intro"), ("ch08", "s01", "body")]
    assert [S.numeral(x) for x in ("7", "十", "十二", "二十", "九十九", "百")] == [7, 10, 12, 20, 99, 0]
    assert S.parse_sections(["text", "## no chapter"]) == []
    odd = S.parse_sections(["# A", "", "### H", "x .... 12", "[3](#y)", "text", "", "# B", "## empty", "## full", "t"])
    assert [(s.chapter_id, s.section_id, s.lines) for s in odd] == [("ch00", "s01", ["### H", "", "text"]), ("ch01", "s02", ["t"])]


def test_packing():
    assert S.fill(["aaa", "bbbb", "ccccc", "dd"], 9, "--") == ["aaa--bbbb", "ccccc--dd"]
    assert S.fill(["a" * 10, "b"], 4, "-") == ["aaaa", "aaaa", "aa", "b"]
    assert S.sentences_of("Wait... what? 好。 end") == ["Wait.", "what?", "好。", "end"]
    assert S.with_tail(["abcdef", "gh", "ij"], 4) == ["abcdef", "cdef\n\ngh", "\n\ngh"[-4:] + "\n\nij"]
    assert S.sentence_tail("One. Two two. Three three three.", 14) == "Three three three."
    packed = S.section_pack(["p" * 500, "", "q" * 500, "", "r" * 100])
    assert packed[0] == "p" * 500 and packed[1].startswith("p" * 180 + "\n\nq") and packed[1].endswith("r" * 100)
    assert all(len(c) <= 1200 for c in S.section_pack(["sentence one. " * 300]))


def test_semantic_boundaries():
    units = [f"Sentence number {i} " + "x" * 80 + "." for i in range(40)]
    chunks = S.semantic(" ".join(units), S.hashed_embedding)
    assert all(len(c) <= 1200 for c in chunks) and "".join(chunks).replace("\n\n", "") == "".join(units)
    assert S.semantic("x" * 2500, S.hashed_embedding) == ["x" * 1200, "x" * 1200, "x" * 100]


def test_tokens(spark):
    assert value(spark, T.tokens(F.lit("KPI the AB 战略 客户减少 foo"))) == ["客户", "客户减少", "战略", "kpi", "kpi", "the", "foo", "战略", "战略", "客户减少", "客户", "户减", "减少"]
    assert value(spark, T.query_terms(F.lit("KPI kpi foo foo"))) == ["kpi", "foo"]
    assert value(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert value(spark, T.occurrences(F.lit("aaaa"), F.lit("aa"))) == [0, 1, 2]
    assert value(spark, T.adjacent_overlap(F.lit("abc"), F.lit("bcde"))) == 2
    assert value(spark, T.values_to_text(F.array(F.lit(" a "), F.lit(""), F.lit("b")))) == "a b"


def test_metadata_text(spark):
    record = {"summary": F.lit("s"), "inferred.symptom_keywords": F.lit("sym"), "extracted.concept_keywords": F.lit("")}
    assert value(spark, T.metadata_search_text(record)) == "s\nsym\nsym\nsym"
    assert value(spark, T.metadata_search_text(record, weighted=False)) == "s\nsym"
    assert value(spark, T.document_text(F.lit("ch"), F.lit(None).cast("string"), F.lit("t"), F.lit("t"), F.lit(" body "))) == "ch\nt\nt\nbody"


def test_rules(spark):
    assert value(spark, R.detect_language(F.lit("Our company growth is slowing down."))) == "en"
    assert value(spark, R.detect_language(F.lit("公司增长. Please answer in English."))) == "en"
    assert value(spark, R.detect_language(F.lit("123"))) == "zh"
    assert value(spark, R.route_problem(F.lit("A management diagnosis is needed."))) == ["general_management_diagnosis"]
    assert len(value(spark, R.hints(R.route_problem(F.lit("nothing"))))) == 1
    check = value(spark, R.check_clarity(F.lit("help")))
    assert not check.is_clear and check.questions
    merged = value(spark, R.merge_tags(F.array(*map(F.lit, ["指标体系错位", "战略执行脱节", "指标体系错位", "unknown"])), F.array(F.lit("metrics_misalignment"), F.lit("not_allowed"))))
    assert merged.tags == ["metrics_misalignment", "strategy_execution_gap"] and merged.unmapped == ["unknown"]
    intake = value(spark, R.normalize_intake(F.array(F.lit(" other ")), F.lit(" d "), F.lit(" ")))
    assert not intake.valid and len(intake.errors) == 1 and intake.retrieval_query == "problem_types: 其他\ndescription: d\nother_problem_type: "
    with pytest.raises(ValueError):
        R.retrieval_query(F.lit("x"), mode="nope")


GOOD = "根据知识项1，公司需要明确核心客户。" * 15 + "建议：先做客户访谈。假设：数据完整。Knowledge item 1."


@pytest.mark.parametrize("text,issue", [(GOOD, None), ("", "empty"), (GOOD.replace("建议", ""), "recommend"), (GOOD + "见 ch04/s06.md。", "source file"), (GOOD + "（未完", "truncated"), (GOOD.replace("知识项1", "").replace("Knowledge item 1", ""), "cite")])
def test_report_quality(spark, text, issue):
    issues = value(spark, R.report_issues(F.lit(text), F.array(F.lit("ch04/s06.md"))))
    assert (issues == []) if issue is None else any(issue in i for i in issues)


def test_context(spark):
    item = F.struct(F.lit("C").alias("chapter_title"), F.lit("S").alias("section_title"), F.lit("T").alias("title"), F.lit("body").alias("content"))
    text = value(spark, R.retrieved_context(F.array(item)))
    assert "Knowledge item 1" in text and "T" in text and "body" in text
    assert value(spark, R.retrieved_context(F.array().cast("array<struct<chapter_title:string,section_title:string,title:string,content:string>>"))) == "未检索到相关管理知识。"


SENTENCE = '{"sentences":[{"text":"a","source_items":[1]}]}'


@pytest.mark.parametrize(
    "raw,items,action",
    [
        (SENTENCE, [[1]], None),
        (f"```json\n{SENTENCE}\n```", [[1]], "strip_code_fence"),
        (f"Here it is: {SENTENCE} bye", [[1]], "extract_json_object"),
        (SENTENCE.replace("[1]", '"1"'), [[1]], "source_items_numeric_string_to_list"),
        (SENTENCE.replace("[1]", "3"), [[3]], "source_items_scalar_to_list"),
        (SENTENCE.replace("[1]", '["2", 4]'), [[2, 4]], "source_item_numeric_string_to_int"),
        ('{"sentences":[{"text":"a","source_items":[1]},"{"text":"b","source_items":[2]}]}', [[1], [2]], "remove_stray_object_boundary_quote"),
        (SENTENCE.replace(',"source_items":[1]', ""), None, None),
        (SENTENCE[:30], None, None),
        ('{"sentences":[]}', None, None),
        (SENTENCE.replace("[1]", "[true]"), None, None),
        (SENTENCE.replace("[1]", "[1.0]"), None, None),
        ('{"sentences":[],"sentences":[{"text":"a","source_items":[1]}]}', None, None),
        (None, None, None),
    ],
)
def test_json_recovery(raw, items, action):
    r = J.recover(raw)
    assert r.success == (items is not None)
    assert [s["source_items"] for s in r.sentences or []] == (items or [])
    if action:
        assert action in r.actions


def test_strict_parse():
    assert J.parse_strict(SENTENCE) == [{"text": "a", "source_items": [1]}]
    assert J.parse_strict('{"sentences":[]}') == []
    assert J.parse_strict(SENTENCE + " x") is None and J.parse_strict(SENTENCE.replace("[1]", "[true]")) is None
    assert J.balanced_objects('{"a":"}"} {b') == ['{"a":"}"}']


def test_config():
    assert Config.of({}) == Config()
    made = Config.of({"TARN_SOURCE_K": "20", "TARN_RRF_K": "x", "TARN_CORPUS": " /data ", "TARN_LOCAL_FILES_ONLY": "false"})
    assert (made.source_k, made.rrf_k, made.corpus, made.local_files_only) == (20, 60.0, "/data", False)


def test_walks_are_linear(spark):
    """Texts on which walking from each brace, quote, blank or unit anew would take hours."""
    begun = time.time()
    assert J.balanced_objects("{" * 200_000) == [] and len(J.balanced_objects("{}" * 100_000)) == 100_000
    assert J.balanced_objects('{"a {": {"}": 1}} {') == ['{"a {": {"}": 1}}', '{": {"}', '{"}": 1}']
    assert J.drop_stray_quotes('[{"a":1}, "{"b":2}]' + " " * 200_000) == ('[{"a":1}, {"b":2}]' + " " * 200_000, 1)
    assert J.drop_stray_quotes('{"a": "},"} ,"{') == ('{"a": "},"} ,"{', 0)
    rows = spark.createDataFrame([("a" + " " * 300_000 + "b \n",), ("\n\n".join(f"unit {i}" for i in range(30_000)),)], "t string")
    got = rows.select(F.length(T.strip(F.col("t"))).alias("n"), F.size(pack(T.paragraphs(F.col("t")), 900)).alias("chunks")).collect()
    assert got[0].n == 300_002 and got[1].chunks > 300
    assert time.time() - begun < 60
