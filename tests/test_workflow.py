import json

import pytest
from pyspark.sql import functions as F

from tarn.functions import fixed_values as V
from tarn.operators import judging, workflow


def _workflow(spark, path, answer):
    chunk = "array<struct<rank:int,source:string,title:string,chapter_title:string,section_title:string,content:string,score:double>>"
    found = F.expr(f"transform(sequence(1, 3), i -> named_struct('rank', i, 'source', concat('s', i), 'title', 't', 'chapter_title', 'c', 'section_title', 'x', 'content', concat('knowledge ', i), 'score', 1.0D / i))").cast(chunk)

    def retrieve(queries):
        return queries.filter("query not like '%nothing%'").select("run_id", F.explode(found).alias("c")).select("run_id", "c.*")

    return workflow.Workflow(spark, str(path), retrieve, answer)


def _answer(section, messages):
    """Good JSON; the causes are cut off as long as no earlier attempt is said in the description."""
    good = F.concat(F.lit('{"sentences":[{"text":"about '), section, F.lit('","source_items":[1,3]}]}'))
    raw = F.when(section == "management_concepts", F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(good)
    bad = (section == "root_causes") & F.contains(messages[1]["content"], F.lit("broken"))
    return F.struct(F.when(bad, F.lit('{"sentences":[')).otherwise(raw).alias("raw"), F.when(bad, "length").otherwise("stop").alias("done_reason"), F.length(messages[1]["content"]).alias("eval_count"))


def test_runs_to_their_end(spark, tmp_path):
    flow = _workflow(spark, tmp_path, _answer)
    asked = [("ok", "sales fall in all regions", ["growth"], None), ("bad", "", [], None), ("broken", "broken again and again", ["growth"], None), ("empty", "nothing is found", ["growth"], None)]
    flow.start(spark.createDataFrame(asked, "run_id string, description string, problem_types array<string>, other_problem_type string"))
    assert flow.step() == 3
    flow.run_all()
    nodes = lambda run: [r.node for r in flow.history(run).orderBy("step").collect()]
    assert nodes("ok") == ["understanding", "retrieval", "generation", "validation", "persistence"]
    assert nodes("bad") == ["understanding"]
    twice = ["understanding", "retrieval", *["generation", "validation"] * 2, "persistence"]
    assert nodes("broken") == twice == nodes("empty")
    state = flow.state("ok").first().state
    assert state.passed and [s.section for s in state.sections] == V.SECTIONS and [s.content for s in state.sections] == [f"about {s}" for s in V.SECTIONS]
    assert [s.recovery_success for s in state.sections] == [False, True, False, False] and state.top_score == 1.0
    first, second = (next(r.state for r in flow.history("broken").collect() if r.step == n) for n in (3, 5))
    assert first.failed == second.failed == ["root_causes"] and (first.revision_count, second.revision_count) == (0, 1)
    assert [s.raw for s in first.sections][:2] == [s.raw for s in second.sections][:2]
    records = {r.project_id: r for r in flow.records().collect()}
    assert set(records) == {"ok", "broken", "empty"} and records["ok"].final_answer == "about core_diagnosis"
    assert json.loads(records["ok"].retrieved_sources)[0] == {"source": "s1", "title": "t", "score": 1.0} and json.loads(records["broken"].verification)["failed"] == ["root_causes"]
    assert flow.step() == 0


def test_branch_and_resume(spark, tmp_path):
    flow = _workflow(spark, tmp_path, _answer)
    flow.start(spark.createDataFrame([("a", "a case to look at", ["growth"], None)], "run_id string, description string, problem_types array<string>, other_problem_type string"))
    flow.run_all()
    flow.branch("a", 2, "b")
    assert [r.node for r in flow.history("b").collect()] == ["generation", "retrieval", "understanding"] and flow.state("b").first().parent_run == "a"
    assert flow.predecessor("a", 2).first().node == "retrieval"
    flow.resume("a", 3, "c")
    assert {r.run_id: r.node for r in workflow.runs.current(flow.events()).collect()} == {"a": "persistence", "b": "persistence", "c": "persistence"}
    assert flow.records().count() == 3
    for call in (lambda: flow.resume("a", 0, "d"), lambda: flow.branch("none", 3, "d")):
        with pytest.raises(ValueError):
            call()


def test_messages_and_sizes(spark):
    rows = spark.createDataFrame([("d", ["x"], "k", "core")], "d string, p array<string>, k string, c string")
    messages = workflow.section_messages("root_causes", F.col("d"), F.col("p"), F.col("k"), {"core_diagnosis": F.col("c")})
    r = rows.select(messages.alias("m"), workflow.message_sizes(messages).alias("s"), workflow.serialized_chars(F.col("p")).alias("n"), workflow.serialized_chars(F.lit(None).cast("string")).alias("z")).first()
    assert [m.role for m in r.m] == ["system", "user"]
    assert json.loads(r.m[1].content) == {"section": "root_causes", "description": "d", "problem_types": ["x"], "retrieved_knowledge": "k", "core_diagnosis": "core"}
    assert r.s.message_count == 2 and r.s.total_chars == sum(len(m.content) for m in r.m) and r.n == len('["x"]') and r.z == 0


def test_judging(spark):
    chunks = "array<struct<content:string>>"
    rows = spark.createDataFrame([(1, "q", "report", [("c",)] * 5), (2, "q2", "report two", [("c",)] * 5)], f"case_id int, query string, report string, chunks {chunks}")
    judge = lambda metric, prompt: F.struct((F.length(F.get_json_object(prompt, "$.output")) / 10.0).alias("score"), F.when(F.contains(prompt, F.lit('"context"')), "seen").otherwise("unseen").alias("reason"))
    got = {(r.case_id, r.metric): (r.score, r.reason) for r in judging.evaluate(rows, judge).collect()}
    assert got[1, "faithfulness"] == (0.6, "seen") and got[2, "answer_relevancy"] == (1.0, "unseen") and len(got) == 6
    assert {r.metric: (r["mean"], r["count"]) for r in judging.summary(judging.evaluate(rows, judge)).collect()}["diagnosis_quality"] == (0.8, 2)
    few = spark.createDataFrame([(1, "q", "r", [("c",)] * 4)], rows.schema)
    with pytest.raises(Exception, match="case 1"):
        judging.evaluate(few, judge).collect()


def test_records_and_cells(spark):
    rows = spark.createDataFrame([(1, "a", 2, 0.5, "t|x\ny"), (1, "b", 1, 0.9, None)], "query_id int, key string, rank int, score double, text string")
    r = judging.case_records(rows, {"method": "bm25", "k": 5}).first()
    assert (r.config.method, r.config.k) == ("bm25", 5) and [(x["rank"], x.key, x.score) for x in r.results] == [(1, "b", 0.9), (2, "a", 0.5)]
    assert judging.score_columns(rows).columns == ["query_id", "key", "rank", "score"]
    assert sorted(x.line for x in judging.markdown_rows(rows, ["score", "text"]).collect()) == ["| 0.500 | t\\|x y |", "| 0.900 | - |"]
    shown = rows.select(judging.preview(F.lit("a\n" * 200)).alias("p"), judging.sentence_view(F.lit(None).cast("array<struct<text:string,source_items:array<int>>>"), F.lit("<a & b>"), F.array(F.lit(2))).alias("v")).first()
    assert shown.p == "a " * 120 + "... [truncated]" and [tuple(x) for x in shown.v] == [("&lt;a &amp; b&gt;", [2])]
