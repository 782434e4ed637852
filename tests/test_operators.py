import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import chunking as C
from tarn.operators import corpus_qa as Q
from tarn.operators import evaluation as E
from tarn.operators import benchmark, fusion, hybrid, index, reports, retrieval, runs


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry cherry cherry date"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "apple apple date"), (2, "zzz")], "query_id long, query string")
    got = {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in retrieval.bm25(queries, docs).collect()}
    idf, avgdl = math.log(1 + 3.5 / 1.5), 9 / 4
    part = lambda tf, n, qtf: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl)) * qtf
    assert got == {(1, 1): (pytest.approx(part(2, 3, 2)), 1), (1, 3): (pytest.approx(part(1, 4, 1)), 2)}
    assert retrieval.keyword_search(queries, docs).filter("doc_id = 1").first().score == 2.0


def test_vector_search(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    want = {}
    for q in range(0, 90, 20):
        s = np.round(x.astype(np.float64) @ x[q].astype(np.float64), 9)
        want[q] = [i for i in sorted(range(90), key=lambda i: (-s[i], i)) if i != q][:5]
    for block in (4096, 7):
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
        got = retrieval.vector_search(queries, vectors, 5, exclude_self=True).orderBy("query_id", "rank").collect()
        assert {q: [r.vec_id for r in got if r.query_id == q] for q in want} == want
    assert retrieval.vector_search(queries.limit(0), vectors, 5).count() == 0


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", "x", 2.0, 1), (1, "b", "x", 1.0, 2), (1, "b", "y", -1.0, 1), (1, "c", "y", -2.0, 2)], "query_id int, key string, method string, score double, rank int")
    rrf = {r.key: (r.score, r.sources) for r in fusion.rrf_fusion(lists).collect()}
    assert rrf["b"] == (pytest.approx(1 / 62 + 1 / 61, abs=1e-8), ["x", "y"]) and rrf["a"][0] == pytest.approx(1 / 61, abs=1e-8) and rrf["c"][0] == pytest.approx(1 / 62, abs=1e-8)
    linear = {r.key: r.score for r in fusion.linear_fusion(lists, {"x": 0.15, "y": 0.85}).collect()}
    assert linear == {"a": 0.15, "b": 0.075, "c": 0.0}
    overlap = fusion.candidate_overlap(lists, "x", "y").first()
    assert (overlap.shared, overlap.added, overlap.jaccard) == (1, 1, pytest.approx(1 / 3, abs=1e-8))
    change = {r.key: (r.change, r.moved) for r in fusion.rank_change(lists.filter("method = 'x'"), lists.filter("method = 'y'"), 1).collect()}
    assert change == {"a": (None, "out"), "b": (-1, "in"), "c": (None, "same")}


def test_metrics(spark):
    cases = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "case_id int, n_evidence int")
    ranked = spark.createDataFrame([(1, r) for r in (1, 2, 3)] + [(2, 1)], "case_id int, rank int")
    matches = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1)], "case_id int, rank int, evidence int")
    m = {(r.case_id, r.metric): r.value for r in E.hits_to_metrics(cases, ranked, matches, (1, 3, 5)).collect()}
    assert m[1, "ndcg@3"] == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3)), abs=1e-8)
    assert (m[1, "recall@5"], m[1, "recall_ref@5"], m[1, "recall_ref@3"], m[1, "precision@5"], m[1, "mrr"]) == (1.0, 0.0, 1.0, 0.6, 1.0)
    assert m[2, "hit@5"] == m[2, "mrr"] == m[3, "ndcg@5"] == 0.0


def test_evidence_coverage(spark):
    ranked = spark.createDataFrame([(1, 1, "Alpha beta. Other."), (1, 2, "alpha BETA!")], "case_id int, rank int, content string")
    gold = spark.createDataFrame([(1, 0, "Alpha beta. Gamma delta."), (2, 0, "x")], "case_id int, evidence int, text string")
    got = {r.case_id: (r.coverage, r.density) for r in E.evidence_coverage(ranked, gold, 5).collect()}
    assert got[1] == (pytest.approx(9 / 19, abs=1e-8), pytest.approx(18 / 23, abs=1e-8)) and got[2] == (0.0, 0.0)


def test_chunkers(spark):
    docs = spark.createDataFrame([(1, "abcdefghij", "t"), (2, "", "t"), (3, None, "t"), (4, "Para one.\n\n" + "Long sentence here! " * 100, "t"), (5, "# 第二章 X\nlead\n## Y\n" + "Some text. " * 200, "t")], "doc_id long, text string, title string")
    assert [r.content for r in C.fixed_size(docs, 4).filter("doc_id = 1").collect()] == ["abcd", "efgh", "ij"]
    for size in (1, 7, 900):
        pieces = C.fixed_size(docs, size).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "").alias("t"))
        assert {r.doc_id: r.t for r in pieces.collect()} == {r.doc_id: r.text for r in docs.collect() if r.text}
    native = {(r.doc_id, r.chunk_index): r.content for r in C.recursive(docs, 100).collect()}
    from tarn.functions import sections as S

    assert native == {(r.doc_id, i): c for r in docs.collect() for i, c in enumerate(S.recursive(r.text or "", 100), 1)}
    for name in C.STRATEGIES:
        rows = C.experiment_corpus(docs, name).collect()
        assert rows and all(1 <= r.chunk_index <= r.chunk_count for r in rows)
    assert {r.source_id for r in C.section_raw(docs).collect()} == {"ch02_s00_chunk_01", "ch02_s01_chunk_01"}
    with pytest.raises(ValueError):
        C.fixed_size(docs, 0)
    with pytest.raises(ValueError):
        C.experiment_corpus(docs, "nope")


def test_report_sections(spark):
    good = '{"sentences":[{"text":" a ","source_items":[2,1]},{"text":"b","source_items":[1]}]}'
    raw = spark.createDataFrame([("core", good), ("fenced", f"```\n{good}\n```"), ("broken", "{"), ("null", None)], "section string, raw string")
    got = {r.section: r for r in reports.parse_sections(raw).collect()}
    assert got["core"].content == "ab" and got["core"].source_items == [2, 1] and got["core"].initial_parse_success
    assert got["fenced"].recovery_success and got["fenced"].content == " a b" and not got["broken"].final_parse_success and got["null"].content == ""


def test_targeted_regeneration(spark):
    requests = spark.createDataFrame([("r", "ctx")], "run_id string, context string")
    llm = lambda section, prompt: F.concat(section, F.lit("|"), F.get_json_object(prompt, "$.earlier"))
    first = reports.generate(requests, lambda s, p: F.concat(F.lit("v1 "), s))
    again = {r.section: r.raw for r in reports.generate(requests, llm, ["root_causes"], first).collect()}
    assert again == {"core_diagnosis": "v1 core_diagnosis", "management_concepts": "v1 management_concepts", "recommendations": "v1 recommendations", "root_causes": "root_causes|v1 core_diagnosis"}


def test_corpus_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, f string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, None)], "k int, f string")
    assert {r.k: (r.status, r.differing) for r in Q.parity(a, b, "k", ["f"]).collect()} == {1: ("same", []), 2: ("differs", ["f"]), 3: ("extra", []), 4: ("missing", [])}
    cases = spark.createDataFrame([(1, [("c", "s", 1, 3)])], "case_id int, expected array<struct<chapter_id:string,section_id:string,start:int,end:int>>")
    paragraphs = spark.createDataFrame([("c", "s", ["p", "q", "r"])], "chapter_id string, section_id string, paragraphs array<string>")
    assert Q.evidence_of(cases, paragraphs).first().text == "q\n\nr"
    with pytest.raises(Exception, match="no such evidence"):
        Q.evidence_of(cases, paragraphs.limit(0)).collect()


def test_runs(spark):
    events = spark.createDataFrame([("a", 1, "understanding", "{}", None, 1), ("a", 2, "retrieval", "{}", None, 2), ("b", 1, "understanding", "{}", None, 3)], "run_id string, step int, node string, state string, parent_run string, at int")
    assert {r.run_id: r.node for r in runs.current(events).collect()} == {"a": "retrieval", "b": "understanding"}
    assert [(r.run_id, r.step, r.parent_run) for r in runs.branch(events, "a", 1, "c").collect()] == [("c", 1, "a")]
    step = lambda n, valid, passed, rev: spark.range(1).select(runs.next_node(F.lit(n), F.lit(valid), F.lit(passed), F.lit(rev))).first()[0]
    assert step("understanding", False, None, 0) is None and step("validation", True, False, 1) == "generation" and step("validation", True, False, 2) == "persistence"


def _retriever(spark, rows):
    made = spark.createDataFrame(rows, "query_id int, key string, score double, rank int, chapter_id string, summary string")
    return lambda queries, k: made.filter(F.col("rank") <= k)


def test_pipeline_modes(spark):
    bm25 = _retriever(spark, [(1, "a", 2.0, 1, "ch03", ""), (1, "b", 1.0, 2, None, None)])
    dense = _retriever(spark, [(1, "b", 0.9, 1, "ch07", "said"), (1, "c", 0.8, 2, "", None)])
    both, queries = {"embedding": dense, "bm25": bm25}, spark.range(1)
    got = {r.key: r for r in hybrid.retrieve(both, queries, final_k=5).collect()}
    assert got["b"].sources == ["embedding", "bm25"] and got["b"].retrieval_method == "hybrid_rrf" and got["b"]["rank"] == 1
    assert (got["a"].retrieval_method, got["a"].chapter_number, got["a"].bm25_rank, got["a"].embedding_rank) == ("keyword", "03", 1, None)
    assert got["b"].chapter_id == "ch07" and got["b"].summary == "said" and got["c"].retrieval_method == "embedding"
    assert got["b"].score == pytest.approx(1 / 61 + 1 / 62)
    for k in (0, -3):
        assert hybrid.retrieve(both, queries, final_k=k).collect() == []
    with pytest.raises(ValueError):
        hybrid.retrieve(both, queries, mode="dense")
    score = lambda c: c.withColumn("rerank_score", F.when(F.col("key") == "c", 1.0).otherwise(0.5))
    best = hybrid.retrieve(both, queries, "hybrid_rerank", 2, score=score).orderBy("rank").collect()
    assert [(r.key, r.score, r.retrieval_method) for r in best] == [("c", 1.0, "hybrid_rerank"), ("a", 0.5, "hybrid_rerank")]
    only = hybrid.retrieve(both, queries, "hybrid_rerank", 5, candidate_k=1, score=score).collect()
    assert [r.key for r in only] == ["b"]
    line = {r.key: r for r in hybrid.retrieve(both, queries, fuse=hybrid.linear).collect()}
    assert line["b"].score == pytest.approx(0.15 * 0.5 + 0.85) and line["b"].retrieval_method == "hybrid"
    seen = hybrid.observation(hybrid.retrieve(both, queries)).first()
    assert seen.chunk_count == 3 and seen.top_embedding_score == 0.9 and [c["rank"] for c in seen.chunks] == [1, 2, 3]
    keys = spark.createDataFrame([("a.md", 3), ("a.md", None), (None, 1)], "s string, i int").select(hybrid.result_key(F.col("s"), F.col("i")).alias("k")).collect()
    assert [r.k for r in keys] == ["a.md:3", "a.md", ":1"]


@pytest.mark.parametrize("block,rows", [(16384, 200_000), (4, 3)])
def test_stored_index(spark, tmp_path, monkeypatch, block, rows):
    """As a search without an index, over few and many blocks; ids may be strings, documents empty."""
    monkeypatch.setattr(index, "BLOCK_DOCS", block)
    monkeypatch.setattr(index, "QUERY_ROWS", rows)
    rng = random.Random(2)
    words = ["market", "team", "growth", "the", "process", "customer", "report", "strategy"]
    docs = [(f"d{i:03d}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [("none", None)]
    docs = spark.createDataFrame(docs, "doc_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.sample(words, 3))) for i in range(12)] + [(90, ""), (91, "unknown")], "query_id int, query string")
    index.write_bm25_index(docs, str(tmp_path / "i"))
    stored = index.read_bm25_index(spark, str(tmp_path / "i")).cache()
    want = sorted(map(tuple, retrieval.bm25(asked, docs, 4).collect()))
    assert sorted(map(tuple, stored.search(asked, 4).collect())) == want and len(want) == 48
    stored.reset()
    index.write_bm25_index(docs.limit(0), str(tmp_path / "none"))
    assert index.read_bm25_index(spark, str(tmp_path / "none")).search(asked, 4).count() == 0


def test_vectors_of_string_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", None)], "vec_id string, embedding array<double>")
    got = retrieval.vector_search(v.withColumnRenamed("vec_id", "query_id"), v, 2, exclude_self=True).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [("a", "b", 0.8), ("b", "a", 0.8)]


def test_benchmark_of_methods(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    ranked = lambda rows: (lambda q, k: spark.createDataFrame(rows, "query_id int, key string, score double, rank int").filter(F.col("rank") <= k))
    methods = {"late": ranked([(1, "x", 2.0, 1), (1, "a", 1.0, 2), (2, "y", 1.0, 1)]), "first": ranked([(1, "a", 3.0, 1)])}
    cases = spark.createDataFrame([(1, 1), (2, 1)], "case_id int, n_evidence int")
    matches = spark.createDataFrame([(1, "a", 0)], "case_id int, key string, evidence int")
    done = benchmark.run(methods, queries, cases, matches, 5)
    value = {(r.method, r.case_id, r.metric): r.value for r in done.results.collect()}
    assert value["late", 1, "mrr"] == 0.5 and value["first", 1, "mrr"] == 1.0 and value["first", 2, "hit@5"] == value["late", 2, "mrr"] == 0.0
    assert {r.metric: r.best for r in done.best().collect()}["mrr"] == "first" and set(done.milliseconds) == {"late", "first"}
    assert {r.metric: r.mean_delta for r in done.deltas("late").collect()}["mrr"] == 0.25
    records = {(r.case_id, r.method): r for r in done.records({"k": 5}).collect()}
    assert len(records) == 3 and [x.key for x in records[1, "late"].results] == ["x", "a"] and records[1, "first"].config.k == 5
    assert done.summary(spark.createDataFrame([(1, "dev"), (2, "test")], "case_id int, split string")).filter("split = 'dev' and metric = 'mrr' and method = 'first'").first()["mean"] == 1.0
    done.lists.unpersist()
