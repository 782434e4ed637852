"""Queries at size: what is written and shuffled follows the input, not its pairs."""

import random

from pyspark.sql import functions as F

from tarn.operators import retrieval
from tarn.plans import retrieval as plans

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _words(n, seed, least=1):
    r = random.Random(seed)
    return [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "客户", "zeta", "kappa"]) for _ in range(r.randint(least, 12))) for _ in range(n)]


def test_lexical_search_joins_no_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([*enumerate(_words(300, 1)), (300, None), (301, "")], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(_words(40, 2))] + [("none", "zzz"), ("null", None)], "query_id string, query string")
    for search in (retrieval.bm25, retrieval.keyword_search):
        found = search(queries, docs, 7)
        assert "Join" not in _plan(found)
        whole = sorted(map(tuple, found.collect()))
        every = {(q, d): s for q, d, s, _ in search(queries, docs, 1000).collect()}
        for q in {q for q, *_ in whole}:
            want = sorted((-s, d) for (p, d), s in every.items() if p == q)[:7]  # ties by id, though many scores are equal
            assert [(-s, d) for _, d, s, r in sorted((x for x in whole if x[0] == q), key=lambda x: x[3])] == want
        monkeypatch.setattr(retrieval, "QUERY_ROWS", 30)
        monkeypatch.setattr(retrieval, "TOKENS_AT_ONCE", 50)
        assert sorted(map(tuple, search(queries, docs, 7).collect())) == whole
        monkeypatch.undo()
    assert retrieval.bm25(queries.limit(0), docs).count() == retrieval.bm25(queries, docs.limit(0)).count() == 0


def test_evidence_of_listed_results_only(spark):
    lists, matches, cases = plans._case_lists(spark, SF, 3)
    listed = lists.select("case_id", "key").distinct()
    assert matches.join(listed, ["case_id", "key"], "left_anti").count() == 0 and matches.count() > 0
    docs, queries = plans._both(spark, SF)
    n = docs.groupBy("label").agg(F.count_distinct("lang").alias("n"))
    assert {r.case_id: r.n_evidence for r in cases.collect()} == {r.query_id: r.n for r in queries.join(n, "label").collect()}


def test_evidence_lines(spark):
    from tarn.functions import text as T

    texts = ["Ab-c\n\n x1 ÄÖ客户\r\n", "", None, "ΑΣ\nİi!", "\n", "𝔸b c"]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string").repartition(1)
    want = F.transform(F.split("t", "\n"), lambda u: T.normalize_evidence(u, compose=False))
    assert all(r.a == r.b for r in rows.select(T.evidence_lines(F.lower("t")).alias("a"), want.alias("b")).collect())


def test_evidence_match_normalises_once(spark):
    from tarn.plans import corpus

    assert "regexp_replace" not in _plan(corpus.evidence_match(spark, SF))


def test_semantic_chunks_embed_bounded_pieces(spark, tmp_path):
    from tarn.functions import sections as S
    from tarn.operators import chunking as C

    def embed(units):
        with open(tmp_path / "calls", "a") as f:
            f.write(f"{sum(map(len, units))} {len(units)}\n")
        return S.hashed_embedding(units)

    docs = spark.createDataFrame([(i, "# a\n" + "Some words of a sentence here. " * 4000, "t") for i in range(12)], "doc_id long, text string, title string").repartition(1)
    found = C.section_semantic(docs, embed).select("doc_id", "chunk_index", "content").collect()
    calls = [tuple(map(int, x.split())) for x in (tmp_path / "calls").read_text().splitlines()]
    assert max(n for n, _ in calls) <= 500_000 and sum(n for _, n in calls) == 12 * 4000
    want = S.semantic_chunks(units := S.semantic_units("Some words of a sentence here. " * 4000), [1.0] * (len(units) - 1), C.V.SEMANTIC_MIN, C.V.TARGET_CHARS, C.V.MAX_CHARS, C.V.SEMANTIC_BREAK)
    assert {r.doc_id for r in found} == set(range(12)) and [r.content for r in sorted(found, key=lambda r: r.chunk_index) if r.doc_id == 3] == want


def test_index_inverts_blocks_after_one_shuffle(spark):
    from tarn.operators import index

    texts = [*_words(200, 3), None, ""]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = index.postings_of(docs, "doc_id", F.col("text"), 3)
    assert _plan(rows).count("Repartition") <= 2 and "Aggregate" not in _plan(rows)
    got = {(p.term, i): (tf, n) for p in rows.collect() for i, tf, n in zip(p.ids, p.tfs, p.lengths, strict=True)}
    want = {(r.term, r.id): (r.tf, r.length) for r in retrieval.postings(docs, "doc_id", F.col("text")).collect()}
    assert got == want


def test_document_text_strips_only_where_needed(spark):
    from tarn.functions import text as T

    texts = ["a b", " a\n", "　a", "a ", "", None, " ", "\n\t", "a "]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string")
    want = F.concat_ws("\n", T.strip(F.nullif("t", F.lit(""))))
    assert all(r.a == r.b for r in rows.select(T.document_text(F.col("t")).alias("a"), want.alias("b")).collect())
    assert "substring" in _plan(rows.select(T.document_text(F.col("t"))))


def test_only_ranked_texts_are_joined(spark):
    found = plans.bm25_list(spark, SF)
    assert {r.doc_id for r in plans._texts_of(found, spark, SF).collect()} == {r.doc_id for r in found.collect()}


def _found(texts, vocabulary):
    import pyarrow as pa

    length, row, place = retrieval.find_tokens(pa.array(["xyz客", *texts])[1:], pa.array(vocabulary, pa.string()))
    return length.tolist(), sorted((i, vocabulary[p]) for i, p in zip(row.tolist(), place.tolist(), strict=True))


def test_tokens_are_found_in_bytes(spark):
    from tarn.functions import text as T

    r = random.Random(5)
    texts = ["".join(r.choice("abcKpi客户增长 \nñ一鿿㐀é😀K.") for _ in range(r.choice([0, 1, 3, 8, 40]))) for _ in range(200)]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", F.lower("t").alias("t"), T.tokens(F.col("t")).alias("w")).orderBy("i").collect()
    vocabulary = sorted({w for x in rows for w in x.w if r.random() < 0.7} | {"zzz"})
    length, found = _found([x.t for x in rows], vocabulary)
    assert length == [len(x.w) for x in rows] and found == sorted((x.i, w) for x in rows for w in x.w if w in vocabulary)
    assert _found([], ["abc"]) == ([], []) and _found(["abc", "def"], []) == ([1, 1], [])


def test_search_sends_k_rows_of_each_part(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PARTS", 3)
    sent = []
    monkeypatch.setattr(retrieval, "top_k", lambda scored, *rest, top=retrieval.top_k: (sent.append(scored.count()), top(scored, *rest))[1])
    docs = spark.createDataFrame([*enumerate(_words(400, 1, 6))], "doc_id long, text string").repartition(40).cache()
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(_words(10, 2, 6))], "query_id string, query string")
    retrieval.bm25(queries, docs, 2)
    vectors = docs.select("doc_id", F.array(F.cos("doc_id"), F.sin("doc_id")).alias("embedding"))
    retrieval.vector_search(vectors.filter("doc_id < 10").withColumnRenamed("doc_id", "query_id"), vectors, 2, "doc_id")
    assert len(sent) == 2 and max(sent) <= 10 * 2 * 3


def test_blocks_and_groups_of_vectors(spark, monkeypatch):
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), F.lit(0.0)).alias("embedding")).repartition(5)
    queries = vectors.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    run = lambda: sorted(map(tuple, retrieval.vector_search(queries, vectors, 4, exclude_self=True).collect()))
    want = run()
    for name, value in (("VECTOR_BLOCK", 7), ("VECTOR_VALUES", 50), ("RESULT_ROWS", 40)):
        monkeypatch.setattr(retrieval, name, value)
        assert run() == want


def test_lexical_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([*enumerate(_words(300, 1)), (300, None), (301, "")], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(_words(20, 2))], "query_id string, query string")
    want = sorted(map(tuple, retrieval.bm25(queries, docs, 7).collect()))
    for name, value in (("BYTES_AT_ONCE", 60), ("TOKENS_AT_ONCE", 9), ("RESULT_ROWS", 50)):
        monkeypatch.setattr(retrieval, name, value)
        assert sorted(map(tuple, retrieval.bm25(queries, docs, 7).collect())) == want


def test_hybrid_shuffles_no_text(spark):
    docs, queries = plans._both(spark, SF)
    assert "text" not in docs.columns and {"doc_id", "lang", "source", "n_chars", "embedding", "label"} == set(docs.columns)
    texts = {r.doc_id: r.text for r in plans._vector_texts(spark, SF).collect()}
    assert {r.doc_id: r.n_chars for r in docs.collect()} == {i: len(t) for i, t in texts.items()}
    assert {r.query_id: r["query"] for r in queries.collect()} == {i: t for i, t in texts.items() if i % 20 == 0}


def test_ranked_lists_tokenize_documents_once(spark, monkeypatch):
    """F15, F16."""
    calls = []
    monkeypatch.setattr(retrieval, "term_counts", lambda *x, counts=retrieval.term_counts: (calls.append(x), counts(*x))[1])
    monkeypatch.setattr(retrieval, "TOKENS_AT_ONCE", 300)  # so that later blocks skip documents by their bounds
    got = sorted(map(tuple, plans.ranked_lists(spark, SF).collect()))
    assert len(calls) == 1
    monkeypatch.undo()
    want = [(r.query_id, r.doc_id, m, r.score, r.rank) for m, f in (("bm25", plans.bm25_list), ("keyword", plans.keyword_list)) for r in f(spark, SF, 20).collect()]
    assert got == sorted(want)
