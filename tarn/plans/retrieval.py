"""Retrieval queries over the tables, each with its SQL twin."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions import fixed_values as V
from tarn.functions import text as T
from tarn.operators import evaluation as E
from tarn.operators import benchmark, fusion, hybrid, index, retrieval
from tarn.operators.retrieval import DIGITS
from tarn.operators.scratch import materialize


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _queries(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: Ids up to which they are broadcast.
BROADCAST_IDS = 2_000_000

# --- SQL pieces ------------------------------------------------------------------------------------------------

_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in T.KEYWORDS) + "]"


def sql_tokens(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    cjk = f"regexp_extract_all({t}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')"
    return (
        f"(list_filter({_KEYWORDS}, lambda k: contains({t}, k)) || regexp_extract_all({t}, '[a-zA-Z]{{3,}}') || "
        f"flatten(list_transform({cjk}, lambda r: [r] || list_transform(range(1, len(r)), lambda i: substr(r, i, 2)))))"
    )


def sql_query_terms(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    return f"list_distinct(list_filter({_KEYWORDS}, lambda k: contains({t}, k)) || regexp_extract_all({t}, '[a-zA-Z]{{3,}}') || regexp_extract_all({t}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'))"


_DOC_TEXT = {
    "base": "text",
    "metadata": "concat_ws(chr(10), lang, source, source, text, concat_ws(chr(10), source, lang))",
    "weighted": "concat_ws(chr(10), lang, source, source, text, concat_ws(chr(10), source, lang, lang, lang))",
}


def sql_bm25(mode: str, k: int, name: str, docs: str = "documents", queries: str = "benchmark") -> str:
    return f"""
{name}_tokens AS (SELECT doc_id, {sql_tokens(_DOC_TEXT[mode])} AS terms FROM {docs}),
{name}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(terms)) AS avgdl FROM {name}_tokens),
{name}_tf AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM {name}_tokens) GROUP BY ALL),
{name}_tf2 AS (SELECT doc_id, term, sum(tf) AS tf, any_value(length) AS length FROM {name}_tf GROUP BY doc_id, term),
{name}_df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM {name}_tf2 GROUP BY term),
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({sql_tokens("text")}) AS term FROM {queries}) GROUP BY ALL),
{name}_s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {V.BM25_K1 + 1} / (tf + {V.BM25_K1} * (1 - {V.BM25_B} + {V.BM25_B} * length / avgdl))) * qtf), {DIGITS}) AS score
  FROM {name}_tf2 JOIN {name}_q USING (term) JOIN {name}_df USING (term) CROSS JOIN {name}_n GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


def sql_keyword(k: int, name: str) -> str:
    return f"""
{name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens("text")}) AS term FROM documents) GROUP BY ALL),
{name}_q AS (SELECT item_id AS query_id, unnest({sql_query_terms("text")}) AS term FROM benchmark),
{name}_s AS (SELECT query_id, doc_id, CAST(sum(tf + CASE WHEN list_contains({_KEYWORDS}, term) THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM {name}_tf JOIN {name}_q USING (term) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {name}_s) WHERE rank <= {k})"""


_VECTOR = f"""
vq AS (SELECT vec_id AS query_id, label AS query_label, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0),
vs AS (SELECT query_id, query_label, vec_id, label, round(list_dot_product(x, embedding::DOUBLE[]), {DIGITS}) AS score FROM vq, embeddings WHERE vec_id <> query_id),
vector AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM vs) WHERE rank <= 10)"""


# --- lexical ----------------------------------------------------------------------------------------------------


def tokenize_docs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return retrieval.postings(docs, "doc_id", F.col("text")).select(F.col("id").alias("doc_id"), "term", "tf", "length")


TOKENIZE_SQL = f"""
SELECT doc_id, term, count(*) AS tf, any_value(length) AS length
FROM (SELECT doc_id, unnest(terms) AS term, CAST(len(terms) AS BIGINT) AS length FROM (SELECT doc_id, {sql_tokens("text")} AS terms FROM documents)) GROUP BY doc_id, term
"""


def term_stats(spark, sf_dir):
    return retrieval.term_stats(retrieval.postings(_docs(spark, sf_dir), "doc_id", F.col("text")))


TERM_STATS_SQL = f"""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf
FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens("text")}) AS term FROM documents) GROUP BY ALL) GROUP BY term
"""


def document_text(mode: str) -> Column:
    """What BM25 indexes of a document in a metadata mode."""
    meta = T.metadata_search_text({"summary": F.col("source"), "inferred.diagnosis_tags": F.col("lang")}, weighted=mode == "weighted")
    return F.col("text") if mode == "base" else T.document_text(F.col("lang"), F.col("source"), F.col("source"), F.col("text"), meta)


def bm25_list(spark, sf_dir, k=5, mode="base", stored: index.Bm25Index | None = None):
    """By the stored index if there is one, else by one that lives for this query."""
    if stored is not None:
        return stored.search(_queries(spark, sf_dir), k)
    return retrieval.bm25(_queries(spark, sf_dir), _docs(spark, sf_dir), k, doc_text=document_text(mode))


def keyword_list(spark, sf_dir, k=5):
    return retrieval.keyword_search(_queries(spark, sf_dir), _docs(spark, sf_dir), k)


def vector_list(spark, sf_dir, k=10):
    v = _t(spark, sf_dir, "embeddings")
    q = v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_search(q, v, k, exclude_self=True)


def _list_sql(parts: str, name: str, columns: str) -> str:
    return f"WITH {parts} SELECT {columns} FROM {name}"


def adjacent_similarity(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    after = Window.partitionBy("label").orderBy("vec_id")
    return v.select("vec_id", "label", F.coalesce(F.lead("vec_id").over(after), F.lit(-1)).alias("next_id"), F.round(T.dot(F.col("embedding"), F.lead("embedding").over(after)), DIGITS).alias("similarity"))


ADJACENT_SQL = f"""
SELECT vec_id, label, coalesce(lead(vec_id) OVER w, -1) AS next_id, round(list_dot_product(embedding::DOUBLE[], (lead(embedding) OVER w)::DOUBLE[]), {DIGITS}) AS similarity
FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)
"""

# --- fusion -----------------------------------------------------------------------------------------------------


def ranked_lists(spark, sf_dir, k=20, stored=None):
    """Two ranked lists of documents for each benchmark passage."""
    named = lambda df, m: df.select("query_id", F.col("doc_id").alias("key"), F.lit(m).alias("method"), "score", "rank")
    if stored is not None:
        bm25, keyword = bm25_list(spark, sf_dir, k, stored=stored), keyword_list(spark, sf_dir, k)
    else:
        bm25, keyword = retrieval.bm25_and_keyword(_queries(spark, sf_dir), _docs(spark, sf_dir), k)
    return named(bm25, "bm25").unionByName(named(keyword, "keyword"))


_LISTS = f"""{sql_bm25("base", 20, "b")},
{sql_keyword(20, "kw")},
lists AS (SELECT query_id, doc_id AS key, 'bm25' AS method, score, rank FROM b UNION ALL SELECT query_id, doc_id, 'keyword', score, rank FROM kw),
normal AS (SELECT *, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS normalized FROM lists WINDOW w AS (PARTITION BY query_id, method))"""
_TOP = "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM {}) WHERE rank <= 5"
_WEIGHTS = {"bm25": 0.85, "keyword": 0.15}


def normalized(spark, sf_dir):
    return fusion.normalize_scores(ranked_lists(spark, sf_dir)).withColumn("normalized", F.round("normalized", DIGITS))


def merged(spark, sf_dir):
    return fusion.merge_ranked(ranked_lists(spark, sf_dir), ["bm25", "keyword"]).fillna(0)


MERGED_SQL = f"""WITH {_LISTS}
SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.key, y.key) AS key, coalesce(x.score, 0) AS bm25_score, coalesce(x.rank, 0) AS bm25_rank, coalesce(y.score, 0) AS keyword_score, coalesce(y.rank, 0) AS keyword_rank
FROM (SELECT * FROM lists WHERE method = 'bm25') x FULL JOIN (SELECT * FROM lists WHERE method = 'keyword') y ON x.query_id = y.query_id AND x.key = y.key
"""


def linear(spark, sf_dir, stored=None):
    return fusion.linear_fusion(ranked_lists(spark, sf_dir, stored=stored), _WEIGHTS)


LINEAR_SQL = f"""WITH {_LISTS}, fused AS (SELECT query_id, key, round(sum(CASE method WHEN 'bm25' THEN 0.85 ELSE 0.15 END * normalized), {DIGITS}) AS score FROM normal GROUP BY query_id, key)
{_TOP.format("fused")}"""


def rrf(spark, sf_dir, stored=None):
    return fusion.rrf_fusion(ranked_lists(spark, sf_dir, stored=stored), ["bm25", "keyword"]).select("query_id", "key", "score", "sources", "rank")


RRF_SQL = f"""WITH {_LISTS}, fused AS (SELECT query_id, key, round(sum(1.0::DOUBLE / ({V.RRF_K} + rank)), {DIGITS}) AS score, list(method ORDER BY method) AS sources FROM lists GROUP BY query_id, key)
{_TOP.format("fused")}"""


def two_stage(spark, sf_dir, stored=None):
    """Twenty BM25 candidates, reranked by a stand-in scorer (how close the lengths are), best five."""
    found = bm25_list(spark, sf_dir, 20, stored=stored)
    pairs = found.join(_queries(spark, sf_dir), "query_id").join(_texts_of(found, spark, sf_dir), "doc_id")
    score = lambda q, d: F.round(1 / (1.0 + F.abs(F.length(q) - F.length(d))), DIGITS)
    return retrieval.rerank(pairs, score, "query", "text", 5).select("query_id", "doc_id", "rank", "rerank_score", "rerank_rank")


TWO_STAGE_SQL = f"""WITH {sql_bm25("base", 20, "b")},
scored AS (SELECT b.query_id, b.doc_id, b.rank, round(1 / (1.0::DOUBLE + abs(length(q.text) - length(d.text))), {DIGITS}) AS rerank_score FROM b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d ON d.doc_id = b.doc_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS INTEGER) AS rerank_rank FROM scored) WHERE rerank_rank <= 5
"""


def union_candidates(spark, sf_dir):
    return fusion.candidate_union(ranked_lists(spark, sf_dir))


UNION_SQL = f"""WITH {_LISTS}, best AS (SELECT query_id, key, min(rank) AS best_rank FROM lists GROUP BY query_id, key)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_rank, key) AS INTEGER) AS position FROM best"""


def overlap(spark, sf_dir):
    return fusion.candidate_overlap(ranked_lists(spark, sf_dir), "bm25", "keyword")


OVERLAP_SQL = f"""WITH {_LISTS}, each AS (SELECT query_id, key, bool_or(method = 'bm25') AS a, bool_or(method = 'keyword') AS b FROM lists GROUP BY query_id, key)
SELECT query_id, CAST(count(*) FILTER (a) AS INTEGER) AS bm25, CAST(count(*) FILTER (b) AS INTEGER) AS keyword, CAST(count(*) FILTER (a AND b) AS INTEGER) AS shared,
       CAST(count(*) FILTER (b AND NOT a) AS INTEGER) AS added, round(count(*) FILTER (a AND b) / count(*), {DIGITS}) AS jaccard FROM each GROUP BY query_id"""


def rank_changes(spark, sf_dir):
    lists = ranked_lists(spark, sf_dir)
    one = lambda m: lists.filter(F.col("method") == m).select("query_id", "key", "rank")
    return fusion.rank_change(one("bm25"), one("keyword")).fillna(0)


RANK_CHANGE_SQL = f"""WITH {_LISTS}
SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.key, y.key) AS key, coalesce(x.rank, 0) AS before, coalesce(y.rank, 0) AS after, coalesce(y.rank - x.rank, 0) AS change,
       CASE WHEN coalesce(x.rank <= 5, false) AND NOT coalesce(y.rank <= 5, false) THEN 'out' WHEN coalesce(y.rank <= 5, false) AND NOT coalesce(x.rank <= 5, false) THEN 'in' ELSE 'same' END AS moved
FROM (SELECT * FROM lists WHERE method = 'bm25') x FULL JOIN (SELECT * FROM lists WHERE method = 'keyword') y ON x.query_id = y.query_id AND x.key = y.key
"""

# --- the pipeline ---------------------------------------------------------------------------------------------------


def indexed(spark, sf_dir):
    """BM25 by a stored index, written, read and searched."""
    path = f"{tempfile.mkdtemp(prefix='tarn-index-') if spark.sparkContext.master.startswith('local') else spark.conf.get('spark.checkpoint.dir')}/bm25-{uuid.uuid4().hex}"
    index.write_bm25_index(_docs(spark, sf_dir), path)
    return index.read_bm25_index(spark, path).search(_queries(spark, sf_dir), 5)


def _texts_of(ranked, spark, sf_dir):
    """(doc_id, text) of ranked documents: texts of others aren't shuffled."""
    ids = ranked.select("doc_id").distinct()
    return _docs(spark, sf_dir).select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _vector_texts(spark, sf_dir):
    """(doc_id, text) of documents that have a vector; texts aren't shuffled."""
    ids = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return _docs(spark, sf_dir).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _both(spark, sf_dir):
    """Documents that have a vector, without their texts but for their lengths; every twentieth is a query by text and vector."""
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    docs = _vector_texts(spark, sf_dir).select("doc_id", "lang", "source", F.length("text").alias("n_chars")).join(v, "doc_id")
    docs = materialize(docs, "with-vectors")  # a short row each; every retriever and metric reads it
    every = lambda rows: rows.filter("doc_id % 20 = 0")
    queries = every(_vector_texts(spark, sf_dir)).select("doc_id", F.col("text").alias("query")).join(every(docs).select("doc_id", "embedding", "label"), "doc_id")
    return docs, queries.withColumnRenamed("doc_id", "query_id")


def _retrievers(docs: DataFrame, texts: DataFrame, stored: index.Bm25Index | None = None) -> dict[str, hybrid.Retriever]:
    """BM25 over the texts (doc_id, text) of docs, whose results know their language as chapter, and vector search, whose results know their source as section."""
    about = docs.select(F.col("doc_id").alias("key"), F.concat(F.lit("ch"), "lang").alias("chapter_id"), F.concat(F.lit("s"), "source").alias("section_id"))

    def bm25(queries, k):
        found = retrieval.bm25(queries, texts, k) if stored is None else stored.search(queries, k)
        return found.withColumnRenamed("doc_id", "key").join(about.drop("section_id"), "key")

    def embedding(queries, k):
        found = retrieval.vector_search(queries, docs.withColumnRenamed("doc_id", "vec_id"), k)
        return found.withColumnRenamed("vec_id", "key").join(about.drop("chapter_id"), "key")

    return {"bm25": bm25, "embedding": embedding}


def _flat(results: DataFrame) -> DataFrame:
    gaps = {c: 0 for c in ("bm25_score", "bm25_rank", "embedding_score", "embedding_rank")} | {c: "" for c in ("chapter_id", "section_id", "chapter_number", "section_number")}
    return results.withColumn("sources", F.array_join("sources", ",")).fillna(gaps).drop("summary")


def hybrid_topk(spark, sf_dir, stored=None):
    docs, queries = _both(spark, sf_dir)
    return _flat(hybrid.retrieve(_retrievers(docs, _vector_texts(spark, sf_dir), stored), queries, "hybrid", 5))


def hybrid_rerank(spark, sf_dir):
    """Candidates are scored by a stand-in, how close the lengths of query and document are."""
    docs, queries = _both(spark, sf_dir)

    def score(candidates):
        pairs = candidates.join(queries.select("query_id", F.length("query").alias("a")), "query_id").join(docs.select(F.col("doc_id").alias("key"), F.col("n_chars").alias("b")), "key")
        return pairs.withColumn("rerank_score", F.round(1 / (1.0 + F.abs(F.col("a") - F.col("b"))), DIGITS)).drop("a", "b")

    return hybrid.retrieve(_retrievers(docs, _vector_texts(spark, sf_dir)), queries, "hybrid_rerank", 5, score=score).select("query_id", "key", "rank", "score", "retrieval_method", F.array_join("sources", ",").alias("sources"))


def hybrid_linear(spark, sf_dir, stored=None):
    docs, queries = _both(spark, sf_dir)
    return hybrid.linear(_retrievers(docs, _vector_texts(spark, sf_dir), stored), queries, 5).select("query_id", "key", "rank", "score", "retrieval_method", F.array_join("sources", ",").alias("sources"))


def observed(spark, sf_dir):
    docs, queries = _both(spark, sf_dir)
    seen = hybrid.observation(hybrid.retrieve(_retrievers(docs, _vector_texts(spark, sf_dir)), queries, "hybrid", 5))
    return seen.select("query_id", "status", "chunk_count", "top_score", "top_embedding_score", F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["rank"].cast("string"), c["retrieval_method"], F.coalesce(c["keyword_rank"], F.lit(0)).cast("string"))), ",").alias("chunks"))


def _case_lists(spark, sf_dir, k=50):
    """Lists of both retrievers; a result of the query's label holds its language as evidence."""
    docs, queries = _both(spark, sf_dir)
    lists = materialize(hybrid.ranked_lists(_retrievers(docs, _vector_texts(spark, sf_dir)), queries, k).withColumnRenamed("query_id", "case_id"), "lists")
    return lists, *_evidence(docs, queries, lists)


def _evidence(docs, queries, lists):
    """Evidence that the results in ``lists`` hold, and the number that each case has; the pairs of a case and a document that no list has are never made."""
    label = queries.select(F.col("query_id").alias("case_id"), "label")
    held = docs.select(F.col("doc_id").alias("key"), "label", F.col("lang").alias("evidence"))
    matches = lists.select("case_id", "key").distinct().join(label, "case_id").join(held, ["key", "label"]).select("case_id", "key", "evidence")
    cases = label.join(held.groupBy("label").agg(F.count_distinct("evidence").cast("int").alias("n_evidence")), "label").select("case_id", "n_evidence")
    return matches, cases


def candidate_coverage(spark, sf_dir):
    lists, matches, _ = _case_lists(spark, sf_dir)
    return E.candidate_coverage(lists, matches)


def candidate_pool(spark, sf_dir):
    lists, matches, cases = _case_lists(spark, sf_dir, 3)
    return E.candidate_pool(cases, lists, matches)


def multi_metrics(spark, sf_dir):
    """Metrics of vector search with several evidences a case."""
    lists, matches, cases = _case_lists(spark, sf_dir, 10)
    ranked = lists.filter("method = 'embedding'").select("case_id", "key", "rank")
    return E.hits_to_metrics(cases, ranked.select("case_id", "rank"), ranked.join(matches, ["case_id", "key"]).select("case_id", "rank", "evidence"))


def benchmark_grid(spark, sf_dir):
    """Both retrievers over all cases, with several evidences a case."""
    docs, queries = _both(spark, sf_dir)
    lists = materialize(hybrid.grid(_retrievers(docs, _vector_texts(spark, sf_dir)), queries, 10).withColumnRenamed("query_id", "case_id"), "grid")
    matches, cases = _evidence(docs, queries, lists)
    return benchmark.results_of(lists, cases, matches)


def _hybrid_sql(k: int) -> str:
    """Lists of k of both retrievers."""
    return f"""hdocs AS (SELECT d.doc_id, d.text, d.lang, d.source, e.embedding::DOUBLE[] AS x, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
hq AS (SELECT doc_id AS item_id, text, x, label, lang FROM hdocs WHERE doc_id % 20 = 0),
{sql_bm25("base", k, "hb", "hdocs", "hq")},
hv AS (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT hq.item_id AS query_id, doc_id, round(list_dot_product(hq.x, d.x), {DIGITS}) AS score FROM hq, hdocs d)) WHERE rank <= {k}),
merged AS (SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.doc_id, v.doc_id) AS key, b.score AS bs, b.rank AS br, v.score AS vs, v.rank AS vr,
  CASE WHEN br IS NULL THEN 'embedding' WHEN vr IS NULL THEN 'bm25' ELSE 'bm25,embedding' END AS sources FROM hb b FULL JOIN hv v ON b.query_id = v.query_id AND b.doc_id = v.doc_id)"""


_RRF = f"rrf AS (SELECT *, round(coalesce(1.0::DOUBLE / ({V.RRF_K} + br), 0) + coalesce(1.0::DOUBLE / ({V.RRF_K} + vr), 0), {DIGITS}) AS score FROM merged)"
_BY_SCORE = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank"
HYBRID_SQL = f"""WITH {_hybrid_sql(100)}, {_RRF}, r AS (SELECT *, {_BY_SCORE} FROM rrf)
SELECT query_id, key, rank, r.score, sources, CASE WHEN br IS NULL THEN 'embedding' WHEN vr IS NULL THEN 'keyword' ELSE 'hybrid_rrf' END AS retrieval_method,
  coalesce(bs, 0) AS bm25_score, coalesce(br, 0) AS bm25_rank, coalesce(vs, 0) AS embedding_score, coalesce(vr, 0) AS embedding_rank,
  CASE WHEN br IS NULL THEN '' ELSE 'ch' || lang END AS chapter_id, CASE WHEN vr IS NULL THEN '' ELSE 's' || source END AS section_id,
  CASE WHEN br IS NULL THEN '' ELSE lang END AS chapter_number, CASE WHEN vr IS NULL THEN '' ELSE source END AS section_number
FROM r JOIN documents ON doc_id = key WHERE rank <= 5"""
HYBRID_RERANK_SQL = f"""WITH {_hybrid_sql(100)}, {_RRF}, r AS (SELECT *, {_BY_SCORE} FROM rrf),
s AS (SELECT r.query_id, key, sources, round(1 / (1.0::DOUBLE + abs(length(q.text) - length(d.text))), {DIGITS}) AS score FROM r JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = key WHERE rank <= 25)
SELECT query_id, key, rank, score, 'hybrid_rerank' AS retrieval_method, sources FROM (SELECT *, {_BY_SCORE} FROM s) WHERE rank <= 5"""
HYBRID_LINEAR_SQL = f"""WITH {_hybrid_sql(25)}, n AS (SELECT *, max(bs) OVER (PARTITION BY query_id) AS mb, max(vs) OVER (PARTITION BY query_id) AS mv FROM merged),
l AS (SELECT *, round(coalesce(CASE WHEN mb > 0 THEN 0.15 * (bs / mb) END, 0) + coalesce(CASE WHEN mv > 0 THEN 0.85 * (vs / mv) END, 0), {DIGITS}) AS score FROM n)
SELECT query_id, key, rank, score, CASE WHEN br IS NULL THEN 'embedding' WHEN vr IS NULL THEN 'keyword' ELSE 'hybrid' END AS retrieval_method, sources FROM (SELECT *, {_BY_SCORE} FROM l) WHERE rank <= 5"""
OBSERVED_SQL = f"""WITH {_hybrid_sql(100)}, {_RRF}, r AS (SELECT *, {_BY_SCORE} FROM rrf)
SELECT query_id, 'observation' AS status, count(*) AS chunk_count, max(score) AS top_score, max(coalesce(vs, 0)) AS top_embedding_score,
  string_agg(rank || ':' || CASE WHEN br IS NULL THEN 'embedding' WHEN vr IS NULL THEN 'keyword' ELSE 'hybrid_rrf' END || ':' || coalesce(br, 0), ',' ORDER BY rank) AS chunks FROM r WHERE rank <= 5 GROUP BY query_id"""


def _case_sql(k: int) -> str:
    return f"""{_hybrid_sql(k)}, listed AS (SELECT query_id, key, 'bm25' AS method, br AS rank FROM merged WHERE br IS NOT NULL UNION ALL SELECT query_id, key, 'embedding', vr FROM merged WHERE vr IS NOT NULL),
held AS (SELECT item_id AS query_id, d.doc_id AS key, d.lang AS evidence FROM hq JOIN hdocs d ON d.label = hq.label)"""


COVERAGE_SQL = f"""WITH {_case_sql(50)}, best AS (SELECT query_id, key, min(rank) AS best, arg_min(method, rank * 2 + (method = 'embedding')::INT) AS of FROM listed GROUP BY ALL),
every AS (SELECT * FROM listed UNION ALL SELECT query_id, key, 'union', row_number() OVER (PARTITION BY query_id ORDER BY best, of, key) FROM best)
SELECT query_id AS case_id, method AS list, CAST(k AS INTEGER) AS "limit", count(DISTINCT evidence) FILTER (rank <= k) AS covered FROM every LEFT JOIN held USING (query_id, key), (SELECT unnest([20, 50]) AS k) GROUP BY query_id, method, k"""
POOL_SQL = f"""WITH {_case_sql(3)}, n AS (SELECT query_id, count(DISTINCT evidence) AS n FROM held GROUP BY 1), c AS (SELECT query_id, count(DISTINCT evidence) AS c FROM listed JOIN held USING (query_id, key) GROUP BY 1)
SELECT query_id AS case_id, CAST(coalesce(c, 0) > 0 AS DOUBLE) AS candidate_pool_hit, round(coalesce(c, 0) / n, {DIGITS}) AS candidate_pool_recall FROM n LEFT JOIN c USING (query_id)"""
MULTI_SQL = f"""WITH {_case_sql(10)}, n AS (SELECT query_id, count(DISTINCT evidence) AS n FROM held GROUP BY 1), v AS (SELECT * FROM listed WHERE method = 'embedding'),
f AS (SELECT query_id, evidence, min(rank) AS rank FROM v JOIN held USING (query_id, key) GROUP BY ALL), rel AS (SELECT DISTINCT query_id, rank FROM v JOIN held USING (query_id, key)), ks AS (SELECT unnest([1, 3, 5]) AS k),
e AS (SELECT query_id, k, n, (SELECT count(*) FROM rel WHERE rel.query_id = n.query_id AND rank <= k) AS hits, (SELECT count(*) FROM f WHERE f.query_id = n.query_id AND rank <= k) AS covered,
  (SELECT coalesce(sum(1 / log2(r + 1.0::DOUBLE)), 0) FROM (SELECT DISTINCT rank AS r FROM f WHERE f.query_id = n.query_id AND rank <= k)) AS dcg,
  list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) AS idcg, (SELECT min(rank) FROM rel WHERE rel.query_id = n.query_id) AS first, (SELECT max(rank) FROM v WHERE v.query_id = n.query_id) AS returned FROM n, ks)
SELECT query_id AS case_id, 'hit@' || k AS metric, CAST(hits > 0 AS DOUBLE) AS value FROM e UNION ALL SELECT query_id, 'precision@' || k, round(hits / k, {DIGITS}) FROM e UNION ALL SELECT query_id, 'recall@' || k, round(covered / n, {DIGITS}) FROM e
UNION ALL SELECT query_id, 'recall_ref@' || k, CASE WHEN returned >= k THEN round(covered / n, {DIGITS}) ELSE 0 END FROM e UNION ALL SELECT query_id, 'ndcg@' || k, round(dcg / idcg, {DIGITS}) FROM e
UNION ALL SELECT query_id, 'mrr', round(coalesce(1.0::DOUBLE / first, 0), {DIGITS}) FROM e WHERE k = 1 UNION ALL SELECT query_id, 'mrr@5', round(CASE WHEN first <= 5 THEN 1.0::DOUBLE / first ELSE 0 END, {DIGITS}) FROM e WHERE k = 1"""

#: The same for both methods.
GRID_SQL = "SELECT 'embedding' AS method, 1 AS method_order, * FROM (" + MULTI_SQL + ") UNION ALL SELECT 'bm25', 0, * FROM (" + MULTI_SQL.replace("WHERE method = 'embedding'),", "WHERE method = 'bm25'),") + ")"

# --- evaluation --------------------------------------------------------------------------------------------------


def _label_cases(spark, sf_dir):
    """Cases, ranked lists and matches of vector search: a neighbour is relevant if it has the query's label."""
    v = _t(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked = vector_list(spark, sf_dir)
    cases = v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("case_id"), F.lit(1).alias("n_evidence"), "label")
    hits = ranked.join(v, "vec_id").join(cases.select(F.col("case_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").filter("label = wanted")
    return cases, ranked.select(F.col("query_id").alias("case_id"), "rank"), hits.select(F.col("query_id").alias("case_id"), "rank", F.lit(0).alias("evidence"))


def vector_metrics(spark, sf_dir):
    cases, ranked, matches = _label_cases(spark, sf_dir)
    return E.hits_to_metrics(cases.drop("label"), ranked, matches)


_METRICS = f"""{_VECTOR},
rel AS (SELECT query_id AS case_id, list(rank ORDER BY rank) FILTER (label = query_label) AS ranks, min(rank) FILTER (label = query_label) AS first, max(rank) AS returned FROM vector GROUP BY query_id),
ks AS (SELECT unnest([1, 3, 5]) AS k),
each AS (SELECT case_id, k, coalesce(len(list_filter(ranks, lambda r: r <= k)), 0) AS n, coalesce(first, 1000000) AS first, returned FROM rel, ks),
results AS (
  SELECT case_id, 'hit@' || k AS metric, CAST(n > 0 AS DOUBLE) AS value FROM each
  UNION ALL SELECT case_id, 'precision@' || k, round(n / k, {DIGITS}) FROM each
  UNION ALL SELECT case_id, 'recall@' || k, CAST(first <= k AS DOUBLE) FROM each
  UNION ALL SELECT case_id, 'recall_ref@' || k, CASE WHEN returned >= k THEN CAST(first <= k AS DOUBLE) ELSE 0 END FROM each
  UNION ALL SELECT case_id, 'ndcg@' || k, round(CASE WHEN first <= k THEN 1 / log2(CAST(first AS DOUBLE) + 1) ELSE 0 END, {DIGITS}) FROM each
  UNION ALL SELECT case_id, 'mrr', round(coalesce(1.0::DOUBLE / first, 0), {DIGITS}) FROM rel
  UNION ALL SELECT case_id, 'mrr@5', round(CASE WHEN first <= 5 THEN 1.0::DOUBLE / first ELSE 0 END, {DIGITS}) FROM rel)"""


def metric_summary(spark, sf_dir):
    cases, ranked, matches = _label_cases(spark, sf_dir)
    results = E.hits_to_metrics(cases.drop("label"), ranked, matches).join(cases.select("case_id", F.col("label").cast("string").alias("topic")), "case_id")
    results = results.withColumns({"method": F.lit("vector"), "split": F.when(F.col("case_id") % 40 == 0, "dev").otherwise("test")})
    return E.summarize(results, ["topic", "split"])


SUMMARY_SQL = f"""WITH {_METRICS}, tagged AS (SELECT 'vector' AS method, r.metric, r.value, CAST(e.label AS VARCHAR) AS topic, CASE WHEN r.case_id % 40 = 0 THEN 'dev' ELSE 'test' END AS split FROM results r JOIN embeddings e ON e.vec_id = r.case_id)
SELECT method, metric, topic, split, round(avg(value), 6) AS mean, count(*) AS cases FROM tagged GROUP BY GROUPING SETS ((method, metric), (method, metric, topic), (method, metric, split))"""


def _two_methods(spark, sf_dir):
    """Results of BM25 without and with metadata: a document is relevant if it contains the passage."""
    cases = _queries(spark, sf_dir)
    out = None
    for order, (name, mode) in enumerate((("base", "base"), ("metadata", "metadata"))):
        found = bm25_list(spark, sf_dir, 5, mode)
        ranked = found.join(cases, "query_id").join(_texts_of(found, spark, sf_dir), "doc_id")
        wanted, there = (T.normalize_evidence(F.col(c), compose=False) for c in ("query", "text"))
        hits = ranked.filter((wanted != "") & F.contains(there, wanted)).select(F.col("query_id").alias("case_id"), "rank", F.lit(0).alias("evidence"))
        hits = materialize(hits, "hits")  # k rows a case at most; the metrics read them several times
        rows = E.hits_to_metrics(cases.select(F.col("query_id").alias("case_id"), F.lit(1).alias("n_evidence")), found.select(F.col("query_id").alias("case_id"), "rank"), hits, (1, 5))
        rows = rows.withColumns({"method": F.lit(name), "method_order": F.lit(order)})
        out = rows if out is None else out.unionByName(rows)
    return out


def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"


_TWO = f"""{sql_bm25("base", 5, "b")},
{sql_bm25("metadata", 5, "m")},
pair AS (SELECT 'base' AS method, 0 AS method_order, * FROM b UNION ALL SELECT 'metadata', 1, * FROM m),
found AS (SELECT method, method_order, query_id, rank, {_norm("q.text")} <> '' AND contains({_norm("d.text")}, {_norm("q.text")}) AS hit FROM pair JOIN benchmark q ON q.item_id = query_id JOIN documents d USING (doc_id)),
methods AS (SELECT * FROM (VALUES ('base', 0), ('metadata', 1)) x(method, method_order)),
rel AS (SELECT m.method, m.method_order, q.item_id AS case_id, list(f.rank ORDER BY f.rank) FILTER (f.hit) AS ranks, min(f.rank) FILTER (f.hit) AS first, coalesce(max(f.rank), 0) AS returned
  FROM methods m CROSS JOIN benchmark q LEFT JOIN found f ON f.query_id = q.item_id AND f.method = m.method GROUP BY ALL),
ks AS (SELECT unnest([1, 5]) AS k),
each AS (SELECT method, method_order, case_id, k, coalesce(len(list_filter(ranks, lambda r: r <= k)), 0) AS n, coalesce(first, 1000000) AS first, returned FROM rel, ks),
results AS (
  SELECT method, method_order, case_id, 'hit@' || k AS metric, CAST(n > 0 AS DOUBLE) AS value FROM each
  UNION ALL SELECT method, method_order, case_id, 'precision@' || k, round(n / k, {DIGITS}) FROM each
  UNION ALL SELECT method, method_order, case_id, 'recall@' || k, CAST(first <= k AS DOUBLE) FROM each
  UNION ALL SELECT method, method_order, case_id, 'recall_ref@' || k, CASE WHEN returned >= k THEN CAST(first <= k AS DOUBLE) ELSE 0 END FROM each
  UNION ALL SELECT method, method_order, case_id, 'ndcg@' || k, round(CASE WHEN first <= k THEN 1 / log2(CAST(first AS DOUBLE) + 1) ELSE 0 END, {DIGITS}) FROM each
  UNION ALL SELECT method, method_order, case_id, 'mrr', round(coalesce(1.0::DOUBLE / first, 0), {DIGITS}) FROM rel
  UNION ALL SELECT method, method_order, case_id, 'mrr@5', round(CASE WHEN first <= 5 THEN 1.0::DOUBLE / first ELSE 0 END, {DIGITS}) FROM rel)"""


def best_methods(spark, sf_dir):
    summary = _two_methods(spark, sf_dir).groupBy("method", "method_order", "metric").agg(F.round(F.avg("value"), 6).alias("mean"))
    return E.best_method(summary)


BEST_SQL = f"""WITH {_TWO}, summary AS (SELECT method, method_order, metric, round(avg(value), 6) AS mean FROM results GROUP BY ALL)
SELECT metric, arg_max(method, mean * 1000 - method_order) AS best, max(mean) AS value FROM summary GROUP BY metric"""


def deltas(spark, sf_dir):
    return E.paired_delta(_two_methods(spark, sf_dir), "base")


DELTA_SQL = f"""WITH {_TWO}
SELECT r.method, r.metric, round(avg(r.value - b.value), 6) AS mean_delta, count(*) FILTER (r.value > b.value) AS better, count(*) FILTER (r.value < b.value) AS worse, count(*) AS cases
FROM results r JOIN results b ON b.method = 'base' AND r.method <> 'base' AND r.case_id = b.case_id AND r.metric = b.metric GROUP BY r.method, r.metric"""


def distributions(spark, sf_dir):
    return E.distribution(_two_methods(spark, sf_dir), ["method", "metric"])


DISTRIBUTION_SQL = f"""WITH {_TWO} SELECT method, metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, count(*) AS n FROM results GROUP BY method, metric"""


def coverage(spark, sf_dir):
    found = bm25_list(spark, sf_dir)
    texts = _texts_of(found, spark, sf_dir).withColumnRenamed("text", "content")
    ranked = materialize(found.join(texts, "doc_id").select(F.col("query_id").alias("case_id"), "rank", "content"), "contents")
    gold = _queries(spark, sf_dir).select(F.col("query_id").alias("case_id"), F.lit(0).alias("evidence"), F.col("query").alias("text"))
    return E.evidence_coverage(ranked, gold, 5, compose=False)


_UNITS = f"list_filter(flatten(list_transform(string_split_regex(q.text, '\\n\\s*\\n'), lambda p: list_transform(regexp_extract_all(p, '{V.SENTENCE}'), lambda u: {_norm('u')}))), lambda u: u <> '')"
COVERED_SQL = f"""WITH {sql_bm25("base", 5, "b")},
c AS (SELECT query_id AS case_id, rank, {_norm("d.text")} AS c FROM b JOIN documents d USING (doc_id)),
g AS (SELECT item_id AS case_id, {_norm("q.text")} AS n, {_UNITS} AS units FROM benchmark q), w AS (SELECT case_id, n, unnest(list_distinct(units || [n])) AS needle FROM g WHERE n <> ''),
f AS (SELECT c.case_id, rank, c, n, needle FROM c JOIN w USING (case_id) WHERE contains(c, needle)),
o AS (SELECT case_id, rank, n, unnest(list_filter(range(1, length(c) - length(needle) + 2), lambda i: substr(c, i, length(needle)) = needle)) AS pos, length(needle) AS k FROM f),
shared AS (SELECT case_id, count(*) AS shared FROM (SELECT DISTINCT case_id, rank, n, unnest(range(pos, pos + k)) AS p FROM o) GROUP BY case_id),
m AS (SELECT case_id, n, unnest(list_filter(range(1, length(n) - length(needle) + 2), lambda i: substr(n, i, length(needle)) = needle)) AS pos, length(needle) AS k FROM (SELECT DISTINCT case_id, n, needle FROM f)),
mine AS (SELECT case_id, count(*) AS covered FROM (SELECT DISTINCT case_id, n, unnest(range(pos, pos + k)) AS p FROM m) GROUP BY case_id),
total AS (SELECT case_id, sum(length(n)) AS total FROM g GROUP BY case_id), chars AS (SELECT case_id, sum(length(c)) AS chars FROM c GROUP BY case_id)
SELECT item_id AS case_id, CASE WHEN total > 0 THEN round(coalesce(covered, 0) / total, {DIGITS}) ELSE 0 END AS coverage, CASE WHEN chars > 0 THEN round(coalesce(shared, 0) / chars, {DIGITS}) ELSE 0 END AS density
FROM benchmark LEFT JOIN total ON total.case_id = item_id LEFT JOIN chars ON chars.case_id = item_id LEFT JOIN mine ON mine.case_id = item_id LEFT JOIN shared ON shared.case_id = item_id"""


QUERIES = {
    "bm25_topk": (bm25_list, _list_sql(sql_bm25("base", 5, "b"), "b", "query_id, doc_id, score, rank")),
    "bm25_metadata_topk": (lambda s, d: bm25_list(s, d, 5, "metadata"), _list_sql(sql_bm25("metadata", 5, "b"), "b", "query_id, doc_id, score, rank")),
    "bm25_weighted_topk": (lambda s, d: bm25_list(s, d, 5, "weighted"), _list_sql(sql_bm25("weighted", 5, "b"), "b", "query_id, doc_id, score, rank")),
    "keyword_topk": (keyword_list, _list_sql(sql_keyword(5, "kw"), "kw", "query_id, doc_id, score, rank")),
    "vector_topk": (vector_list, _list_sql(_VECTOR, "vector", "query_id, vec_id, score, rank")),
    "adjacent_similarity": (adjacent_similarity, ADJACENT_SQL),
    "tokenize_docs": (tokenize_docs, TOKENIZE_SQL),
    "term_stats": (term_stats, TERM_STATS_SQL),
    "normalize_scores": (normalized, f"WITH {_LISTS} SELECT query_id, key, method, score, rank, round(normalized, {DIGITS}) AS normalized FROM normal"),
    "merge_ranked": (merged, MERGED_SQL),
    "linear_fusion": (linear, LINEAR_SQL),
    "rrf_fusion": (rrf, RRF_SQL),
    "two_stage_topk": (two_stage, TWO_STAGE_SQL),
    "candidate_union": (union_candidates, UNION_SQL),
    "candidate_overlap": (overlap, OVERLAP_SQL),
    "bm25_index_topk": (indexed, _list_sql(sql_bm25("base", 5, "b"), "b", "query_id, doc_id, score, rank")),
    "hybrid_topk": (hybrid_topk, HYBRID_SQL),
    "hybrid_rerank_topk": (hybrid_rerank, HYBRID_RERANK_SQL),
    "hybrid_linear_topk": (hybrid_linear, HYBRID_LINEAR_SQL),
    "retrieval_observation": (observed, OBSERVED_SQL),
    "candidate_coverage": (candidate_coverage, COVERAGE_SQL),
    "candidate_pool": (candidate_pool, POOL_SQL),
    "benchmark_grid": (benchmark_grid, GRID_SQL),
    "retrieval_metrics_multi": (multi_metrics, MULTI_SQL),
    "rank_change": (rank_changes, RANK_CHANGE_SQL),
    "retrieval_metrics": (vector_metrics, f"WITH {_METRICS} SELECT case_id, metric, value FROM results"),
    "metrics_grouping_sets": (metric_summary, SUMMARY_SQL),
    "best_method": (best_methods, BEST_SQL),
    "strategy_delta": (deltas, DELTA_SQL),
    "metric_distribution": (distributions, DISTRIBUTION_SQL),
    "evidence_coverage": (coverage, COVERED_SQL),
}
