"""A stored BM25 index: build once, search with whole tables of queries.

The documents are dealt into blocks of about ``BLOCK_DOCS``. ``postings`` has a row for each block and term with the
documents, term frequencies and lengths as arrays, sorted by term within its files; ``terms`` has the document frequency of
each term; ``stats`` is one row. A search reads the postings of the queries' terms only. All postings of a document are in
its block, so a block's scores are whole: a task scores the queries against one block with numpy and sends on the k best
of each, whatever the terms. A term that every document holds is as many rows as there are blocks, never one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tarn.functions import fixed_values as V
from tarn.functions import text as T
from tarn.operators.retrieval import DIGITS, idf, top_k

#: Documents of a block, and (query, term) rows that are scored together; up to so many of them are broadcast.
BLOCK_DOCS, QUERY_ROWS = 16384, 200_000
#: Distinct query terms up to which they are pushed down to the scan of the postings.
PUSHED_TERMS = 200
#: Rows of postings that leave a task together.
TERMS_AT_ONCE = 20_000


@dataclass
class Bm25Index:
    """postings (block, term, ids, tfs, lengths), terms (term, df, total_tf) and stats (n, total_length, blocks)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    _totals: Row | None = None

    def cache(self) -> Bm25Index:
        """Keep the index in memory; ``reset`` drops it."""
        for table in (self.postings, self.terms, self.stats):
            table.cache().count()
        return self

    def reset(self) -> None:
        for table in (self.postings, self.terms, self.stats):
            table.unpersist()

    def totals(self) -> Row:
        """The row of ``stats``, read once."""
        if self._totals is None:
            self._totals = self.stats.first()
        return self._totals

    def search(self, queries: DataFrame, k: int = 5, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """(query_id, doc_id, score, rank): BM25 top k, the query's term counts as weights."""
        return _search(self, queries, k, query_id, query_text)


def postings_of(docs: DataFrame, doc_id: str, text: Column, blocks: int) -> DataFrame:
    """(block, term, ids, tfs, lengths): a row for each block and term.

    Terms are counted where the documents are; a row for each document crosses one shuffle, and a task inverts whole blocks.
    """
    counted = _counted(docs.select(F.col(doc_id).alias("id"), T.tokens(text).alias("terms")))
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block", "id")
    kind = counted.schema["id"].dataType

    def inverted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names, lists = (table.column(c).combine_chunks() for c in ("id", "terms"))
        names, words, sizes = names.dictionary_encode(null_encoding="encode"), lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy()
        rank = np.empty(len(words.dictionary), np.int64)
        by_term = pc.sort_indices(words.dictionary)
        rank[by_term.to_numpy()] = np.arange(len(rank))
        own, n = names.indices.to_numpy(), len(names.dictionary)
        pairs, at = np.unique(rank[words.indices.to_numpy()] * n + np.repeat(own, sizes), return_inverse=True)  # rows of the same id are one document
        tf = np.bincount(at, table.column("tfs").combine_chunks().flatten().to_numpy(), len(pairs)).astype(np.int32)
        first = np.unique(own, return_index=True)[1]
        length = table.column("length").to_numpy()[first].astype(np.int32)
        cuts = np.searchsorted(pairs, np.arange(len(rank) + 1) * n)
        doc, terms, block = pairs % n, words.dictionary.take(by_term), table.column("block")[0].as_py()
        for a in range(0, len(rank), TERMS_AT_ONCE):
            b = min(len(rank), a + TERMS_AT_ONCE)
            some, offsets = slice(cuts[a], cuts[b]), pa.array((cuts[a : b + 1] - cuts[a]).astype(np.int32))
            each = [pa.ListArray.from_arrays(offsets, x) for x in (names.dictionary.take(pa.array(doc[some])), pa.array(tf[some]), pa.array(length[doc[some]]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, block, np.int32)), terms[a:b], *each], ["block", "term", "ids", "tfs", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and block[a] != current:
                    yield from inverted(pa.Table.from_batches(held))
                    held = []
                current = block[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from inverted(pa.Table.from_batches(held))

    fields = [("block", IntegerType()), ("term", StringType()), ("ids", ArrayType(kind)), ("tfs", ArrayType(IntegerType())), ("lengths", ArrayType(IntegerType()))]
    return dealt.mapInArrow(run, StructType([StructField(*f) for f in fields]))


def _counted(docs: DataFrame) -> DataFrame:
    """(id, length, terms, tfs) of docs (id, terms): the distinct terms of each document, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            length, words = lists.value_lengths().to_numpy(), lists.flatten().dictionary_encode()
            wide = max(1, len(words.dictionary))
            pairs, tf = np.unique(np.repeat(np.arange(batch.num_rows), length) * wide + words.indices.to_numpy(), return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(batch.num_rows + 1) * wide).astype(np.int32))
            each = [pa.ListArray.from_arrays(offsets, x) for x in (words.dictionary.take(pa.array(pairs % wide)), pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(length.astype(np.int64)), *each], ["id", "length", "terms", "tfs"])

    fields = [("id", docs.schema["id"].dataType), ("length", LongType()), ("terms", ArrayType(StringType())), ("tfs", ArrayType(IntegerType()))]
    return docs.mapInArrow(run, StructType([StructField(*f) for f in fields]))


def write_bm25_index(docs: DataFrame, path: str, doc_id: str = "doc_id", doc_text: str | Column = "text") -> None:
    """Write the index of ``docs`` under ``path``. Documents without terms count in the averages."""
    text = F.col(doc_text) if isinstance(doc_text, str) else doc_text
    spark = docs.sparkSession
    n = docs.select(F.col(doc_id)).count()
    blocks = max(1, -(-n // BLOCK_DOCS))
    rows = postings_of(docs, doc_id, text, blocks)
    rows.sortWithinPartitions("term", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    size = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    terms = written.groupBy("term").agg(F.sum(F.size("ids").cast("long")).alias("df"), F.sum(size).alias("total_tf"))
    terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    total = spark.read.parquet(f"{path}/terms").agg(F.coalesce(F.sum("total_tf"), F.lit(0)).alias("total_length"))
    total.select(F.lit(n).cast("long").alias("n"), "total_length", F.lit(blocks).alias("blocks")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read_bm25_index(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")))


def _search(index: Bm25Index, queries: DataFrame, k: int, query_id: str, query_text: str) -> DataFrame:
    stats, spark = index.totals(), queries.sparkSession
    n, average = float(stats["n"]), stats["total_length"] / stats["n"] if stats["n"] else 0.0
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(T.tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    found = q.limit(QUERY_ROWS + 1).toArrow()
    terms, postings, groups = index.terms, index.postings, 1
    if found.num_rows <= QUERY_ROWS:
        q, wanted = spark.createDataFrame(found), pc.unique(found.column("term"))
        few = F.broadcast(spark.createDataFrame(pa.table({"term": wanted.cast(pa.string())})))
        terms, postings = (t.join(few, "term", "left_semi") for t in (terms, postings))
        if len(wanted) <= PUSHED_TERMS:
            terms, postings = (t.filter(F.col("term").isin(wanted.to_pylist())) for t in (terms, postings))
    else:
        groups = -(-q.count() // QUERY_ROWS)
        terms, postings = (t.join(q.select("term").distinct(), "term", "left_semi") for t in (terms, postings))
    weight = (idf(F.lit(n), F.col("df").cast("double")) * F.col("qtf")).alias("weight")
    weighted = q.join(terms, "term").select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("qb"), "query_id", "term", weight)
    key = queries.select(F.col(query_id).alias("query_id")).schema[0].dataType
    ids = index.postings.schema["ids"].dataType.elementType
    null = lambda t: F.lit(None).cast(t)
    asked = weighted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(stats["blocks"] - 1))))
    asked = asked.select("qb", "block", "term", "query_id", "weight", null(index.postings.schema["ids"].dataType).alias("ids"), null("array<int>").alias("tfs"), null("array<int>").alias("lengths"))
    held = postings.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("qb", "block", "term", null(key).alias("query_id"), null("double").alias("weight"), "ids", "tfs", "lengths")
    dealt = asked.unionByName(held).repartition("qb", "block").sortWithinPartitions("qb", "block")

    def best(table: pa.Table) -> pa.RecordBatch:
        is_query = np.asarray(table.column("weight").is_valid())
        mine, theirs = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query)).combine_chunks()
        empty = pa.RecordBatch.from_arrays([pa.array([], table.schema.field("query_id").type), pa.array([], table.schema.field("ids").type.value_type), pa.array([], pa.float64())], ["query_id", "doc_id", "score"])
        if not mine.num_rows or not theirs.num_rows:
            return empty
        lists = theirs.column("ids").combine_chunks()
        names = lists.flatten().dictionary_encode()
        place = names.indices.to_numpy()
        tf, length = (theirs.column(c).combine_chunks().flatten().to_numpy().astype(np.float64) for c in ("tfs", "lengths"))
        part = tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * length / average))
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        where = {t: (cuts[i], cuts[i + 1]) for i, t in enumerate(theirs.column("term").to_pylist())}
        each: dict = {}
        for name, term, weight in zip(*(mine.column(c).to_pylist() for c in ("query_id", "term", "weight")), strict=True):
            if term in where:
                each.setdefault(name, []).append((*where[term], weight))
        out, n_docs = [], len(names.dictionary)
        for name, hits in each.items():
            scores = np.zeros(n_docs)
            for a, b, weight in hits:
                scores[place[a:b]] += part[a:b] * weight  # a document occurs once in a list
            scores = np.round(scores, DIGITS)
            keep = min(k, n_docs)
            cut = np.partition(scores, n_docs - keep)[n_docs - keep]
            found = np.flatnonzero((scores >= cut) & (scores > 0))  # ties at the cut go on
            out.append((name, found, scores[found]))
        if not out:
            return empty
        found = np.concatenate([f for _, f, _ in out])
        named = pa.array([name for name, f, _ in out for _ in range(len(f))], table.schema.field("query_id").type)
        return pa.RecordBatch.from_arrays([named, names.dictionary.take(pa.array(found)), pa.array(np.concatenate([s for *_, s in out]))], ["query_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            qb, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((qb[1:] != qb[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                name = int(qb[a]), int(block[a])
                if held and name != current:
                    yield best(pa.Table.from_batches(held))
                    held = []
                current = name
                held.append(batch.slice(a, b - a))
        if held:
            yield best(pa.Table.from_batches(held))

    schema = StructType([StructField("query_id", key), StructField("doc_id", ids), StructField("score", DoubleType())])
    return top_k(dealt.mapInArrow(run, schema), k, ["query_id"], ["doc_id"])
