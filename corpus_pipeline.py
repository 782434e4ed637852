"""The corpus pipeline: quality, exact and near duplicates, source mixture, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what the next one works on, with
the columns of documents but for the last. ``run`` applies them to the documents table, each stage's result written and
read again, so that a lost executor costs no earlier stage and row numbers are those of a table; the stage before is deleted then.

Edge cases are those of the operators. Null and empty texts are scored like others, are copies of each other, count no words and have
no tokens. Extra columns reach the mixture whatever their names; the last stage keeps doc_id, lang and source. Of an empty table nothing comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, quality
from tarn.llm.common import discard, fresh, materialize
from tarn.llm.exact_dedup import exact_dedup
from tarn.llm.mixing import mix
from tarn.llm.near_dedup import near_dedup
from tarn.llm.queries import tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on their labelled ones, doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "__score")
    return quality.classify(docs, model, score_col=score).filter(F.col(score) >= 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as they are drawn, in shuffled shards."""
    return mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of each document of the mixture."""
    return bpe.encode(docs, tokenizer_file(), keep=("lang", "source")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: The classifier's scores are compressed sizes, the mixture's draws are Spark's hashes: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
