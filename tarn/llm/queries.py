"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, chat_format, fingerprint, mixing, near_dedup, pii, quality, token_files, unigram
from tarn.llm.common import documents, scratch_path
from tarn.llm.exact_dedup import exact_groups


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.classify(docs, model, score_col="score")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: A conversation whose texts hold the template's own control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    done = chat_format.format_conversations(turns)
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The lengths of the rendering: eight characters beside role and text for each turn's marks, one for each control string escaped.
OP6_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + length(text) + len(regexp_extract_all(text, '#\\*## ')) + len(regexp_extract_all(text, '<\\*/turn>'))) AS BIGINT) AS formatted_chars
FROM all_turns GROUP BY conv_id
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir)).drop("found")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_file()).withColumnRenamed("id", "doc_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


#: All pairs of different texts that share a shingle, by their weighted Jaccard index, and what links reach.
OP9_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS ws FROM documents),
nodes AS (SELECT ws, min(doc_id) AS node, count(*) AS copies FROM words GROUP BY ws),
bags AS (SELECT node, shingle, count(*) AS c FROM (SELECT node, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: ws[i : i + 4])) AS shingle FROM nodes WHERE len(ws) > 0) GROUP BY ALL),
sizes AS (SELECT node, sum(c) AS size FROM bags GROUP BY node),
sized AS (SELECT node, hash(shingle) AS h, shingle, c, size FROM bags JOIN sizes USING (node)),
links AS (SELECT x.node AS a, y.node AS b FROM sized x JOIN sized y ON x.h = y.h AND x.shingle = y.shingle AND x.node < y.node AND x.size * 0.8 <= y.size AND y.size * 0.8 <= x.size
  GROUP BY x.node, y.node HAVING CAST(sum(least(x.c, y.c)) AS DOUBLE) / CAST(any_value(x.size) + any_value(y.size) - sum(least(x.c, y.c)) AS DOUBLE) >= CAST(0.8 AS DOUBLE)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
classes AS (SELECT a AS node, min(b) AS class_id, CAST(sum(copies) AS BIGINT) AS class_size FROM reach JOIN nodes ON nodes.node = b GROUP BY a)
SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM words JOIN nodes USING (ws) JOIN classes USING (node)
"""


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "ids")
    token_files.write_ids(documents(spark, sf_dir), tokenizer_file(), out)
    return token_files.read_checksums(spark, out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality": op2_quality,
        "op3_mixing": op3_mixing,
        "op4_pii": op4_pii,
        "op5_bpe": op5_bpe,
        "op6_chat_format": op6_chat_format,
        "op7_token_counts": op7_token_counts,
        "op8_fingerprint": op8_fingerprint,
        "op9_near_dedup": op9_near_dedup,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op6_chat_format": OP6_SQL,
        "op9_near_dedup": OP9_SQL,
    }
