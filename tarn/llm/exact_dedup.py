"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks. Sorting the blocks gives equal blocks one integer name, the
number of their first occurrence. Adjacent names are then paired and the pairs named in the same way,
level by level, until one name is left of a document. Two documents get the same (level, name) if and
only if their texts are equal: only whole blocks and integer pairs are ever compared, never digests.

Skew. The text crosses one shuffle, keyed by the block. A block with very many occurrences would meet
in one task, so a first pass counts 64-bit block hashes (pre-aggregated, eight bytes a row) and blocks
that are frequent enough get salted; there are at most ``MAX_HOT`` of them. The names that salted parts
found are merged in a table with a row for each part. Pair levels handle integers only; pairs that are
counted to be frequent are dealt out in the join with their names, all others cross it once.

Edge cases. A null text counts as empty; empty texts are equal to each other. Null and repeated ids are
allowed: of equal texts the row with the largest id stays (a null id is the smallest), and of repeated
rows with that id exactly one. Columns other than id and text are neither read nor returned by
``exact_groups``; ``exact_dedup`` returns the input's columns, whatever their names. An empty table gives
an empty result. Texts are never cut. An input whose rows might come in another order when read again (anything but
a scan with projections and filters) is written to scratch first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.common import col, discard, fresh, materialize, settled, skew_join, text_or_empty

#: Occurrences from which a block is salted, and the most blocks that can be (frequent ones come first by count).
HOT_ROWS, MAX_HOT = 256, 4096

_ROW = "__row"


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """(row, id, sha, pos, last, block): one row for each block; an empty text has one empty block."""
    cut = docs.select(
        F.monotonically_increasing_id().alias(_ROW),
        "id",
        text_or_empty("text").alias("text"),
    ).select(
        _ROW,
        "id",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        F.when(F.col("text") == "", F.array(F.lit("")))
        .otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
        .alias("blocks"),
    )
    return cut.select(_ROW, "id", "sha", (F.size("blocks") - 1).alias("last"), F.posexplode("blocks").alias("pos", "block"))


def _named_blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """(row, id, sha, last, pos, name): sorts the blocks once; equal blocks get the number of the first of them."""
    blocks = _blocks(docs, block_chars).withColumn("h", F.xxhash64("block"))
    counts = blocks.groupBy("h").count().filter(F.col("count") >= HOT_ROWS)
    hot = counts.orderBy(F.desc("count"), "h").limit(MAX_HOT).withColumn("parts", F.ceil(F.col("count") / HOT_ROWS).cast("int")).drop("count")
    hot = docs.sparkSession.createDataFrame(hot.collect(), "h long, parts int")  # MAX_HOT rows at most
    salted = (
        blocks.join(F.broadcast(hot), "h", "left")
        .withColumn("occurrence", F.monotonically_increasing_id())
        .withColumn("salt", F.when(F.col("parts") > 1, F.pmod(F.hash("occurrence"), F.col("parts"))).otherwise(0))
    )
    part = Window.partitionBy("block", "salt")
    named = salted.withColumn("local", F.min("occurrence").over(part)).select(
        _ROW, "id", "sha", "last", "pos", "local",
        F.when((F.col("parts") > 1) & (F.col("occurrence") == F.col("local")), F.col("block")).alias("hot_block"),
    )
    named = materialize(named, "block_names")
    firsts = named.filter(F.col("hot_block").isNotNull()).select("hot_block", "local")
    whole = Window.partitionBy("hot_block")  # a row for each salted part
    merged = firsts.select("local", F.min("local").over(whole).alias("merged"))
    rows = materialize(named.drop("hot_block").join(merged.hint("merge"), "local", "left").select(_ROW, "id", "sha", "last", "pos", F.coalesce("merged", "local").alias("name")), "names")
    discard(named)
    return rows


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """(row, id, text_sha256, keep_id, group_size, kept): one row for each input row, dropped ones too.

    ``row`` is the input row's ``monotonically_increasing_id`` if the input is a scan.
    """
    if block_chars < 1:
        raise ValueError("block_chars must be at least 1")
    named = _named_blocks(settled(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "documents"), block_chars)
    scratch = [named]
    longest = named.agg(F.max("last")).first()[0] or 0
    level, rows = 0, named.select(_ROW, "pos", "last", "name")
    done = rows.filter("last = 0").select(_ROW, F.lit(0).alias("level"), "name")
    rows = rows.filter("last > 0")
    while longest > 0:
        level, longest = level + 1, longest // 2
        pairs = (
            rows.groupBy(_ROW, "last", F.floor(F.col("pos") / 2).alias("pair"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
            .select(_ROW, F.floor(F.col("last") / 2).alias("last"), F.col("pair").alias("pos"), "left", "right")
        )
        pairs = materialize(pairs.withColumn("occurrence", F.monotonically_increasing_id()), f"pairs{level}")
        names = materialize(pairs.groupBy("left", "right").agg(F.min("occurrence").alias("name"), F.count("*").alias("n")), f"pair_names{level}")
        rows = materialize(skew_join(pairs.drop("occurrence"), names, ["left", "right"], "n", _ROW).select(_ROW, "pos", "last", "name"), f"level{level}")
        discard(pairs, names)
        scratch.append(rows)
        done = done.unionByName(rows.filter("last = 0").select(_ROW, F.lit(level).alias("level"), "name"))
        rows = rows.filter("last > 0")
    first = named.filter("pos = 0").select(_ROW, "id", "sha")
    members = materialize(done.join(first.hint("merge"), _ROW), "members")
    discard(*scratch)
    groups = members.groupBy("level", "name").agg(F.max(F.struct("id", _ROW)).alias("keep"), F.count("*").alias("group_size"), F.count("*").alias("n"))
    return skew_join(members, materialize(groups, "groups"), ["level", "name"], "n", _ROW).select(
        F.col(_ROW).alias("row"),
        "id",
        F.col("sha").alias("text_sha256"),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col(_ROW) == F.col(f"keep.{_ROW}")).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    docs = settled(docs, "documents")
    row = fresh(docs, _ROW)
    kept = exact_groups(docs, id_col, text_col, block_chars).filter("kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").drop(row)
