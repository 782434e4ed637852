"""Scratch tables, row numbers, skewed joins and small column helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which a join deals it out, and the most keys that can be dealt out (the most frequent ones;
#: any other has fewer rows than each of these).
HOT_ROWS, MAX_HOT = 4096, 4096
#: Plan nodes that give the same rows in the same order each time they run.
_STABLE = {"LogicalRelation", "Project", "Filter", "LocalRelation"}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's scratch folder, which is deleted when the driver ends."""
    folder = f"{scratch_dir(spark)}/tarn-{spark.sparkContext.applicationId}"
    where, files = _file_system(spark, folder)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The table cuts the lineage: a lost executor costs no recomputation above it, and values that
    depend on the evaluation (row numbers) are fixed from then on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_scratch_path", None):
            where, files = _file_system(table.sparkSession, path)
            files.delete(where, True)


def col(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _stable(plan) -> bool:
    inner = plan.children()
    return plan.getClass().getSimpleName() in _STABLE and plan.deterministic() and all(_stable(inner.apply(i)) for i in range(inner.size()))


def settled(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` if each scan gives its rows in the same order, so that row numbers mean the same rows; else its written table."""
    return docs if _stable(docs._jdf.queryExecution().optimizedPlan()) else materialize(docs, name)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(col(column) if isinstance(column, str) else column, F.lit(""))


def skew_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, spread: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join rows with the one row of ``table`` for their key; ``n`` counts the rows of a key, in ``table`` or in ``counts``.

    Both sides are shuffled by the key. The at most ``MAX_HOT`` keys of ``HOT_ROWS`` rows or more are dealt into parts by a hash of the column
    ``spread``, and only their rows of ``table`` are copied for each part. The counts are read here and should be materialized.
    """
    frequent = (table if counts is None else counts).filter(F.col(n) >= HOT_ROWS).orderBy(F.desc(n), *on).limit(MAX_HOT)
    frequent = frequent.select(*on, F.ceil(F.col(n) / HOT_ROWS).cast("int").alias("__parts"))
    found = frequent.collect()  # MAX_HOT rows at most
    table = table.drop(n) if counts is None else table
    if not found:
        return rows.join(table.hint("merge"), on, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, frequent.schema))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hot, on, "left").withColumn("__part", F.pmod(F.hash(spread), parts)).drop("__parts")
    copied = table.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copied.hint("merge"), [*on, "__part"], how).drop("__part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
