"""Tables written to the shared scratch folder, so that what is costly is done once however often a plan reads it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``, deleted when the driver ends; a temporary one only on a local master without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tarn-scratch-")
        spark.conf.set("spark.checkpoint.dir", path) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    path = f"{path.rstrip('/')}/tarn-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
