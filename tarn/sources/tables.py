"""Vector indexes, JSON lines, experiment logs and saved reports as tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to an experiment log, nulls included."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Write the rows as one JSON array, nulls included, to a file that is replaced at once; rows pass through the driver a partition at a time."""
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()
    write_lines((f"{'[' if i == 0 else ','}\n  {r['j']}" for i, r in enumerate(lines)), path, "\n]\n", "[]\n")


def write_lines(parts: Iterable[str], path: str, end: str = "", empty: str = "") -> None:
    """Write parts to a new file beside ``path`` and move it there: a reader sees the old file or the new one, whole."""
    files, target = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    folder, _, name = target.rpartition("/")
    files.create_dir(folder)
    made, some = f"{folder}/.{name}.{uuid.uuid4().hex}", False
    with files.open_output_stream(made) as out:
        for part in parts:
            some = True
            out.write(part.encode())
        out.write((end if some else empty).encode())
    files.move(made, target)


def upsert(new: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """Append rows to the table at ``path`` and return its latest row of each key; nested values are kept as JSON text."""
    nested = [f.name for f in new.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    new.withColumns({c: F.to_json(c) for c in nested}).write.mode("append").parquet(path)
    rows = new.sparkSession.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def write_vector_index(chunks: DataFrame, embed: Callable[[Column], Column], path: str, key: str = "source_id", text: str | Column = "content", excluded: tuple[str, ...] = ()) -> None:
    """(key, embedding) of chunks but those of excluded sources, and a one-row manifest of count and dimension."""
    chunks = chunks.filter(~F.coalesce(F.col("source").isin(*excluded), F.lit(False))) if excluded else chunks
    chunks.select(key, embed(F.col(text) if isinstance(text, str) else text).alias("embedding")).write.mode("overwrite").parquet(f"{path}/vectors")
    vectors = chunks.sparkSession.read.parquet(f"{path}/vectors")
    manifest = vectors.agg(F.count("*").alias("count"), F.max(F.size("embedding")).alias("dim"), F.min(F.size("embedding")).alias("min_dim"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_vector_index(spark: SparkSession, path: str, key: str = "source_id") -> DataFrame:
    """The index; raises if it is missing or doesn't match its manifest."""
    vectors = spark.read.parquet(f"{path}/vectors")
    said = spark.read.schema("count long, dim int, min_dim int").json(f"{path}/manifest").first()
    if said is None or said["count"] != vectors.count() or said["dim"] != said["min_dim"]:
        raise ValueError(f"the index at {path} doesn't match its manifest")
    return vectors.select(key, "embedding")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_text(spark: SparkSession, path: str) -> str:
    """The whole of one small file, in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def newest(spark: SparkSession, root: str, glob: str) -> str | None:
    """The last file name, by order, that matches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root).select(F.max("path"))
    return files.first()[0]


def markdown_table(summary: DataFrame, metrics: list[str]) -> str:
    """A report of (method, metric, mean) with the best value of each metric in bold; a row for each method."""
    rows = summary.groupBy("method").pivot("metric", metrics).agg(F.first("mean")).orderBy("method").collect()
    best = {m: max((r[m] for r in rows if r[m] is not None), default=None) for m in metrics}
    cell = lambda r, m: "-" if r[m] is None else f"**{r[m]:.3f}**" if r[m] == best[m] else f"{r[m]:.3f}"
    lines = ["| method | " + " | ".join(metrics) + " |", "|---" * (len(metrics) + 1) + "|"]
    return "\n".join([*lines, *[f"| {r['method']} | " + " | ".join(cell(r, m) for m in metrics) + " |" for r in rows]])
