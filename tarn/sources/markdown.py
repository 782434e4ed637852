"""Markdown corpora: files to documents, manifests to chunks, and back."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import document_text, strip
from tarn.sources.tables import exists, json_text, write_json_array

#: Fixed value: the name of a corpus's manifest.
MANIFEST_FILE = "_index.json"
MANIFEST = "source_id string, path string, chapter_id string, section_id string, chunk_index int, chunk_count int, chapter_title string, section_title string, title string, char_count int"


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]")


def front_matter(lines: Column) -> tuple[Column, Column]:
    """(map of metadata, body lines): ``key: value`` lines between a first line ``---`` and the next one; unclosed, all is body."""
    fences = F.filter(F.transform(lines, lambda x, i: F.when(strip(x) == "---", i)), lambda i: i.isNotNull())
    closed = (F.get(fences, F.lit(0)) == 0) & (F.size(fences) > 1)
    end = F.get(fences, F.lit(1))
    head = F.filter(F.slice(lines, F.lit(2), F.greatest(F.coalesce(end, F.lit(1)) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(":")) & ~F.startswith(x, F.lit(" ")))
    key = lambda x: strip(F.substring_index(x, ":", 1))
    value = lambda x: F.regexp_replace(strip(F.regexp_replace(x, r"(?s)^[^:]*:", "")), r'^"+|"+$', "")
    keys = F.transform(head, key)
    last = F.filter(F.transform(head, lambda x, i: F.struct(key(x).alias("key"), value(x).alias("value"), i.alias("i"))), lambda e: F.array_position(F.reverse(keys), e["key"]) == F.size(keys) - e["i"])
    found = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(closed, found).otherwise(empty), F.when(closed, F.slice(lines, end + 2, F.size(lines))).otherwise(lines)


def read_markdown(spark: SparkSession, root: str, recursive: bool = True, skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(source, text, metadata) of the .md files under ``root`` but those named ``_...``; source is the path below root."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=recursive)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rows = files.select(F.substring(path, F.lit(len(base) + 1), F.length(path)).alias("source"), strip(F.col("value")).alias("value"))
    rows = rows.filter(~F.substring_index("source", "/", -1).startswith("_"))
    for d in skip_dirs:
        rows = rows.filter(~F.col("source").startswith(f"{d}/"))
    meta, body = front_matter(split_lines(F.col("value")))
    return rows.select("source", F.array_join(body, "\n").alias("text"), meta.alias("metadata"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, an array of entries in one JSON file; a missing file is an empty manifest, anything but an array too."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    # Spark's readers pass over files named _..., so the one file is read here.
    text = json_text(spark, path)
    entries = spark.createDataFrame([(text,)], "text string").select(F.explode(F.from_json("text", f"array<struct<{MANIFEST.replace(' ', ':')}>>".replace(",:", ","))).alias("e")).select("e.*")
    return entries.filter("path is not null or source_id is not null")


def manifest_chunks(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of the manifest's files: the body without headings of levels 1 and 2; the manifest overrides front matter.

    The title is the manifest's or the name of the file. Entries without a path or without a file give nothing.
    """
    body = F.filter(F.split("text", "\n"), lambda x: ~strip(x).rlike(r"^##? "))
    either = lambda c: F.coalesce(F.col(f"m.{c}"), F.try_element_at("metadata", F.lit(c))).alias(c)
    number = lambda c: F.coalesce(F.col(f"m.{c}"), F.when(F.try_element_at("metadata", F.lit(c)).rlike("^[0-9]+$"), F.try_element_at("metadata", F.lit(c)).try_cast("int"))).alias(c)
    joined = manifest.alias("m").join(files.withColumnRenamed("source", "file"), F.col("m.path") == F.col("file"))
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"(?<=.)\.[^.]*$", "")
    title = F.coalesce(F.nullif(F.col("m.title"), F.lit("")), stem).alias("title")
    return joined.select(F.col("m.path").alias("source"), strip(F.array_join(body, "\n")).alias("content"), title, *map(either, ("chapter_id", "section_id", "chapter_title", "section_title", "source_id")), *map(number, ("chunk_index", "chunk_count")))


def manifest_of(chunks: DataFrame) -> DataFrame:
    """The manifest rows of chunks; ids are derived from sources where they lack one."""
    derived = F.regexp_replace(F.regexp_replace("source", r"\.md$", ""), "/", "_")
    return chunks.select(F.coalesce("source_id", derived).alias("source_id"), F.col("source").alias("path"), "chapter_id", "section_id", "chunk_index", "chunk_count", "chapter_title", "section_title", "title", F.length("content").alias("char_count"))


def rendered(chunks: DataFrame) -> DataFrame:
    """(source, value): chunks as Markdown: ids and numbers as they are, titles JSON-quoted, then the headings and the content."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = lambda c: F.concat(F.lit(f"{c}: "), said(c))
    number = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1)).cast("string"))
    quoted = lambda c: F.concat(F.lit(f"{c}: "), F.regexp_extract(F.to_json(F.struct(said(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))
    fields = [*map(plain, ("source_id", "chapter_id", "section_id")), *map(number, ("chunk_index", "chunk_count")), *map(quoted, ("chapter_title", "section_title", "title"))]
    chapter = F.concat(F.lit("# "), F.coalesce(F.nullif(F.col("chapter_title"), F.lit("")), "title"))
    section = F.when(said("section_title") != "", F.concat(F.lit("\n## "), F.col("section_title")))
    return chunks.select("source", F.concat_ws("\n", F.lit("---"), *fields, F.lit("---"), F.lit(""), chapter, section, F.lit(""), strip(F.col("content")), F.lit("")).alias("value"))


def save_chunks(chunks: DataFrame, root: str) -> None:
    """Write each chunk as a Markdown file under ``root``, a folder that all executors share, and the manifest beside them."""

    def write(rows):
        files, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for row in rows:
            path = f"{base}/{row['source']}"
            files.create_dir(path.rsplit("/", 1)[0])
            with files.open_output_stream(path) as out:
                out.write(row["value"].encode())

    rendered(chunks).foreachPartition(write)
    write_json_array(manifest_of(chunks), f"{root}/{MANIFEST_FILE}")


def load_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of a folder that ``save_chunks`` or anything else with a manifest wrote."""
    return manifest_chunks(read_manifest(spark, f"{root}/{MANIFEST_FILE}"), read_markdown(spark, root))


def ingest(sample: DataFrame | None, private: DataFrame | None, include_sample: bool = True, skip_chapter: str = "ch00") -> DataFrame:
    """The union of a sample and a private corpus (source, text, metadata); the private one without its front chapter if both come."""
    parts = [sample] if include_sample and sample is not None else []
    if private is not None:
        parts.append(private.filter(~F.col("source").startswith(f"{skip_chapter}/")) if parts else private)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("source")


@dataclass
class Ingested:
    """What an ingestion gave: its chunks and their manifest; ``reason`` says why nothing was done."""

    chunks: DataFrame
    manifest: DataFrame
    skipped: bool = False
    reason: str = ""


def ingest_corpus(spark: SparkSession, root: str, chunker: Callable[[DataFrame], DataFrame], sample: str | None = None, private: str | None = None, paths: list[str] | None = None, persist: bool = True) -> Ingested:
    """Chunks of a sample and a private folder, or of the folders ``paths``, whose chunks are also saved under ``root``.

    Without ``paths`` a corpus that ``root`` already has is loaded instead.
    """
    if paths is None and exists(spark, f"{root}/{MANIFEST_FILE}"):
        return Ingested(load_chunks(spark, root), read_manifest(spark, f"{root}/{MANIFEST_FILE}"), True, "existing_corpus")
    read = lambda p: None if p is None else read_markdown(spark, p)
    if paths:
        files = functools.reduce(DataFrame.unionByName, map(read, paths))
    else:
        files = ingest(read(sample), read(private), sample is not None)
    chunks = chunker(files)
    if paths and persist:
        save_chunks(chunks, root)
    return Ingested(chunks, manifest_of(chunks))


# --- metadata of chunks ------------------------------------------------------------------------------------------


def nested(record: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; null where any step isn't an object."""
    return F.get_json_object(record, "$." + path)


def paths_of(manifest: DataFrame, order: str) -> DataFrame:
    """(source_id, path): of entries with the same id the last by ``order``; those without either are left out."""
    known = manifest.filter("source_id is not null and path is not null")
    return known.groupBy("source_id").agg(F.max_by("path", order).alias("path"))


def metadata_by_path(semantic: DataFrame, paths: DataFrame, text: Column, order: str) -> DataFrame:
    """(source, text): what the metadata records (source_id, ...) say of each path; the last record that says anything wins."""
    rows = semantic.select("source_id", F.col(order).alias("__order"), text.alias("text")).filter("text <> ''").join(paths, "source_id")
    return rows.groupBy(F.col("path").alias("source")).agg(F.max_by("text", "__order").alias("text"))


def with_metadata(chunks: DataFrame, by_path: DataFrame, name: str = "metadata_text") -> DataFrame:
    """The chunks with the text of their source; empty where there is none."""
    found = by_path.select("source", F.col("text").alias(name))
    return chunks.join(found, "source", "left").withColumn(name, F.coalesce(name, F.lit("")))


def without_sources(chunks: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Chunks but those of excluded sources; a chunk without a source stays."""
    return chunks.filter(~F.coalesce(F.col("source").isin(*excluded), F.lit(False))) if excluded else chunks


def embedding_text() -> Column:
    """What is embedded of a chunk: chapter, section, title and content, one a line, without empty ones."""
    return document_text(*map(F.col, ("chapter_title", "section_title", "title", "content")))
