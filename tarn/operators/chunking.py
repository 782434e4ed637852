"""Documents to chunks: (doc_id, title, content, chapter_id, section_id, chapter_title, section_title, chunk_index, chunk_count, source, source_id).

Fixed-size and recursive chunks and raw sections are column expressions or one pass per Arrow batch; no strategy shuffles
a text. ``STRATEGIES`` maps names to functions of (docs) with doc_id, text and title columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import fixed_values as V
from tarn.functions import sections as S
from tarn.functions import text as T


def fixed_pieces(text: Column, size: int) -> Column:
    """Consecutive windows of ``size`` code points; none of an empty text."""
    if size < 1:
        raise ValueError("the chunk size must be at least 1")
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def pack(units: Column, size: int, joint: str = "\n\n") -> Column:
    """Greedy packing of an array of texts: a unit joins the open chunk while both fit; longer units are cut and stand alone."""
    closed = F.array().cast("array<string>")

    def ended(a: Column) -> Column:
        return F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    def step(a: Column, unit: Column) -> Column:
        grown = F.concat(a["open"], F.lit(joint), unit)
        state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
        fits = a["open"].isNotNull() & (F.length(a["open"]) + len(joint) + F.length(unit) <= size)
        cut = state(F.concat(ended(a), fixed_pieces(unit, size)), F.lit(None).cast("string"))
        return F.when(F.length(unit) > size, cut).when(fits, state(a["done"], grown)).otherwise(state(ended(a), unit))

    return F.aggregate(units, F.struct(closed.alias("done"), F.lit(None).cast("string").alias("open")), step, ended)


def recursive_units(text: Column, size: int) -> Column:
    """Paragraphs, and of those over ``size`` the sentences."""
    split = lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.filter(T.sentences(p), lambda s: s != ""))
    return F.flatten(F.transform(T.paragraphs(F.coalesce(text, F.lit(""))), split))


def _numbered(docs: DataFrame, pieces: Column, source: str, source_id: str) -> DataFrame:
    null = F.lit(None).cast("string")
    rows = docs.select("doc_id", "title", pieces.alias("pieces")).select("doc_id", "title", F.size("pieces").alias("chunk_count"), F.posexplode("pieces").alias("at", "content"))
    index = (F.col("at") + 1).cast("int")
    return rows.select(
        "doc_id", "title", "content", null.alias("chapter_id"), null.alias("section_id"), null.alias("chapter_title"), null.alias("section_title"),
        index.alias("chunk_index"), "chunk_count", F.format_string(source, index).alias("source"), F.format_string(source_id, index).alias("source_id"),
    )


def fixed_size(docs: DataFrame, size: int = 900) -> DataFrame:
    return _numbered(docs, fixed_pieces(F.col("text"), size), "chunk_%04d.md", f"fixed_size_{size}_chunk_%04d")


def recursive(docs: DataFrame, size: int = 900) -> DataFrame:
    if size < 1:
        raise ValueError("the chunk size must be at least 1")
    return _numbered(docs, pack(recursive_units(F.col("text"), size), size), "chunk_%04d.md", "recursive_chunk_%04d")


_SECTION = "chapter_id string, section_id string, chapter_title string, section_title string"


def parse_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_order, chapter_id, section_id, chapter_title, section_title, body_lines): a row for each section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"doc_id": d, "section_order": i, "chapter_id": s.chapter_id, "section_id": s.section_id, "chapter_title": s.chapter_title, "section_title": s.section_title, "body_lines": s.lines}
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for i, s in enumerate(S.parse_sections((t or "").splitlines()), 1)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    names = [x.split()[0] for x in _SECTION.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), ("section_order", pa.int32()), *[(n, pa.string()) for n in names], ("body_lines", pa.list_(pa.string()))])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, section_order int, {_SECTION}, body_lines array<string>")


#: Sentences that are embedded in one call, texts that are split together, and characters up to which either is (or a single longer one).
EMBED_AT_ONCE, DOCS_AT_ONCE, CHARS_AT_ONCE = 50_000, 512, 500_000


def _cuts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``most`` items and ``CHARS_AT_ONCE`` characters, of one item at least."""
    ends, at = np.cumsum(lengths), 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = min(at + most, max(at + 1, int(np.searchsorted(ends, done + CHARS_AT_ONCE, side="right"))))
        yield at, to
        at = to


def _from_sections(docs: DataFrame, split: Callable[[list[S.Section]], list[list[str]]]) -> DataFrame:
    """Chunks of the sections of each document: parsed and split in one pass, many documents at a time."""
    names = [x.split()[0] for x in _SECTION.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.string()) for n in names], ("chunk_count", pa.int32()), ("at", pa.int32()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, to in _cuts(pc.fill_null(pc.utf8_length(whole.column(1)), 0).to_numpy(), DOCS_AT_ONCE):
                batch = whole.slice(first, to - first)
                found = [(d, s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in S.parse_sections((t or "").splitlines())]
                pieces = split([s for _, s in found])
                rows = [(d, *(getattr(s, n) for n in names), len(p), i, c) for (d, s), p in zip(found, pieces, strict=True) for i, c in enumerate(p)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {_SECTION}, chunk_count int, at int, content string")
    return _section_chunks(rows, F.col("at") + 1)


def _each(split: Callable[[list[str]], list[str]]) -> Callable[[list[S.Section]], list[list[str]]]:
    return lambda sections: [split(s.lines) for s in sections]


def _section_chunks(rows: DataFrame, index: Column) -> DataFrame:
    file = F.when(F.col("chunk_count") > 1, F.format_string("%s_chunk_%02d.md", "section_id", index)).otherwise(F.concat("section_id", F.lit(".md")))
    return rows.select(
        "doc_id", F.coalesce(F.nullif("section_title", F.lit("")), F.col("chapter_title")).alias("title"), "content", "chapter_id", "section_id", "chapter_title", "section_title",
        index.alias("chunk_index"), F.col("chunk_count").cast("int").alias("chunk_count"), F.concat_ws("/", "chapter_id", file).alias("source"),
        F.format_string("%s_%s_chunk_%02d", "chapter_id", "section_id", index).alias("source_id"),
    )


def section_raw(docs: DataFrame) -> DataFrame:
    """One chunk for each section."""
    rows = parse_sections(docs).select("*", F.array_join("body_lines", "\n").alias("content"), F.lit(1).alias("chunk_count"))
    return _section_chunks(rows, F.lit(1))


def section_recursive(docs: DataFrame, size: int = 900, overlap: int = 0) -> DataFrame:
    split = lambda lines: S.recursive("\n".join(lines), size)
    return _from_sections(docs, _each((lambda lines: S.with_tail(split(lines), overlap)) if overlap else split))


def section_semantic(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] = S.hashed_embedding, overlap: int = 0, least: int = V.SEMANTIC_MIN, target: int = V.TARGET_CHARS, most: int = V.MAX_CHARS, threshold: float = V.SEMANTIC_BREAK) -> DataFrame:
    """Boundaries by size and by the likeness of neighbouring sentences under ``embed`` (unit vectors)."""
    if not 1 <= least <= target <= most:
        raise ValueError("sizes must satisfy 1 <= least <= target <= most")
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must be a cosine")

    def split(sections: list[S.Section]) -> list[list[str]]:
        units = [S.semantic_units(s.body) for s in sections]
        flat = [u for own in units for u in own]
        vectors = [embed(flat[a:b]) for a, b in _cuts(np.fromiter(map(len, flat), np.int64, len(flat)), EMBED_AT_ONCE)]
        vectors = np.concatenate(vectors).astype(np.float64) if flat else np.zeros((0, 1))
        similar = np.einsum("ij,ij->i", vectors[:-1], vectors[1:])
        out, at = [], 0
        for own in units:
            chunks = S.semantic_chunks(own, similar[at : at + max(0, len(own) - 1)], least, target, most, threshold)
            out.append(S.semantic_overlap(chunks, overlap) if overlap else chunks)
            at += len(own)
        return out

    return _from_sections(docs, split)


#: Name to chunker, as experiments call them.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixed_size_900": lambda docs: fixed_size(docs, 900),
    "fixed_size_1800": lambda docs: fixed_size(docs, 1800),
    "recursive": recursive,
    "section_raw": section_raw,
    "section_based": lambda docs: _from_sections(docs, _each(S.section_pack)),
    "section_based_no_overlap": lambda docs: _from_sections(docs, _each(S.section_pack_no_overlap)),
    "section_recursive": section_recursive,
    "section_recursive_overlap": lambda docs: section_recursive(docs, overlap=V.OVERLAP_CHARS),
    "section_semantic": section_semantic,
    "section_semantic_overlap": lambda docs: section_semantic(docs, overlap=V.OVERLAP_CHARS),
    **{f"section_semantic_overlap_{n:03d}": lambda docs, n=n: section_semantic(docs, overlap=n) for n in (90, 180, 270, 360)},
}


def experiment_corpus(docs: DataFrame, strategy: str) -> DataFrame:
    """Chunks of a named strategy without the front chapter ch00; chunks without a chapter stay."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    return STRATEGIES[strategy](docs).filter(~F.col("chapter_id").eqNullSafe("ch00"))
