"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are replaced by their rank by corpus frequency (ties by id), so that frequent tokens take one byte.
Each rank takes one to four bytes, least significant first; its length, less one, is two bits of a control
byte, four ranks to a byte. Control and data bytes are kept apart, so a reader turns all control bytes into
lengths with one table lookup and gathers all data bytes at once, without a loop over ids.

The files are a table ``ids`` with a row for each block of documents, (shard, start, doc_ids, n_tokens, control,
data), in ascending doc_id order within a shard and over shards, and a table ``ranks`` of (rank, id); start counts the
ids of all documents before the block. Spark writes them, so they may lie in any store that Spark reaches and a
lost executor's files are written again. The end-of-document id closes each document.

Plan. Documents are encoded once, into a scratch table that has each document's shard. Its ids are counted per batch and summed over the
vocabulary (which bounds what the driver gets). Shards are ranges of doc_id: their borders are picked from the ids alone,
their offsets are sums over shards (at most ``MAX_RANGES``), and one shuffle deals the encoded documents.

Edge cases. Null and empty texts are a document of one id. Null doc_ids come first; rows that share a
doc_id follow one another by their ids' bytes. Other columns are ignored, whatever their names. An empty
table makes empty files. An id that the counts have not seen can't be written (the counts are of the same table).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import col, discard, materialize
from tarn.llm.ranges import RANGE_ROWS, borders, range_of
from tarn.llm.tokens import ChunkCache, Chunked, check_words, held_cache, small_batches, spaced

#: Documents and ids a block holds at most (one document at least).
BLOCK_DOCS, BLOCK_IDS = 64, 1 << 18
_SCHEMA = "shard int, start long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"
_FIELDS = pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    n = len(ranks)
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(n, 4)[np.arange(4) < sizes[:, None]].tobytes()
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = sizes - 1
    return (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of (control bytes, data bytes)."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = padded[starts]
    for k in (1, 2, 3):
        longer = sizes > k
        if not longer.any():
            break
        out[longer] |= padded[starts[longer] + k] << np.uint32(8 * k)
    return out


#: A word that no chunk with it is joined by: it stands between the chunks of one call of the library.
_BETWEEN = "\x01"
_CHUNKS_A_CALL = 4096


class _Library:
    """The tokenizers library over many chunks at a time."""

    def __init__(self, path: str, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = np.dtype(width)
        between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk; chunks are joined by white space, at which the file's words end."""
        out: list[bytes] = []
        for at in range(0, len(chunks), _CHUNKS_A_CALL):
            some = chunks[at : at + _CHUNKS_A_CALL]
            joined = f" {_BETWEEN} ".join(some)
            ids = self._ids(joined) if self.between is not None and joined.count(_BETWEEN) == len(some) - 1 else None
            ends = np.flatnonzero(ids == self.between) if ids is not None else ()
            if len(ends) != len(some) - 1:  # a chunk holds the word between
                out += [self._ids(c).tobytes() for c in some]
                continue
            raw, w = ids.tobytes(), self.width.itemsize
            out += [raw[a:b] for a, b in zip([0, *((ends + 1) * w).tolist()], [*(ends * w).tolist(), len(raw)], strict=True)]
        return out


def _library_cache(path: str, width: str) -> ChunkCache:
    return held_cache(("library", path, width), lambda: ChunkCache(_Library(path, width).encode, pa.large_binary()))


def id_width(path: str, end_id: int) -> str:
    """The smallest of two and four bytes that holds all ids."""
    return "<u2" if max(end_id, tokenizers.Tokenizer.from_file(path).get_vocab_size() - 1) < 1 << 16 else "<u4"


def encode_raw(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", at: np.ndarray | None = None) -> DataFrame:
    """(doc_id, shard, n_tokens, raw): ids with the end id as little-endian unsigned integers of ``id_width``; shards lie between the borders ``at``."""
    check_words(path)
    width = id_width(path, end_id)
    end, size = np.array([end_id], width).tobytes(), np.dtype(width).itemsize
    known = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.int64) if at is None else at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _library_cache(path, width)
        for batch, texts in small_batches(batches, "__text"):
            raw = [bytes(x) + end for x in Chunked(spaced(texts), cache).joined()]
            columns = [batch.column(0), pa.array(range_of(batch.column(0), known.value)), pa.array([len(x) // size for x in raw], pa.int64()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "n_tokens", "raw"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("__text"))
    return rows.mapInArrow(run, "doc_id long, shard int, n_tokens long, raw binary")


def _flat(column: pa.Array, width: str) -> np.ndarray:
    """The ids of a whole column of binaries."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, width)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(width)


def id_counts(encoded: DataFrame, width: str) -> DataFrame:
    """(id, n) over all documents; each task sends a row for each id that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(_flat(batch.column(0), width))
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return encoded.select("raw").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = RANGE_ROWS) -> None:
    """Encode ``docs`` with the tokenizer file at ``path`` and write the tables ``ids`` and ``ranks`` under ``out``."""
    width = id_width(path, end_id)
    at, _ = borders(docs, id_col, shard_docs)
    encoded = materialize(encode_raw(docs, path, end_id, id_col, text_col, at), "encoded")
    counts = id_counts(encoded, width).orderBy(F.desc("n"), "id").select("id").collect()  # as many as the vocabulary has
    ids = np.array([r[0] for r in counts], np.int64)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    spark = docs.sparkSession
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{out}/ranks")
    totals = encoded.groupBy("shard").agg(F.sum("n_tokens").alias("n")).toArrow()  # MAX_RANGES at most
    sums = np.zeros(len(at) + 1, np.int64)
    sums[totals.column("shard").to_numpy()] = totals.column("n").to_numpy()
    offsets = spark.sparkContext.broadcast(np.cumsum(sums) - sums)
    known = spark.sparkContext.broadcast(rank_of)  # as many as the vocabulary has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = None, 0
        for batch in batches:
            out = []
            shards, doc_ids, sizes = (batch.column(i).to_pylist() for i in range(3))
            flat, first, at = _flat(batch.column(3), width), 0, 0
            while first < len(shards):
                s, last, n = shards[first], first, 0
                while last < len(shards) and shards[last] == s and last - first < BLOCK_DOCS and (n == 0 or n + sizes[last] <= BLOCK_IDS):
                    n += sizes[last]
                    last += 1
                if s != shard:
                    shard, start = s, int(offsets.value[s])
                out.append((s, start, doc_ids[first:last], sizes[first:last], *pack(known.value[flat[at : at + n]])))
                start, at, first = start + n, at + n, last
            yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS.names, r, strict=True)) for r in out], _FIELDS)

    ordered = encoded.select("shard", "doc_id", "n_tokens", "raw").repartitionById(len(at) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "raw")
    ordered.mapInArrow(run, _SCHEMA).write.option("compression", "none").parquet(f"{out}/ids")
    discard(encoded)


def _read(spark: SparkSession, out: str, schema: str, finish: Callable[[list[np.ndarray]], pa.Array]) -> DataFrame:
    """(doc_id, start, n_tokens, what ``finish`` makes of each document's ids) from the files."""
    ranks = spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()  # as many as the vocabulary has
    known = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], "<u4"))
    names = ["doc_id", "start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, sizes, control, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ends = np.cumsum(sizes, dtype=np.int64)
                ids = known.value[unpack(control, data, int(ends[-1]))]
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes, pa.int64()), finish(np.split(ids, ends[:-1]))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = spark.read.schema(_SCHEMA).parquet(f"{out}/ids").select("start", "doc_ids", "n_tokens", "control", "data")
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids {schema}")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>) from the files."""
    return _read(spark, out, "array<long>", lambda docs: pa.array([x.astype(np.int64) for x in docs], pa.list_(pa.int64())))


def read_checksums(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the checksum is of the ids as little-endian unsigned 32-bit integers."""
    return _read(spark, out, "long", lambda docs: pa.array([zlib.crc32(x) for x in docs], pa.int64())).withColumnRenamed("ids", "ids_crc32")

