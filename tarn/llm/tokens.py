"""What the operators over words share: each distinct chunk of a worker's texts is encoded once.

A tokenizer file's words never reach across the separators at which texts are split, so what a text is mapped
to is what its chunks are mapped to, one after the other. Splitting, finding a batch's distinct chunks, telling the
new ones and laying out the results are Arrow kernels; only new chunks become Python objects. A worker keeps the
chunks it has seen with their values in Arrow arrays, up to ``MAX_CHUNKS``; beyond that it forgets the half that came in the
fewest batches, so its memory is bounded for any number of words.
"""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

#: Encoded chunks a worker keeps; texts and bytes of text whose chunks are looked up together.
MAX_CHUNKS, TEXTS_AT_ONCE, BYTES_AT_ONCE = 1_000_000, 4096, 6 << 20
#: New chunks that are Python objects at once.
NEW_AT_ONCE = 16_384
#: Bytes from which a lean worker maps each array by itself, and glibc's number of that setting.
MAPPED_BYTES, _M_MMAP_THRESHOLD = 1_000_000, -3


class ChunkCache:
    """Maps distinct chunks to the values that ``encode`` makes of new ones: a value of each of ``types`` for each chunk."""

    def __init__(self, encode: Callable[[list[str]], Iterable], *types: pa.DataType, most: int = MAX_CHUNKS):
        self.encode, self.types, self.most = encode, types, most
        self.known, self.values, self.hits = pa.array([], pa.string()), [pa.array([], t) for t in types], np.zeros(0, np.int32)

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where the values of distinct chunks stand; new ones are encoded."""
        if len(self.known) > self.most:
            self._forget()
        found = pc.index_in(chunks, value_set=self.known)
        at = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            new = chunks.filter(pc.is_null(found))
            made = [self._encoded(new.slice(i, NEW_AT_ONCE)) for i in range(0, len(new), NEW_AT_ONCE)]
            at[at < 0] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.values = [pa.concat_arrays([v, *c]) for v, c in zip(self.values, zip(*made, strict=True), strict=True)]
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int32)])
        self.hits[at] += 1
        return at

    def _encoded(self, new: pa.Array) -> list[pa.Array]:
        made = list(self.encode(new.to_pylist()))
        columns = [made] if len(self.types) == 1 else zip(*made, strict=True)
        return [pa.array(c, t) for c, t in zip(columns, self.types, strict=True)]

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.hits, kind="stable")[: self.most // 2])
        self.known, self.values, self.hits = self.known.take(kept), [v.take(kept) for v in self.values], self.hits[kept] >> 1


_held: dict[tuple, ChunkCache] = {}
_LIBRARY = ctypes.CDLL(None) if os.name == "posix" else None


def held_cache(key: tuple, make: Callable[[], ChunkCache]) -> ChunkCache:
    """The worker's cache of that key. A worker keeps one: other operators' caches are dropped."""
    if key not in _held:
        release()
        _held[key] = make()
        trim()  # what was read to make it
    return _held[key]


def release() -> None:
    """Drop the worker's cache and return freed memory."""
    _held.clear()
    trim()


def trim() -> None:
    """Return freed memory to the system: a worker waits for its next task between the stages of a job."""
    pa.default_memory_pool().release_unused()
    if trims := getattr(_LIBRARY, "malloc_trim", None):
        trims(0)


def lean() -> None:
    """From now on the worker returns each large array to the system when it is freed, at the price of some more page faults."""
    if pa.default_memory_pool().backend_name != "system":
        if sets := getattr(_LIBRARY, "mallopt", None):
            sets(_M_MMAP_THRESHOLD, MAPPED_BYTES)
        pa.set_memory_pool(pa.system_memory_pool())


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after whose end freed memory is returned: while it stands, its names hold the last batch and what was made of it."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return whole


def spaced(texts: pa.Array) -> pa.ListArray:
    """Chunks between ASCII white space; some may be empty."""
    return pc.ascii_split_whitespace(texts)


class Chunked:
    """The chunks of several texts: where each text begins and ends, which chunks aren't empty, and their values."""

    def __init__(self, lists: pa.ListArray, cache: ChunkCache):
        encoded = lists.flatten().dictionary_encode()
        index = encoded.indices.to_numpy()
        self.bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        self.full = (pc.binary_length(encoded.dictionary).to_numpy() > 0)[index] if len(index) else np.zeros(0, bool)
        self.places = cache.places(encoded.dictionary)[index] if len(index) else np.zeros(0, np.int64)
        self.values = cache.values

    def joined(self, column: int = 0) -> list[memoryview]:
        """For each text the bytes of its chunks' values, one after the other."""
        if not len(self.places):
            return [memoryview(b"")] * (len(self.bounds) - 1)
        taken = self.values[column].take(self.places)
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1][self.bounds].tolist()
        whole = memoryview(data) if data is not None else memoryview(b"")
        return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def numbers(self, column: int = 0) -> np.ndarray:
        """The value of each chunk, which is a number."""
        return self.values[column].to_numpy(zero_copy_only=False)[self.places]

    def summed(self, column: int = 0) -> np.ndarray:
        """For each text the sum of its chunks' values."""
        total = np.concatenate([[0], np.cumsum(self.numbers(column))]).astype(np.int64)
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


@functools.cache
def check_words(path: str) -> None:
    """Raise unless a tokenizer file's words end at ASCII white space, so that chunks between it can be encoded alone."""
    tokenizer = tokenizers.Tokenizer.from_file(path)
    for text in ("a b", "a  b", "1\t2", "a\n\nb", " \x0ba\x0c.\r", "a. b, c", "it 's a  's"):
        alone = [i for chunk in text.split() for i in tokenizer.encode(chunk, add_special_tokens=False).ids]
        if tokenizer.encode(text, add_special_tokens=False).ids != alone:
            raise ValueError(f"words of {path} reach across white space")


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = BYTES_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a bounded size (one text at least) with the texts of ``column``; null texts are empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column).cast(pa.string()), "")
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))])
        at = 0
        while at < batch.num_rows:
            rows = int(np.searchsorted(size, size[at] + most, "right")) - 1 - at
            rows = max(1, min(TEXTS_AT_ONCE, rows, batch.num_rows - at))
            yield batch.slice(at, rows), texts.slice(at, rows)
            at += rows
        pa.default_memory_pool().release_unused()
    trim()
