"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors modulo powers of two. Sums don't depend on the order of paragraphs, and a paragraph is inserted or deleted
by adding or subtracting its vector, without the rest of the text. The vector has two parts:

* ``EXACT`` lanes of 64 bits from a keyed hash of the whole paragraph: documents with equal multisets of
  paragraphs have equal sums, others differ but for a chance of about 2**-64 a lane.
* ``LANES`` lanes of 32 bits, to which each run of ``WINDOW`` characters of the paragraph adds 1 or -1. The cosine
  of two documents' lanes estimates that of their counts of runs, with a standard error of about LANES**-0.5. A text
  has fewer runs than 2**31, so a lane of one text never wraps.

Order. The next document of a document is found by dealing the documents out in ranges of doc_id, in one shuffle;
the largest document of a range also goes to the next range, and the largest of all to the first one. The borders of ranges are found
by binary search in Arrow batches.

Edge cases. A null text counts as empty, which is one empty paragraph. A null doc_id is the smallest. Rows with the
same doc_id follow one another by text, descending; equal ones are neighbours with equal results. Of one row, the
next document is that row. Texts are never cut. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import col, text_or_empty
from tarn.llm.ranges import borders, range_of

EXACT, LANES, WINDOW = 8, 128, 12
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
_DEALT = ["range", "copy", "doc_id", "text"]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


class Fingerprint:
    """The two parts as arrays; ``+`` and ``-`` join and take apart multisets of paragraphs."""

    __slots__ = ("exact", "lanes")

    def __init__(self, exact: np.ndarray, lanes: np.ndarray):
        self.exact, self.lanes = exact, lanes

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        paragraphs = text.split("\n")
        digests = b"".join([hashlib.blake2b(p.encode(), digest_size=8 * EXACT).digest() for p in paragraphs])
        exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
        # Between paragraphs stand so many line ends that no run has characters of two of them.
        gap = "\n" * (WINDOW - 1)
        c = np.frombuffer((gap + gap.join(paragraphs) + gap).encode("utf-32-le"), "<u4").astype(np.uint64)
        two = c[:-1] * _POWERS[0] + c[1:]
        four = two[:-2] * _POWERS[1] + two[2:]
        eight = four[:-4] * _POWERS[2] + four[4:]
        h = eight[:-4] * _POWERS[2] + four[8:]
        h ^= h >> np.uint64(32)
        h *= _MIX
        seen = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=2 * LANES)
        return cls(exact, (seen[:LANES] - seen[LANES:]).astype(np.int32).view(np.uint32))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.lanes - other.lanes)

    def hex(self) -> str:
        return self.exact.astype("<u8").tobytes().hex() + self.lanes.astype("<u4").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[: 8 * EXACT], "<u8").astype(np.uint64), np.frombuffer(raw[8 * EXACT :], "<u4").astype(np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets of paragraphs, else the cosine of the lanes, at least 0."""
        if np.array_equal(self.exact, other.exact):
            return 1.0
        a, b = self.lanes.view(np.int32).astype(np.float64), other.lanes.view(np.int32).astype(np.float64)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first ones, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): a row for each input row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Fingerprint.of(x.as_py()).hex() for x in batch.column(1)], pa.string())], ["id", "fingerprint"])

    return docs.select(col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, fingerprint string")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): a row for each input row."""
    at, largest = borders(docs, id_col)
    known = docs.sparkSession.sparkContext.broadcast(at)  # MAX_RANGES at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value
        for batch in batches:
            ids = batch.column(0)
            own = range_of(ids, at)
            numbers, null = pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False)
            bordering = np.zeros(len(ids), bool)
            inner = (own < len(at)) & ~null
            bordering[inner] = at[own[inner]] == numbers[inner]  # follows the next range's smallest
            first = null if largest is None else ~null & (numbers == largest)  # follows the smallest of all
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(ids), np.int32)), *batch.columns], _DEALT)
            for rows, range_, copy in ((np.flatnonzero(bordering), own + 1, 1), (np.flatnonzero(first), 0 * own, 2)):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(range_[rows]), pa.array(np.full(len(rows), copy, np.int32)), *batch.take(pa.array(rows)).columns], _DEALT)

    dealt = docs.select(col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(deal, "range int, copy int, doc_id long, text string")
    dealt = dealt.repartitionById(len(at) + 1, F.col("range")).sortWithinPartitions(F.col("range"), F.col("copy"), F.desc_nulls_last("doc_id"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a document whose next one has not come yet
        for batch in batches:
            out = []
            for copy, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                print_ = Fingerprint.of(text) if copy == 0 or held else None
                if held:
                    text0 = held[1]
                    new = edited(text0, text)
                    new_print = Fingerprint.of(new)
                    out.append((held[0], len(text0), hashlib.sha256(new.encode()).hexdigest(), held[2].hex(), new_print.hex(), held[2].likeness(new_print), held[2].likeness(print_)))
                held = (doc_id, text, print_) if copy == 0 else None
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], _NAMES)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
