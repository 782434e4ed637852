"""Ranges of an id: how the operators that need documents in id order deal them out in one shuffle.

Borders are ids of the table itself, picked by a hash of the id, ``OVERSAMPLE`` times as many as ranges, of which every
``OVERSAMPLE``-th is kept: ranges are about equally full however the ids lie. At most ``MAX_RANGES`` borders exist; their
number is known before they are read, and a range holds more rows beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import col

#: Rows a range should hold, the most ranges, and picked ids for each range.
RANGE_ROWS, MAX_RANGES, OVERSAMPLE = 4096, 1 << 17, 8


def borders(df: DataFrame, id_col: str, rows: int = RANGE_ROWS) -> tuple[np.ndarray, int | None]:
    """Sorted ids that are the largest of their range (all but the last range) and the largest of all; taken from the ids alone."""
    ids = df.select(col(id_col).cast("long").alias("id"))
    total, largest = ids.agg(F.count("*"), F.max("id")).first()
    n = min(MAX_RANGES, total // rows)
    if n < 2:
        return np.zeros(0, np.int64), largest
    every = max(1, total // (n * OVERSAMPLE))
    picked = ids.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).distinct().toArrow()  # MAX_RANGES * OVERSAMPLE or so
    at = np.sort(picked.column("id").to_numpy())[OVERSAMPLE - 1 :: OVERSAMPLE]
    return at[at < largest] if largest is not None else at[:0], largest


def range_of(ids: pa.Array, at: np.ndarray) -> np.ndarray:
    """The number of borders below each id; null is in the first range."""
    found = np.searchsorted(at, pc.fill_null(ids, 0).to_numpy()).astype(np.int32)
    found[pc.is_null(ids).to_numpy(zero_copy_only=False)] = 0
    return found
