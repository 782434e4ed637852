"""Quality classifier: compressed sizes under two zstandard dictionaries.

One dictionary is trained on texts labelled 1 and one on texts labelled 0. A text is cut into windows of ``WINDOW``
bytes, all of them compressed with either dictionary; windows are short so that a dictionary counts for more than what
the window itself has shown. The difference of the two total sizes, normalised by the text's own size, goes through a logistic
curve that is fitted on labelled rows that trained neither dictionary: a calibrated probability of label 1.

Training reads a bounded sample of labelled rows in hash order: ``DICTIONARY_ROWS`` and ``CALIBRATION_ROWS`` of each
label. Of a dictionary row ``TEXT_WINDOWS`` windows, evenly spaced over its text, go to the driver; the whole texts of calibration rows are
compressed where they are. Rows with crc32(id as text) mod 3 = 1 are held out and never read in training. Scoring
is one pass over the documents without a shuffle; the model is two dictionaries of ``DICTIONARY_BYTES`` and two numbers.

Edge cases. A null text counts as empty; an empty text scores as any text without a size difference. Null ids aren't
held out and carry no label. A document that is labelled both ways trains nothing. If a label has no rows, every score is the
share of label 1 (0.5 without labels). Texts are never cut off. Repeated rows get equal scores. Other columns are
passed through by ``classify``, whatever their names; a score column of a name that is taken is refused. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tarn.llm.common import col, discard, fresh, materialize, text_or_empty
from tarn.llm.tokens import release, returning

#: Rows of each label that the dictionaries and the curve are fitted on, and windows of a dictionary row that the driver gets.
DICTIONARY_ROWS, CALIBRATION_ROWS, TEXT_WINDOWS = 600, 1000, 16
WINDOW, DICTIONARY_BYTES, LEVEL = 1024, 112640, 3


def held_out(id_col: str | Column) -> Column:
    """Whether the id's remainder keeps it out of training."""
    return F.coalesce(F.crc32((col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _windows(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def _spread(windows: list[bytes]) -> list[bytes]:
    """TEXT_WINDOWS of them at most, evenly spaced."""
    n = len(windows)
    return windows if n <= TEXT_WINDOWS else [windows[i * n // TEXT_WINDOWS] for i in range(TEXT_WINDOWS)]


def _dictionary(windows: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, windows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-DICTIONARY_BYTES:]


class _Sizes:
    """Total compressed sizes of a text under the two dictionaries."""

    def __init__(self, bad: bytes, good: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.compressors = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **options).compress for d in (bad, good)]

    def difference(self, text: str) -> float:
        """How many bytes less the good dictionary leaves, for each byte of the text."""
        windows = _windows(text)
        if not windows:
            return 0.0
        bad, good = (sum([len(c(w)) for w in windows]) for c in self.compressors)
        return (bad - good) / sum(map(len, windows))


@dataclass(frozen=True)
class QualityModel:
    bad: bytes
    good: bytes
    weights: tuple[float, float]

    def score(self, difference: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * difference, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton steps with a weak ridge; both labels weigh as they occur in the labelled rows (see ``fit``)."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    ridge = np.diag([1e-6, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(label, place, text): the sample, numbered by label in hash order; a written table of at most 2 * (DICTIONARY_ROWS + CALIBRATION_ROWS) rows."""
    most = DICTIONARY_ROWS + CALIBRATION_ROWS
    picked = [labels.filter(F.col("label") == q).orderBy(F.xxhash64("__id"), "__id").limit(most) for q in (0, 1)]
    rows = docs.select(col(id_col).alias("__id"), text_or_empty(text_col).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "__id")
    order = Window.partitionBy("label").orderBy(F.xxhash64("__id"), "__id", "text")
    return materialize(rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("label", "place", "text"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on labelled rows that aren't held out."""
    one = labels.filter(~held_out(id_col)).groupBy(col(id_col).alias("__id")).agg(F.min(col(label_col)).alias("low"), F.max(col(label_col)).alias("high"))
    one = one.filter("__id is not null and low = high").select("__id", F.col("low").cast("int").alias("label"))
    shares = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    bad, good = shares.get(0, 0), shares.get(1, 0)
    share = min(1 - 1e-9, max(1e-9, good / (bad + good))) if bad + good else 0.5
    constant = QualityModel(b"", b"", (float(np.log(share / (1 - share))), 0.0))
    if not bad or not good:
        return constant
    sample = _labelled(docs, one, id_col, text_col)
    rows = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(rows) < 2:
        return constant
    # Of few rows a share is left for the curve.
    cut = {q: min(DICTIONARY_ROWS, max(1, n * DICTIONARY_ROWS // (DICTIONARY_ROWS + CALIBRATION_ROWS))) for q, n in rows.items()}
    of_label = F.when(F.col("label") == 1, F.lit(cut[1])).otherwise(F.lit(cut[0]))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [_spread(_windows(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(some, pa.list_(pa.binary()))], ["label", "place", "windows"])

    kept = sample.select("label", "place", "text")
    found = kept.filter(F.col("place") <= of_label).mapInArrow(windows, "label int, place int, windows array<binary>").orderBy("place").collect()
    bad_bytes, good_bytes = (_dictionary([bytes(w) for r in found if r["label"] == q for w in r["windows"]]) for q in (0, 1))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(bad_bytes, good_bytes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sizes.difference(t) for t in batch.column(2).to_pylist()], pa.float64())], ["label", "place", "x"])

    fits = (F.col("place") > of_label) | F.when(F.col("label") == 1, F.lit(cut[1] >= rows[1])).otherwise(F.lit(cut[0] >= rows[0]))
    rest = kept.filter(fits).mapInArrow(differences, "label int, place int, x double").orderBy("label", "place").collect()
    discard(sample)
    x, y = np.array([r["x"] for r in rest]), np.array([r["label"] for r in rest], float)
    w = _logistic(x, y)
    # The sample has as many rows of either label as it can: shift to the labels' own shares.
    shift = np.log(good / bad) - np.log(max(1, y.sum()) / max(1, len(y) - y.sum()))
    return QualityModel(bad_bytes, good_bytes, (float(w[0] + shift), w[1]))


def classify(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "__score") -> DataFrame:
    """The input's columns and the score of each row."""
    if fresh(docs, score_col.lower()) != score_col.lower():
        raise ValueError(f"there is a column {score_col} already")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sizes = _Sizes(model.bad, model.good)
        for batch in batches:
            scores = [model.score(sizes.difference(x.as_py() or "")) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(returning(run), StructType([*docs.schema.fields, *StructType.fromDDL(f"`{score_col}` double").fields]))
