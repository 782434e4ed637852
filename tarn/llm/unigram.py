"""Token counts of a unigram vocabulary: a count-only Viterbi.

An Aho-Corasick automaton enumerates all vocabulary entries in a word. For each end position the dynamic
program keeps the best score and the number of pieces on that path only; no lattice and no ids are built. Ties
follow the tokenizers library: of equal scores the earliest start (the longest last piece) wins, and the
unknown character comes after all entries that start with it. An unknown character scores ten less than the
worst entry and counts as many pieces as it has UTF-8 bytes (byte fallback), or with its unknown
neighbours as one.

Words. Spaces become U+2581, one is put before the text, and each word begins at one; Viterbi runs per word,
once for each distinct word of a worker's texts.

The vocabulary is a table of (piece, score): ``pieces_of`` reads those of a sentencepiece file. Counts equal
those of the library's Unigram model over the same table.

Edge cases. Null and empty texts have no tokens. Texts are never cut. Rows are independent: repeated rows
and ties get equal results. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarn.llm.common import col
from tarn.llm.tokens import ChunkCache, Chunked, held_cache, small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def words(texts: pa.Array) -> pa.ListArray:
    """The words of each text without their marks; an empty text has none."""
    texts = pc.replace_substring(texts, MARK, " ")
    # A text that begins with a space gets no mark before it: there the first word begins at the space.
    texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts))
    return pc.split_pattern(texts, " ")


class CountViterbi:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.found = ahocorasick.Automaton()
        names = {p for p, _ in pieces}
        for piece, score in pieces:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p in names if len(p) == 1}
        self.bytes_of = lambda run: len(run.encode()) if byte_fallback and all(f"<0x{b:02X}>" in names for b in run.encode()) else 1

    def count(self, word: str) -> int:
        """Pieces on the best path."""
        n = len(word)
        #: By position: score, pieces before the unknown run that ends here, start of that run (or the position itself).
        scores, pieces, runs = [0.0] * (n + 1), [0] * (n + 1), list(range(n + 1))
        ends: list[list] = [[] for _ in range(n)]
        for end, entry in self.found.iter(word):
            ends[end].append(entry)
        single, unknown = self.single, self.unknown
        for end in range(n):
            found, at = ends[end], end + 1
            if len(found) > 1:
                found.sort(reverse=True)
            top = None
            for size, score in found:
                now = scores[at - size] + score
                if top is None or now > top:
                    top, of = now, at - size
            if word[end] not in single and (top is None or scores[end] + unknown > top):
                scores[at], pieces[at], runs[at] = scores[end] + unknown, pieces[end], runs[end]
            else:
                scores[at] = top
                pieces[at] = pieces[of] + 1 + (self.bytes_of(word[runs[of] : of]) if runs[of] < of else 0)
        return pieces[n] + (self.bytes_of(word[runs[n] :]) if runs[n] < n else 0)


def _cache(path: str) -> ChunkCache:
    def make() -> ChunkCache:
        viterbi = CountViterbi(pieces_of(path))
        return ChunkCache(lambda new: [viterbi.count(MARK + w) for w in new], pa.int64())

    return held_cache(("unigram", path), make)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_words, n_tokens): a row for each input row; words as the tokenizer splits them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        for batch, texts in small_batches(batches, "__text"):
            found = Chunked(words(texts), cache)
            arrays = [batch.column(0), pc.utf8_length(texts).cast(pa.int64()), pa.array(np.diff(found.bounds)), pa.array(found.summed())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_chars", "n_words", "n_tokens"])

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("__text"))
    return rows.mapInArrow(run, "id long, n_chars long, n_words long, n_tokens long")
