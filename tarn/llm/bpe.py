"""BPE encoding and decoding: speculate and verify.

A word is first cut greedily into the longest vocabulary entries. Merging by rank gives exactly that cut if
each piece is what merging makes of its own characters and no merge would cross any of the borders; the
second holds for a whole word if it holds for each pair of neighbours alone. Whether a merge crosses the
border of a pair is tested for all pairs of all new words at once, with numpy: going back in time, the
younger of the two entries at the border is taken apart, and a merge of the two entries that stand there
together crosses it if its rank comes before that at which one of them was used up. Words with a failing
pair are merged exactly. Each distinct chunk of a worker's texts goes through this once.

Ids equal those of the tokenizers library for the same file, added tokens included; so does the decoded text.

Edge cases. Null and empty texts have no ids and decode to the empty text. Texts are never cut; memory for a
very long text is in proportion to it. Rows are independent: repeated rows and ties get equal results. Only
the id and text columns are read, and those to keep. An empty table gives an empty result. A tokenizer file whose words
reach across ASCII white space is refused.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.llm.common import col
from tarn.llm.tokens import ChunkCache, Chunked, check_words, held_cache, lean, returning, small_batches, spaced, trim

WORD_END = "</w>"
_NEVER = np.int64(1) << 40
#: Signs that are a word of their own after a letter.
SIGNS = frozenset(".,;:!?")
#: Words a worker keeps beside the chunks they occur in.
MAX_WORDS = 100_000
#: Chunks a worker keeps, and bytes of text that are encoded together: its memory comes on top of what an executor took for earlier stages.
MAX_CHUNKS, BYTES_AT_ONCE = 500_000, 3 << 20


def _byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class WordBpe:
    """The encoder of a tokenizer file with word ends, lower case and a pattern that drops white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_at = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        #: Beyond Latin the library's own tables decide what is a letter; Unicode versions differ there.
        self.library = tokenizers.Tokenizer.from_file(path)
        self.exotic = regex.compile("[^\\x00-\u012f\u0131-\u024f]")
        self.word_at = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p))
        self.alphabet = _byte_alphabet()
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(WORD_END)}
        self.final = {t.removesuffix(WORD_END): i for t, i in self.vocab.items() if t.endswith(WORD_END)}
        n = max(self.tokens) + 1
        self.size = n
        self.left, self.right, self.birth = (np.full(n, -1, np.int64) for _ in range(3))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.vocab[self._name(pair)]
            self.merges[a, b] = rank, made
            if self.birth[made] < 0:
                self.left[made], self.right[made], self.birth[made] = a, b, rank
        codes = np.array([a * n + b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self._drop_unreachable()
        self.longest = max(map(len, self.inner))
        #: The longest entry by its first three characters.
        self.reach: dict[str, int] = {}
        for t in self.inner:
            if len(t) > 2:
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        self.known_words: dict[str | tuple[str], list[int]] = {}

    @staticmethod
    def _name(pair) -> str:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        return a + b

    def _drop_unreachable(self) -> None:
        """Entries that merging doesn't make of their own characters are never proposed."""
        for own, end in ((self.inner, ""), (self.final, WORD_END)):
            for t in [t for t, i in own.items() if self.birth[i] >= 0 and self._merge(self._symbols(t, end)) != [i]]:
                del own[t]

    def _symbols(self, word: str, end: str = WORD_END) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + end]]

    def _merge(self, ids: list[int]) -> list[int]:
        """Exact merging: always the lowest rank, of equal ones the leftmost."""
        if len(ids) > 64:
            return self._merge_long(ids)
        merges, never = self.merges, (1 << 40, 0)
        ranks = [merges.get(p, never)[0] for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < 1 << 40:
            i = ranks.index(low)
            ids[i : i + 2] = [merges[ids[i], ids[i + 1]][1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), never)[0]
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), never)[0]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, n log n in the length."""
        after = list(range(1, len(ids))) + [-1]
        before = [-1, *range(len(ids) - 1)]
        ids = list(ids)
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _propose(self, word: str) -> list[int]:
        """Greedy longest match; the last entry carries the word end."""
        out, at, n = [], 0, len(word)
        inner, final, longest, reach = self.inner, self.final, self.longest, self.reach
        while True:
            if n - at <= longest and (i := final.get(word[at:])) is not None:
                out.append(i)
                return out
            for stop in range(min(n - 1, at + reach.get(word[at : at + 3], 2)), at, -1):
                if (i := inner.get(word[at:stop])) is not None:
                    out.append(i)
                    at = stop
                    break

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps the border between each pair of neighbours."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        used_a = used_b = np.full(len(a), _NEVER)
        while len(at):
            code = a * self.size + b
            found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            rank = np.where(self.codes[found] == code, self.ranks[found], _NEVER)
            crossed = (rank < used_a) & (rank <= used_b) & (rank < _NEVER)
            good[at[crossed]] = False
            born_a, born_b = self.birth[a], self.birth[b]
            on = ~crossed & ((born_a >= 0) | (born_b >= 0))
            at, a, b, used_a, used_b, born_a, born_b = (x[on] for x in (at, a, b, used_a, used_b, born_a, born_b))
            split_a = born_a > born_b
            a, used_a = np.where(split_a, self.right[a], a), np.where(split_a, born_a, used_a)
            b, used_b = np.where(split_a, b, self.left[b]), np.where(split_a, used_b, born_b)
        return good

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, given in the byte alphabet."""
        cuts = [self._propose(w) for w in words]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        if not sizes.sum():
            return cuts
        flat = np.fromiter((i for c in cuts for i in c), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(cuts)), sizes)
        inside = owner[1:] == owner[:-1]
        a, b = flat[:-1][inside], flat[1:][inside]
        pairs, back = np.unique(a * self.size + b, return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        for w in np.unique(owner[1:][inside][~good]):
            cuts[w] = self._merge(self._symbols(words[w]))
        return cuts

    def split_words(self, text: str) -> list[str]:
        """The words of a text in the byte alphabet."""
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
            if text[:-1].isalpha() and text[-1] in SIGNS:
                return [text[:-1].lower(), text[-1]]
            words = self.word_at.findall(text.lower())
            return words if text.isprintable() else ["".join(map(self.alphabet.__getitem__, w.encode())) for w in words]
        if self.exotic.search(text):
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        words = self.word_at.findall(unicodedata.normalize("NFC", text).lower())
        return [w.encode().decode("latin-1").translate(self.alphabet) for w in words]

    def encode_chunks(self, texts: list[str]) -> list[list[int]]:
        """Ids of chunks without white space."""
        parts: list[list] = []
        for text in texts:
            if self.added_at and "<" in text:
                own: list = []
                for piece in filter(None, self.added_at.split(text)):
                    own += [(piece,)] if piece in self.added else self.split_words(piece)
                parts.append(own)
            else:
                parts.append(self.split_words(text))
        known = self.known_words
        if len(known) > MAX_WORDS:
            known.clear()
        new = list({w for own in parts for w in own} - known.keys())
        plain = [w for w in new if isinstance(w, str)]
        known.update(zip(plain, self.words(plain), strict=True))
        known.update((w, [self.added[w[0]]]) for w in new if not isinstance(w, str))
        return [known[own[0]] if len(own) == 1 else [i for w in own for i in known[w]] for own in parts]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One for each worker process."""
    return WordBpe(path)


def _cache(path: str) -> ChunkCache:
    """Chunk to (ids, their tokens as decoded, each followed by a space)."""
    return held_cache(("bpe", path), lambda: _new_cache(path))


def _new_cache(path: str) -> ChunkCache:
    bpe = load(path)
    names = {i: f"{t} ".encode() for i, t in bpe.tokens.items()}

    def encode(new: list[str]) -> Iterator[tuple[bytes, bytes]]:
        for ids in bpe.encode_chunks(new):
            yield array("I", ids).tobytes(), b"".join([names[i] for i in ids])

    return ChunkCache(encode, pa.large_binary(), pa.large_binary(), most=MAX_CHUNKS)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """(id, the columns of ``keep``, n_tokens, ids array<int>, ids_sha256, decoded_sha256): a row for each input row.

    A kept column with the name of another one gets an underscore.
    """
    check_words(path)
    own = {"id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "__text"}
    rows = docs.select(col(id_col).alias("id"), *[col(c).alias(f"{c}_" if c.lower() in own else c) for c in keep], col(text_col).alias("__text"))
    added = "n_tokens long, " + ("ids array<int>, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"
    schema = StructType(rows.drop("__text").schema.fields + StructType.fromDDL(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        cache = _cache(path)
        for batch, texts in small_batches(batches, "__text", BYTES_AT_ONCE):
            found = Chunked(spaced(texts), cache)
            ids = found.joined(0)
            n = [len(x) // 4 for x in ids]
            columns = [*batch.columns[:-1], pa.array(n, pa.int64())]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat))
            columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
            columns.append(pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in found.joined(1)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)
            trim()

    return rows.mapInArrow(returning(run), schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` without the ids themselves."""
    return encode(docs, path, id_col, text_col, with_ids=False)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The input with a column ``decoded``: the tokens of an id array as one text; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def decoded(ids):  # a Series of arrays
        bpe = load(path)
        return ids.map(lambda x: "" if x is None else bpe.decode(x))

    return encoded.withColumn("decoded", decoded(col(ids_col)))
