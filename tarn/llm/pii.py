"""Personal data by bootstrapped contextual extraction.

Seeds. Four kinds of identifier have a fixed form (``email``, ``ip``, ``card`` with a Luhn digit, ``phone``); their matches
are certain and always stay. Each also induces two lexical patterns: the words before and after it, and the two
words before it. Candidates are strings of an identifier's shape that the forms don't take (an address without
a dot, a number without its plus sign or with a wrong check digit), with the kinds that their shape allows. They lie between
base spans; a run of more digits than any kind has is cut where it has separators.

Scoring. A pattern is induced if ``MIN_SEEDS`` different seeds of a kind occur in it. A second scan counts how
often each induced pattern occurs around any word at all, or any words as many as a seed or candidate in it has, so that common
words around an identifier are no evidence. Then patterns and candidates score each other for ``ROUNDS`` rounds: a pattern's confidence is the share of its
occurrences that hold seeds or candidates, the latter by their scores, and a candidate's score is the
chance that one of its patterns is right. Candidates in a pattern of at least ``MIN_CONFIDENCE`` are identifiers of its kind.

Scale. Texts are scanned twice and never shuffled. Of the first scan only seeds and candidates are kept, with 64-bit
hashes of their patterns and values. The second scan tests its word pairs against a bitmap of ``FILTER_BITS`` bits, which is all
that is broadcast; what passes is summed per batch and joined exactly. Frequent patterns are pre-aggregated, and patterns and values that
are counted to be frequent are dealt out in joins.

Edge cases. A null text counts as empty. Texts are scanned whole, in linear time. Repeated rows each count and get
equal spans. A candidate that several kinds claim goes to the one of higher confidence, then the first as listed. A word beyond
either end of the text is the empty word. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import col, materialize, skew_join
from tarn.llm.tokens import ChunkCache, Chunked, held_cache, small_batches, spaced

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, ROUNDS, MIN_CONFIDENCE, FILTER_BITS = 3, 3, 0.8, 1 << 26

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[ ().:/-]{0,2}[0-9]){6,}+")
_DIGITS = re.compile(r"[0-9]+")
_FOUR = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
#: Digits of the longest kind.
MAX_DIGITS = 19
_NOT_IN_ADDRESS = frozenset(" \t\n\r\f\v@<>\"'(),;:")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email form, found from each @ outwards: leftmost, not overlapping, in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of all fixed forms, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part_fits, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _between(length: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a text that no base span covers."""
    at = 0
    for a, _, b in base:
        if a > at:
            yield at, a
        at = max(at, b)
    if at < length:
        yield at, length


def _number_bits(text: str) -> int:
    digits = sum(map(str.isdigit, text))
    return 2 * bool(_FOUR.fullmatch(text)) | 4 * (12 <= digits <= 19) | 8 * (7 <= digits <= 15)


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Number-shaped strings of a part; runs of more than MAX_DIGITS digits in pieces of whole digit groups."""
    for m in _NUMBER.finditer(text, start, end):
        a, b, digits = m.start(), m.start(), 0
        for group in _DIGITS.finditer(text, m.start(), m.end()):
            n = group.end() - group.start()
            if digits and digits + n > MAX_DIGITS:
                yield a, b, _number_bits(text[a:b])
                digits = 0
            if not digits:
                a = group.start()
            b, digits = group.end(), digits + n
        yield a, b, _number_bits(text[a:b])


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, bits of the kinds its shape allows) of identifier-shaped strings between the base spans."""
    found = []
    for start, end in _between(len(text), base):
        at = text.find("@", start, end)
        while at >= 0:
            a, b = at, at + 1
            while a > start and text[a - 1] not in _NOT_IN_ADDRESS:
                a -= 1
            while b < end and text[b] not in _NOT_IN_ADDRESS:
                b += 1
            while b > at + 1 and text[b - 1] in ".!?":
                b -= 1
            if a < at < b - 1:
                found.append((a, b, 1))
            at = text.find("@", max(b, at + 1), end)
        found += [x for x in _numbers(text, start, end) if x[2]]
    return sorted(found)


# --- patterns -------------------------------------------------------------------------------------------------

_CHUNK = re.compile(r"[^ \t\n\r\f\v]+")
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&"
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.strip(_STRIP).lower().encode(), digest_size=8).digest(), "little")


def _around(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _mixed(before * _K[0] + after * _K[1] + np.uint64(1))


def _ahead(second: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _mixed(second * _K[2] + first * _K[3] + np.uint64(2))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _K[3]
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class _Chunks:
    """The ASCII white-space chunks of a text."""

    def __init__(self, text: str):
        found = [m.span() for m in _CHUNK.finditer(text)]
        self.text, self.starts, self.ends = text, [a for a, _ in found], [b for _, b in found]
        self.hashes: dict[int, int] = {}

    def _hash(self, i: int) -> int:
        if i not in self.hashes:
            self.hashes[i] = _word_hash(self.text[self.starts[i] : self.ends[i]] if 0 <= i < len(self.starts) else "")
        return self.hashes[i]

    def patterns(self, start: int, end: int) -> tuple[int, list[int]]:
        """How many chunks a span touches, and the hashes of its two patterns, of the whole chunks around those."""
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        h = [np.array([self._hash(k)], np.uint64) for k in (i - 2, i - 1, j)]
        return j - i, [int(_around(h[1], h[2])[0]), int(_ahead(h[0], h[1])[0])]


def _value_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode(), digest_size=8).digest(), "little", signed=True)


_MENTION = "array<struct<start:long,end:long,kinds:int,value:long,chunks:int,patterns:array<long>>>"
_FOUND = f"__row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, seeds {_MENTION}, candidates {_MENTION}"


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each input row with its seeds and candidates."""
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kinds", pa.int32()), ("value", pa.int64()), ("chunks", pa.int32()), ("patterns", pa.list_(pa.int64()))])
    fields = [pa.int64()] * 6 + [pa.string(), pa.list_(struct), pa.list_(struct)]
    names = ["__row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "seeds", "candidates"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in small_batches(batches, "__text"):
            rows = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts.to_pylist(), strict=True):
                base = base_spans(text)
                others = candidates(text, base)
                chunks = _Chunks(text) if base or others else None

                def mention(a: int, b: int, kinds: int, text: str = text, chunks: _Chunks | None = chunks) -> dict:
                    n, patterns = chunks.patterns(a, b)
                    return {"start": a, "end": b, "kinds": kinds, "value": _value_hash(text[a:b]), "chunks": n, "patterns": patterns}

                counts = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append((row, doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), [mention(a, b, 1 << k) for a, k, b in base], [mention(*c) for c in others]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), col(id_col).cast("long").alias("doc_id"), col(text_col).alias("__text"))
    return rows.mapInArrow(run, _FOUND)


def _mentions(found: DataFrame, column: str) -> DataFrame:
    """(row, start, end, kind, value, chunks, pattern): a row for each mention, kind and pattern."""
    kinds = F.filter(F.array(*map(F.lit, range(4))), lambda k: F.col("m.kinds").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) > 0)
    each = found.select("__row", F.explode(column).alias("m")).select("__row", "m.start", "m.end", "m.value", "m.chunks", "m.patterns", F.explode(kinds).alias("kind"))
    return each.select("__row", "start", "end", "kind", "value", "chunks", F.explode("patterns").alias("pattern"))


def _occurrences(docs: DataFrame, text_col: str, induced: DataFrame, lengths: list[int]) -> DataFrame:
    """(pattern, total): how often each induced pattern occurs around any chunk, or any run of as many chunks as ``lengths`` lists."""
    spot = F.pmod("pattern", F.lit(FILTER_BITS))
    bits = induced.select((spot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")).alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 64 at most
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little").nonzero()[0] if len(words) < 1000 else bitmap)
    small = len(words) < 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if small:
            bits = np.zeros(FILTER_BITS, bool)
            bits[known.value] = True
        else:
            bits = np.unpackbits(known.value.view(np.uint8), bitorder="little").view(bool)
        nothing = np.uint64(_word_hash(""))
        hashes = held_cache(("contexts",), lambda: ChunkCache(lambda new: map(_word_hash, new), pa.uint64()))
        for batch, texts in small_batches(batches, "__text"):
            found = Chunked(spaced(texts), hashes)
            # Chunks without the empty ones that leading and trailing white space leaves.
            texts_of = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))[found.full]
            h = found.numbers()[found.full]
            n = len(h)
            if not n:
                continue
            before, second, after = (np.full(n, nothing) for _ in range(3))
            before[1:] = np.where(texts_of[1:] == texts_of[:-1], h[:-1], nothing)
            after[:-1] = np.where(texts_of[1:] == texts_of[:-1], h[1:], nothing)
            second[2:] = np.where(texts_of[2:] == texts_of[:-2], h[:-2], nothing)
            kept = []
            for k in lengths:
                within = np.flatnonzero(texts_of[: n - k + 1] == texts_of[k - 1 :]) if k <= n else np.zeros(0, np.int64)
                seen = _around(before[within], after[within + k - 1])
                kept.append(seen[bits[seen & (FILTER_BITS - 1)]])
            seen = _ahead(second, before)
            seen = np.concatenate([*kept, seen[bits[seen & (FILTER_BITS - 1)]]])
            patterns, counts = np.unique(seen, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(counts.astype(np.int64))], ["pattern", "n"])

    counted = docs.select(col(text_col).alias("__text")).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counted.join(induced.select("pattern").distinct(), "pattern", "left_semi")


def confident_patterns(docs: DataFrame, text_col: str, found: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(kind, pattern, confidence) of at least MIN_CONFIDENCE and (kind, pattern, mentions) of all with candidates; None without such."""
    seeds = _mentions(found, "seeds").groupBy("kind", "pattern", "value").agg(F.count("*").alias("n"))
    induced = seeds.groupBy("kind", "pattern").agg(F.count("*").alias("seeds"), F.sum("n").alias("positives")).filter(F.col("seeds") >= MIN_SEEDS)
    induced = materialize(induced.select("kind", "pattern", "positives"), "induced")
    edges = _mentions(found, "candidates").groupBy("kind", "pattern", "value").agg(F.count("*").alias("n")).join(induced, ["kind", "pattern"], "left_semi")
    edges = materialize(edges, "edges")
    if edges.isEmpty():
        return None
    spans = _mentions(found, "seeds").union(_mentions(found, "candidates")).join(induced, ["kind", "pattern"], "left_semi")
    lengths = sorted({1} | {r.chunks for r in spans.select("chunks").distinct().collect()})
    induced = materialize(induced.join(_occurrences(docs, text_col, induced, lengths), "pattern"), "totals")
    in_pattern = materialize(edges.groupBy("kind", "pattern").agg(F.count("*").alias("edges"), F.sum("n").alias("mentions")), "in_pattern")
    of_value = materialize(edges.groupBy("kind", "value").agg(F.count("*").alias("edges")), "of_value")
    scores = None
    for round_ in range(ROUNDS):
        held = edges.withColumn("score", F.lit(0.0)) if scores is None else skew_join(edges, scores, ["kind", "value"], "edges", "pattern", counts=of_value)
        gained = held.groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("score")).alias("gained"))
        confidence = F.least(F.lit(0.999), (F.col("positives") + F.coalesce("gained", F.lit(0.0))) / F.greatest("total", "positives"))
        patterns = materialize(induced.join(gained, ["kind", "pattern"], "left").select("kind", "pattern", confidence.alias("confidence")), f"patterns{round_}")
        missed = F.sum(F.log(1 - F.col("confidence")))
        scores = skew_join(edges, patterns, ["kind", "pattern"], "edges", "value", counts=in_pattern.select("kind", "pattern", "edges"))
        scores = scores.groupBy("kind", "value").agg((1 - F.exp(missed)).alias("score"))
    return patterns.filter(F.col("confidence") >= MIN_CONFIDENCE), in_pattern.select("kind", "pattern", "mentions")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found): a row for each input row.

    The counts and the digest are of the base spans; ``spans`` has all of them, ``found`` those that patterns added,
    as arrays of (start, kind, end).
    """
    found = materialize(scan(docs, id_col, text_col), "found")  # row numbers are fixed here
    span = "array<struct<start:long,kind:int,end:long>>"
    base = F.transform("seeds", lambda m: F.struct(m["start"].alias("start"), F.log2(m["kinds"].cast("double")).cast("int").alias("kind"), m["end"].alias("end")))
    learnt = confident_patterns(docs, text_col, found)
    if learnt is None:
        rows = found.withColumn("found", F.array().cast(span))
    else:
        hits = skew_join(_mentions(found, "candidates"), learnt[0], ["kind", "pattern"], "mentions", "__row", counts=learnt[1])
        best = hits.groupBy("__row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
        added = best.groupBy("__row").agg(F.collect_list(F.struct("start", (-F.col("best.k")).cast("int").alias("kind"), "end")).alias("found"))  # of one text
        rows = found.join(added, "__row", "left").withColumn("found", F.coalesce("found", F.array().cast(span)))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text(F.array_sort(F.concat(base, "found"))).alias("spans"), "found")
