"""Column functions over text: normalising, tokens, sentences, evidence."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tarn.functions import fixed_values as V
from tarn.functions.fixed_values import CJK

KEYWORDS = [k.lower() for words in V.TOPIC_KEYWORDS.values() for k in words]


def literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; in a lambda a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end (``trim`` takes U+0020 only)."""
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def normalize(text: Column) -> Column:
    return strip(F.lower(F.coalesce(text, F.lit(""))))


def contained(text: Column, words: list[str]) -> Column:
    """The words that the text contains, in list order."""
    return F.filter(literals(words), lambda w: F.contains(text, w))


def _bigrams(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(run) - 2), lambda i: F.substring(run, i + 1, F.lit(2)))


def tokens(text: Column) -> Column:
    """Dictionary keywords once each, Latin words of three letters, and each CJK run with its bigrams; repeats count."""

    def of(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(f"[{V.CJK}]{{2,}}"), F.lit(0))
        return F.concat(contained(t, KEYWORDS), F.regexp_extract_all(t, F.lit("[a-zA-Z]{3,}"), F.lit(0)), F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), _bigrams(r)))))

    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def query_terms(text: Column) -> Column:
    """Distinct keywords, Latin words and CJK runs, in order."""
    of = lambda t: F.array_distinct(F.concat(contained(t, KEYWORDS), F.regexp_extract_all(t, F.lit("[a-zA-Z]{3,}"), F.lit(0)), F.regexp_extract_all(t, F.lit(f"[{V.CJK}]{{2,}}"), F.lit(0))))
    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def topic_score(query: Column, text: Column) -> Column:
    """Two for each query term in the text; for each topic that both mention, the keywords they mention."""


    def of(x: Column) -> Column:
        score = F.size(F.filter(x["terms"], lambda w: F.contains(x["t"], w))) * 2.0
        for words in V.TOPIC_KEYWORDS.values():
            a, b = (F.size(contained(x[side], [w.lower() for w in words])) for side in ("q", "t"))
            score = score + F.when((a > 0) & (b > 0), (a + b).cast("double")).otherwise(0.0)
        return score

    return let(F.struct(normalize(query).alias("q"), normalize(text).alias("t"), query_terms(query).alias("terms")), of)


def values_to_text(values: Column) -> Column:
    """An array of strings as one text: stripped, empty ones dropped, joined by a space."""
    return F.coalesce(F.array_join(F.filter(F.transform(values, strip), lambda x: x != ""), " "), F.lit(""))


def metadata_search_text(record: dict[str, Column], weighted: bool = True) -> Column:
    """The fields named in METADATA_WEIGHTS (text or array columns by field) as lines, repeated by weight if asked."""
    lines = [F.array_repeat(record[field], weight if weighted else 1) for field, weight in V.METADATA_WEIGHTS.items() if field in record]
    return F.array_join(F.filter(F.flatten(F.array(*lines)), lambda x: x != ""), "\n")


def document_text(*parts: Column) -> Column:
    """Non-empty parts, stripped, as lines: what BM25 indexes."""
    # The pattern visits each character; most texts end in none that it would take.
    ends = lambda p: F.concat(F.substring(p, 1, 1), F.substring(p, -1, 1)).rlike(r"(?U)\s")
    return F.concat_ws("\n", *[F.when(ends(p), strip(p)).otherwise(F.nullif(p, F.lit(""))) for p in parts])


def sentences(text: Column, pattern: str = V.SENTENCE) -> Column:
    """Runs up to a terminator, stripped."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), strip)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n(?U)\s*\n"), strip), lambda p: p != "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, for which there is no built-in function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_evidence(text: Column, compose: bool = True) -> Column:
    """Lower-case letters, digits and CJK characters only; ``compose=False`` keeps plain text in the JVM."""
    return F.regexp_replace(F.lower(nfkc(text) if compose else text), f"[^0-9a-z{V.CJK}]+", "")


@F.arrow_udf(ArrayType(StringType()))
def evidence_lines(lowered: pa.Array) -> pa.Array:
    """The lines of lower-case texts, each as ``normalize_evidence`` without composition has it; many times faster than the JVM's patterns."""
    lists = pc.split_pattern(lowered, "\n")
    kept = pc.replace_substring_regex(lists.flatten(), f"[^0-9a-z{CJK}]+", "")
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), kept, mask=lists.is_null())


def evidence_units(evidence: Column) -> Column:
    """The sentences of its paragraphs; without any, the whole."""
    units = F.filter(F.flatten(F.transform(paragraphs(evidence), lambda p: sentences(p))), lambda s: s != "")
    return F.when(F.size(units) > 0, units).otherwise(F.array(evidence))


def occurrences(text: Column, needle: Column) -> Column:
    """Offsets of all occurrences, overlapping ones too."""
    at = F.when(F.length(needle) > F.length(text), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.length(text) - F.length(needle)))
    return F.when(needle == "", F.array().cast("array<int>")).otherwise(F.filter(at, lambda i: F.substring(text, i + 1, F.length(needle)) == needle))


def adjacent_overlap(left: Column, right: Column) -> Column:
    """Length of the longest end of ``left`` that begins ``right``."""
    most = F.least(F.length(left), F.length(right))
    n = F.filter(F.sequence(F.lit(0), most), lambda k: (k == 0) | (F.substring(left, F.length(left) - k + 1, k) == F.substring(right, F.lit(1), k)))
    return F.coalesce(F.array_max(n), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """In doubles; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def to_number(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))
