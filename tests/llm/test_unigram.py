import importlib
import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tarn.llm import unigram as u

PATH = importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def library(pieces, byte_fallback=True):
    t = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_ties(byte_fallback):
    rng = random.Random(2)
    pieces = [("<unk>", 0.0)] + [(p, float(-rng.randint(1, 4))) for p in ("▁", "a", "b", "ab", "ba", "aab", "bb", "abab", "▁a", "▁ab", "c")]
    t, own = library(pieces, byte_fallback), u.CountViterbi(pieces, byte_fallback)
    for _ in range(5000):
        word = "".join(rng.choice("ababcxé") for _ in range(rng.randint(1, 14)))
        assert own.count("▁" + word) == len(t.encode(word, add_special_tokens=False).ids)


def test_operator_equals_the_library(spark):
    rng = random.Random(3)
    texts = ["", " ", "  ", " a", "a ", "a  b", "▁", "▁a", "a▁b", "\n", "a\n b", "😀x😀😀 y", "<s> </s>", "<0x41>", "The quick brown fox", "x" * 3000, None]
    texts += ["".join(rng.choice("ab  etho▁\né😀ξ中") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    t = library(u.pieces_of(PATH))
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.id: (r.n_tokens, r.n_chars) for r in u.token_counts(docs, PATH).collect()}
    assert got == {i: (len(t.encode(x or "", add_special_tokens=False).ids), len(x or "")) for i, x in enumerate(texts)}
    assert u.token_counts(docs.limit(0), PATH).count() == 0


def test_repeated_rows_and_a_very_long_text(spark):
    long = "The quick brown fox  " * 50_000 + "x" * 20_000
    rows = [(1, "same text"), (1, "same text"), (2, long), (None, "same text")]
    t = library(u.pieces_of(PATH))
    got = sorted((r.id or 0, r.n_tokens, r.n_chars) for r in u.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    assert got == sorted((i or 0, n(x), len(x)) for i, x in rows)
