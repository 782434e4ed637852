import hashlib
import importlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tarn.llm import bpe

PATH = importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    letters = "aabbccdeeehhinnoorsttt'1é²$!ß "
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    out += ["a" * n for n in range(1, 200, 7)] + ["ha" * n for n in range(1, 60, 5)] + ["!" * n for n in range(1, 90, 7)]
    out += ["ΑΣ İ ǅ ﬁ á é́ ẛ̣ \x1c\x1d a\x1cb ᠎a ​z 你好世界 हिन्दी 😀😀 <|endoftext|>x<|startoftext|>Y < |endoftext|> don't I'LL it's 'sing ''s ½ Ⅷ x²", "", " ", "IT'S 'RE"]
    spans = ((0, 0x3000), (0, 255), (0x10000, 0x1FFFF))
    return out + ["".join(chr(rng.randint(*rng.choice(spans))) for _ in range(50)) for _ in range(300)]


def test_words_equal_the_library(library):
    own = bpe.WordBpe(PATH)
    for text in texts():
        ids = [i for c in own.encode_chunks(text.split(" ")) for i in c]
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike():
    own = bpe.WordBpe(PATH)
    word = "".join(random.Random(2).choice("abehn") for _ in range(60))
    assert own._merge(own._symbols(word)) == own._merge_long(own._symbols(word))


def test_compatible_is_exact():
    own = bpe.WordBpe(PATH)
    rng = random.Random(3)
    inner = rng.sample(sorted(own.inner.values()), 300)
    a, b = np.array([rng.choice(inner) for _ in range(3000)]), np.array([rng.choice(inner) for _ in range(3000)])
    got = own.compatible(a, b)
    for x, y, ok in zip(a, b, got, strict=True):
        symbols = [own.vocab[c] for c in own.tokens[x] + own.tokens[y]]
        assert (own._merge(symbols) == [x, y]) == ok


def test_operator(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:200])] + [(7, None, "y"), (7, None, "y"), (None, "a " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.id is None, r.id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, PATH).collect()))
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    back = bpe.decode(bpe.encode(docs.limit(20), PATH), PATH).collect()
    assert all(hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in back)
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_cache_forgets():
    from tarn.llm.tokens import ChunkCache, Chunked, spaced
    import pyarrow as pa

    cache = ChunkCache(lambda new: [len(c) for c in new], pa.int64(), most=50)
    for k in range(20):
        rows = [" ".join(f"w{k * 10 + j}" for j in range(10)) + " same", "", " x  yy "]
        assert Chunked(spaced(pa.array(rows)), cache).summed().tolist() == [sum(map(len, r.split())) for r in rows]
        assert len(cache.known) <= 70


def test_kept_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (None, None, 8, "y")], "doc_id long, text string, id long, n_tokens string")
    got = bpe.encode(docs, PATH, keep=("id", "n_tokens"))
    assert got.columns == ["id", "id_", "n_tokens_", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert sorted((r.id_, r.n_tokens_, r.n_tokens) for r in got.collect()) == [(7, "x", 2), (8, "y", 0)]


def test_new_chunks_are_encoded_some_at_a_time(monkeypatch):
    import pyarrow as pa

    from tarn.llm import tokens

    sizes = []
    monkeypatch.setattr(tokens, "NEW_AT_ONCE", 10)
    cache = tokens.ChunkCache(lambda new: (sizes.append(len(new)), [(x.encode(), x.encode() * 2) for x in new])[1], pa.large_binary(), pa.large_binary(), most=60)
    for first in (0, 30, 35, 90):
        names = [f"w{i}" for i in range(first, first + 45)]
        at = pa.array(cache.places(pa.array(names)))
        assert [x.decode() for x in cache.values[0].take(at).to_pylist()] == names and cache.values[1].take(at).to_pylist() == [x.encode() * 2 for x in names]
    assert max(sizes) == 10


def test_lean_worker_returns_freed_arrays():
    import subprocess
    import sys

    code = """
import re
from tarn.llm import tokens
import pyarrow as pa
tokens.lean()
def held():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1000
before = held()
arrays = [pa.concat_arrays([pa.array(range(250_000), pa.int64())] * 2) for _ in range(40)]
full = held()
del arrays[1::2]
print(full - before > 120, full - held() > 60)
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split() == ["True", "True"]
