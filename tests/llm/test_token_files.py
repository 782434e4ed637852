import importlib
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarn.llm import bpe, ranges
from tarn.llm import token_files as tf

PATH = importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_code_round_trip(ranks):
    control, data = tf.pack(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert len(data) == sum(max(1, (r.bit_length() + 7) // 8) for r in ranks)
    assert tf.unpack(control, data, len(ranks)).tolist() == ranks


@pytest.mark.parametrize("shard_docs", [4096, 5])
def test_files(spark, tmp_path, shard_docs):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 101, f"Some words {i}, the the <|endoftext|> \x01 a\x01b") for i in range(101)] + [(500, None), (501, ""), (502, "x " * 20_000), (None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, raw int")
    out = str(tmp_path / "ids")
    tf.write_ids(docs, PATH, out, shard_docs=shard_docs)
    encoded = [(-1 if i is None else i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    encoded.sort(key=lambda r: (r[0], np.array(r[1], "<u2").tobytes()))
    want, at = [], 0
    for i, ids in encoded:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in tf.read_checksums(spark, out).collect())
    assert got == sorted(want)
    back = {r.start: r.ids for r in tf.read_ids(spark, out).collect()}
    at = 0
    for _, ids in encoded:
        assert back[at] == ids
        at += len(ids)
    ranks = {r["id"]: r["rank"] for r in spark.read.parquet(f"{out}/ranks").collect()}
    counts = np.bincount([i for _, ids in encoded for i in ids])
    assert [i for i, _ in sorted(ranks.items(), key=lambda x: x[1])] == sorted(ranks, key=lambda i: (-counts[i], i))


def test_empty(spark, tmp_path):
    out = str(tmp_path / "ids")
    tf.write_ids(spark.createDataFrame([], "doc_id long, text string"), PATH, out)
    assert tf.read_checksums(spark, out).count() == 0


def test_files_whose_words_cross_white_space_are_refused(spark, tmp_path):
    path = importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        tf.write_ids(docs, path, str(tmp_path / "ids"))
    with pytest.raises(ValueError):
        bpe.digests(docs, path)


def test_borders_are_even_and_of_the_table(spark):
    ids = spark.range(0, 40_000).selectExpr("CASE WHEN id < 20000 THEN id ELSE id * 1000 END AS doc_id")
    at, largest = ranges.borders(ids, "doc_id", 500)
    assert largest == 39_999_000 and len(set(at.tolist())) == len(at) and 60 <= len(at) <= 100
    place = np.searchsorted(at, [r.doc_id for r in ids.collect()])
    assert np.bincount(place).max() <= 2000
