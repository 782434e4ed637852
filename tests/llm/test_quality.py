import math
import zlib

import pytest
import zstandard

from tarn.llm import quality as q


def corpus():
    good = [(i, f"The committee of {i} met and agreed that report {i * 7} should be sent to the members in spring.") for i in range(0, 300)]
    bad = [(i, f"WIN!!! $$$ cl1ck ### {i} n0w !!! fr33 $$$ ### {i * 3} !!! bonus $$$") for i in range(300, 500)]
    return good, bad


def test_held_out_accuracy(spark):
    good, bad = corpus()
    docs = spark.createDataFrame([*good, *bad, (999, None), (998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(1, 0), (None, 1)], "doc_id long, quality int")
    model = q.fit(docs, labels)
    rows = q.classify(docs, model).collect()
    truth = {i: 1 for i, _ in good} | {i: 0 for i, _ in bad}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and sum((r["__score"] >= 0.5) == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["__score"] <= 1 for r in rows) and len(rows) == 502
    by = {r.doc_id: r["__score"] for r in rows}
    assert by[999] == by[998]


def test_scores_equal_their_definition(spark):
    """Sizes of all windows under both dictionaries, plainly compressed, through the curve; also of a very long text and repeated rows."""
    good, bad = corpus()
    more = [(900, "long text of many words, " * 100_000), (901, "é" * 5000), (902, "same"), (902, "same")]
    docs = spark.createDataFrame([*good, *bad, *more], "doc_id long, text string")
    model = q.fit(docs, spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int"))
    texts = dict([*good, *bad, *more])
    for r in q.classify(docs, model, score_col="score").collect():
        raw, size = texts[r.doc_id].encode(), {}
        for name in ("bad", "good"):
            made = zstandard.ZstdCompressionDict(getattr(model, name))
            size[name] = 0
            for at in range(0, len(raw), 1024):
                frame = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[at : at + 1024])
                size[name] += len(frame)
        x = model.weights[0] + model.weights[1] * (size["bad"] - size["good"]) / len(raw)
        assert r.score == pytest.approx(1 / (1 + math.exp(-x)))


def test_what_the_driver_gets_is_bounded(spark, monkeypatch):
    good, bad = corpus()
    windows = []
    monkeypatch.setattr(q, "_dictionary", lambda w: windows.append(w) or b"".join(w)[:4096])
    docs = spark.createDataFrame([(i, t * 2000) for i, t in good + bad], "doc_id long, text string")
    q.fit(docs, spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int"))
    assert len(windows) == 2 and all(len(w) <= q.DICTIONARY_ROWS * q.TEXT_WINDOWS and max(map(len, w)) <= q.WINDOW for w in windows)


def test_a_taken_name_is_refused(spark):
    with pytest.raises(ValueError):
        q.classify(spark.createDataFrame([(1, "a", 0.5)], ["doc_id", "text", "__SCORE"]), q.QualityModel(b"", b"", (0.0, 0.0)))


def test_held_out_rows_train_nothing(spark):
    good, bad = corpus()
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string")
    labels = [(i, int(i < 300)) for i in range(500)]
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, x in labels]
    a, b = (q.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(0, 1), (2, 1)], 1.0)])
def test_missing_labels(spark, labels, score):
    docs = spark.createDataFrame([(0, "a", "x"), (2, None, "y")], "doc_id long, text string, score string")
    model = q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = q.classify(docs, model).collect()
    assert [r["__score"] for r in rows] == pytest.approx([score] * 2, abs=1e-6)
    assert q.classify(docs.limit(0), model).count() == 0
