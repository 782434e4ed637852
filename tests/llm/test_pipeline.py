import hashlib
import random

import corpus_pipeline as cp
from tarn.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == docs.count()
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    ran = sorted((r.doc_id, r.ids_sha256) for r in cp.run(spark, SF).collect())
    assert ran == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())
    assert hashlib.sha256(b"").hexdigest() not in {h for _, h in ran}


def _through(spark, docs, sf_dir):
    for name, stage in cp.STAGES:
        columns = docs.columns
        docs = materialize(stage(spark, docs, sf_dir), f"test_{name}")
        assert name == cp.STAGES[-1][0] or docs.columns == columns
    return docs.collect()


def test_nulls_copies_and_clashing_names(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "committee", "agreed", "in", "spring"]) + rng.choice(["", "s", "ly"])
    texts = [" ".join(word() for _ in range(rng.randint(30, 60))) for _ in range(60)] + [None, "", None, "é " * 50_000]
    names = ["doc_id", "text", "lang", "source", "__row", "__score", "id", "row", "ids"]
    rows = [(i, t, None if i % 7 else "en", None if i % 5 else "web", i, 0.5, -i, str(i), "x") for i, t in enumerate(texts)]
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows[:20])]
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __row long, __score double, id long, row string, ids string")
    assert docs.columns == names
    got = _through(spark, docs, str(tmp_path))
    assert got and {r.doc_id for r in got} <= {r[0] for r in rows if r[0] >= 100 or r[0] >= 20}
    assert _through(spark, docs.limit(0), str(tmp_path)) == []


def test_memory_is_returned_after_the_last_batch_is_gone(monkeypatch):
    import weakref

    import pyarrow as pa

    from tarn.llm import near_dedup, tokens

    held, alive = [], []
    monkeypatch.setattr(tokens, "trim", lambda: alive.append(sum(x() is not None for x in held)))

    def batches():
        for block in ("x", "y"):
            batch = pa.record_batch({"block": [block], "side": [0], "node": [1], "component": [1], "bag": pa.array([bytes(12)], pa.binary())})
            held.append(weakref.ref(batch))
            yield batch

    assert len(list(tokens.returning(near_dedup._linked)(batches()))) == 2 and len(held) == 2
    assert alive[-1] == 0
