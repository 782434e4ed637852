import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing as m


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water filling by rounds over {source: size}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def corpus(n=900):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a"] * 6 + ["b", "c", "é", "Z", None])) for i in range(n)]
    return [*rows, (-1, None, "a"), (-2, "x\x0by z \t", "b"), (5, "again", "a"), (5, "again", "a"), (None, "no id", "c")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, source string, size int, copies string")


def test_targets_and_taken(spark):
    rows = corpus()
    got = m.mixture(frame(spark, rows), shard_words=500).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    by = {(r.id, r["size"], r.source_size): r for r in got}
    for i, t, s in rows:
        r = by[i, size(t), sizes[s]]
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r["size"] and r.taken == r["size"] * len(r.copies)
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 60


def test_reruns_agree_and_shards_split_quotas(spark):
    rows = corpus()
    a = sorted(map(str, m.mixture(frame(spark, rows), shard_words=500).collect()))
    b = sorted(map(str, m.mixture(frame(spark, rows[::-1]).repartition(5), shard_words=500).collect()))
    assert a == b
    quotas = spark.range(1).select(quotas_of(100, 0, 40, 7))
    shards = m.shard_quotas(quotas, 3).collect()
    total = {}
    for r in shards:
        total[r["rank"]] = total.get(r["rank"], 0) + r.quota
    assert total == {0: 100, 2: 40, 3: 7}
    by_shard = {}
    for r in shards:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.quota
    assert len(by_shard) == 8 and max(by_shard.values()) - min(by_shard.values()) <= 1


def quotas_of(*numbers):
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).cast("long").alias("q")) for i, x in enumerate(numbers)]).alias("quotas")


@pytest.mark.parametrize("few", [512, 0])
@pytest.mark.parametrize("q", [(30, 10), (10, 30), (400, 400, 2)])
def test_split_is_hypergeometric(spark, monkeypatch, few, q):
    """How often each number goes left, over many nodes, for draws one by one and for inversion."""
    monkeypatch.setattr(m, "FEW_DRAWS", few)
    nodes = spark.range(4000).select(F.col("id").alias("node"), quotas_of(*q))
    sides = m._split(nodes).collect()
    for i in range(len(q)):
        left = [next((e.q for e in r.quotas if e.i == i), 0) for r in sides if r.node % 2 == 0]
        n, places = sum(q), sum(q) // 2
        law = [math.comb(q[i], x) * math.comb(n - q[i], places - x) / math.comb(n, places) if places >= x else 0.0 for x in range(q[i] + 1)]
        mean = sum(x * p for x, p in enumerate(law))
        sd = math.sqrt(sum((x - mean) ** 2 * p for x, p in enumerate(law)))
        assert sum(left) / len(left) == pytest.approx(mean, abs=4 * sd / math.sqrt(len(left)))
        assert sum((x - mean) ** 2 for x in left) / len(left) == pytest.approx(sd**2, rel=0.12)
        top = max(range(q[i] + 1), key=law.__getitem__)
        assert left.count(top) / len(left) == pytest.approx(law[top], abs=4 * math.sqrt(law[top] / len(left)))
    assert all(sum(e.q for e in r.quotas) == (sum(q) // 2 if r.node % 2 == 0 else sum(q) - sum(q) // 2) for r in sides)


def test_large_quotas_are_split_whole(spark):
    quotas = spark.range(1).select(quotas_of(30_000_000, 5, 9_000_000_000, 1))
    total, by_shard = {}, {}
    for r in m.shard_quotas(quotas, 4).collect():
        assert r.quota > 0
        total[r["rank"]] = total.get(r["rank"], 0) + r.quota
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.quota
        if r["rank"] in (0, 2):
            share = (30_000_000 if r["rank"] == 0 else 9_000_000_000) / 16
            assert abs(r.quota - share) < 6 * math.sqrt(share)
    assert total == {0: 30_000_000, 1: 5, 2: 9_000_000_000, 3: 1} and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_very_long_text_and_clashing_names(spark):
    rows = [(i, "w " * 50, "a", 1, "c", "z") for i in range(300)] + [(999, "w " * 300_000, "b", 1, "c", "z")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "__row", "__place", "copies.shard"])
    got = {r.id: r for r in m.mixture(docs).collect()}
    assert got[999]["size"] == 300_000 and got[999].taken <= 3 * 300_000
    assert m.mix(docs).columns == docs.columns


def test_mix_repeats_rows(spark):
    rows = corpus()
    docs = frame(spark, rows)
    taken = {}
    for r in m.mixture(docs, shard_words=500).collect():
        taken[r.id] = taken.get(r.id, 0) + len(r.copies)
    mixed = m.mix(docs, shard_words=500)
    assert mixed.columns == docs.columns
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: n for i, n in taken.items() if n}


def test_empty(spark):
    assert m.mixture(frame(spark, []).limit(0)).count() == 0
    assert m.mix(frame(spark, []).limit(0)).count() == 0
    assert [r.taken for r in m.mixture(frame(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]
