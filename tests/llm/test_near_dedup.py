import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarn.llm import common
from tarn.llm import near_dedup as nd
from tarn.llm.components import components


def bag(t):
    w = (t or "").split()
    return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()


def like(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a or b else 1.0


def brute(rows):
    """Class of each row: the smallest id that links reach."""
    bags = [bag(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if like(bags[i], bags[j]) >= 0.8:
                part[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((str(d), str(min((x for x in groups[find(i)] if x is not None), default=None)), len(groups[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed=1, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 9)):
            edited = list(base)
            for _ in range(rng.randint(0, 8)):
                edited[rng.randrange(len(edited))] = word()
            rows.append((len(rows), " ".join(edited)))
    rows += [(900 + i, "shared passage of several words here " * 3 + " ".join(word() for _ in range(60))) for i in range(8)]
    rows += [(950 + i, "over and over again " * (40 + i)) for i in range(6)]
    rows += [(970, None), (971, ""), (972, " \n"), (973, "a b"), (974, "a b"), (975, "a b c"), (5, rows[5][1]), (5, rows[5][1]), (None, "null id text"), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, node int, band string")
    got = nd.near_groups(docs).collect()
    assert sorted((str(r.id), str(r.class_id), r.class_size) for r in got) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({(r.class_id, r.class_size) for r in got if r.class_id is not None}) + sum(r.class_id is None for r in kept)
    assert all(r.id == r.class_id for r in kept)
    survivors = nd.near_dedup(docs)
    assert survivors.columns == docs.columns and survivors.count() == len(kept)


def test_frequent_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(nd, "LEADER_BLOCK", 2)
    monkeypatch.setattr(nd, "BLOCK", 8)
    rows = corpus(4, 5) + [(2000 + i, "the same copy of all") for i in range(20)]
    got = nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.id), str(r.class_id), r.class_size) for r in got) == brute(rows)


def test_rows_that_move_and_names_that_clash(spark):
    """An input that is dealt anew by each scan gives whole rows; a very long text is one node."""
    names = ["doc_id", "text", "__row", "row", "class.id"]
    rows = [(i, t, i, -i, str(i)) for i, (_, t) in enumerate(corpus(3, 20))] + [(5000, "long text " * 200_000, 0, 0, "")]
    want = sorted({int(c) for _, c, _ in brute([(r[0], r[1]) for r in rows])})
    for docs in (spark.createDataFrame(rows, names), spark.createDataFrame(rows, names).repartition(7)):
        kept = nd.near_dedup(docs)
        assert kept.columns == names and sorted(r.doc_id for r in kept.collect()) == want
        assert all(tuple(r) == rows[r.doc_id if r.doc_id < 5000 else -1] for r in kept.collect())


def test_signatures_are_unbiased():
    """Agreement over many seeds equals the weighted index."""
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.ones(300, np.int64), np.ones(300, np.int64)
        a[:40], b[:40] = 9, 5
        a[40:60], b[40:60] = 1, 3
        keep = np.arange(300) < 250
        owner = np.concatenate([np.zeros(300, np.int64), np.ones(250, np.int64)])
        sign = nd.signatures(owner, np.concatenate([base, base[keep]]), np.concatenate([a, b[keep]]), 2)
        pairs.append((sign[0] == sign[1]).mean())
    b[250:] = 0
    assert np.mean(pairs) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.02)


def test_bags_equal_counters():
    texts = ["a b c d e f a b c d e", "", "x y", "w " * 30, "a  b\tc\nd e"]
    bags = nd.Bags(pa.array(texts), nd._cache())
    each = bags.of_each()
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert nd.likeness(each[i], each[j]) == pytest.approx(like(bag(s), bag(t)))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, x) for x in range(2001, 2100)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {}

    def find(i):
        part.setdefault(i, i)
        while part[i] != i:
            i = part[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in list(part)}


def test_empty(spark):
    assert nd.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block,pairs", [(512, 60), (16, 60), (512, 290)])
def test_links_of_fresh_blocks_are_verified(spark, monkeypatch, block, pairs):
    """A single true partner for each node, in families of many blocks whose other nodes are nearly as alike."""
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for _ in range(pairs):
        half = list(base)
        for at in rng.sample(range(0, 200, 5), 5):
            half[at] = f"x{rng.random()}"
        twin = list(half)
        twin[rng.randrange(200)] = f"y{rng.random()}"
        rows += [(len(rows), " ".join(half)), (len(rows) + 1, " ".join(twin))]
    rng.shuffle(rows)
    got = nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.id), str(r.class_id), r.class_size) for r in got) == brute(rows)
