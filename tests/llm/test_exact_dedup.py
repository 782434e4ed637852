import hashlib

from tarn.llm import common
from tarn.llm import exact_dedup as ed

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 9000), (6, "b" * 9000), (7, "b" * 8999 + "c"), (7, "x"), (7, "x"), (None, "x"), (None, "y"), (8, "😀é\n"), (9, "😀é\n")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows)


def got(df):
    return sorted((r.id is None, r.id or 0, r.text_sha256, r.keep_id, r.group_size) for r in df.collect())


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, "p", 1) for r in ROWS], "doc_id long, text string, block string, row int")
    for block in (1, 3, 4096):
        rows = ROWS if block > 1 else [(i, (t or "")[:40]) for i, t in ROWS]
        docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, block string, row int")
        groups = ed.exact_groups(docs, block_chars=block)
        assert got(groups) == brute(rows)
        kept = groups.filter("kept").collect()
        assert len(kept) == len({t or "" for _, t in rows})
        assert all(r.id == r.keep_id for r in kept)


def test_keeps_columns_and_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(*r, "p", 1) for r in ROWS], "doc_id long, text string, block string, row int")
    kept = ed.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t in ROWS})


def test_hot_block_is_salted(spark, monkeypatch):
    monkeypatch.setattr(ed, "HOT_ROWS", 4)
    rows = [(i, "same text") for i in range(50)] + [(100 + i, f"own {i}") for i in range(20)] + [(200 + i, "other") for i in range(5)]
    assert got(ed.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_frequent_pairs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(i, "same text of blocks") for i in range(40)] + [(100 + i, f"same text of own {i % 7}") for i in range(20)]
    assert got(ed.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_chars=2)) == brute(rows)


def test_names_that_clash_and_rows_that_move(spark):
    """Columns named as the operator's own are kept; an input that is dealt anew by each scan gives whole rows."""
    names = ["doc_id", "text", "__row", "row", "keep.id", "level"]
    rows = [(i, f"text {i % 50}", i, -i, f"k{i}", i) for i in range(600)]
    docs = spark.createDataFrame(rows, names)
    for moved in (docs, docs.repartition(4)):
        kept = ed.exact_dedup(moved)
        assert kept.columns == names and sorted(map(tuple, kept.collect())) == sorted(rows[550:])


def test_empty_table(spark):
    assert ed.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
