import hashlib
import random

import pytest

from tarn.llm import fingerprint as f
from tarn.llm import ranges

ROWS = [(i * 3, f"para one of {i}\nsecond line {i % 4}\n" + "word " * (i % 9)) for i in range(60)] + [(5, None), (6, ""), (7, "é😀"), (12, "tie b"), (12, "tie a"), (12, "tie a"), (None, "no id")]


def order(rows):
    with_id = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], [-ord(c) for c in (r[1] or "")] + [1]))
    return with_id + [r for r in rows if r[0] is None]


@pytest.mark.parametrize("size", [4096, 10, 2])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(f, "borders", lambda df, c: ranges.borders(df, c, size))
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, copy int")
    rows = order(ROWS)
    want = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t)
        new = t[: n - n // 3] + nxt[: n // 3]
        a, b, c = map(f.Fingerprint.of, (t, new, nxt))
        want.append((str(i), n, hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), a.likeness(b), a.likeness(c)))
    got = [(str(r.doc_id), *r[1:]) for r in f.edited_fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)


def naive(text):
    """The fingerprint by its definition, one run of characters at a time."""
    exact, lanes = [0] * f.EXACT, [0] * f.LANES
    k = 0x9E3779B97F4A7C15
    for p in text.split("\n"):
        d = hashlib.blake2b(p.encode(), digest_size=8 * f.EXACT).digest()
        for i in range(f.EXACT):
            exact[i] = (exact[i] + int.from_bytes(d[8 * i : 8 * i + 8], "little")) % 2**64
    padded = "\n" * (f.WINDOW - 1) + ("\n" * (f.WINDOW - 1)).join(text.split("\n")) + "\n" * (f.WINDOW - 1)
    for at in range(len(padded) - f.WINDOW + 1):
        c = [ord(x) for x in padded[at : at + f.WINDOW]]
        two = lambda i: c[i] * k + c[i + 1]
        four = lambda i: two(i) * k**2 + two(i + 2)
        h = ((four(0) * k**4 + four(4)) * k**4 + four(8)) % 2**64
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
        lanes[(h >> 56) % f.LANES] += 1 if h >> 56 < f.LANES else -1
    return b"".join(x.to_bytes(8, "little") for x in exact).hex() + b"".join((x % 2**32).to_bytes(4, "little") for x in lanes).hex()


def test_equals_its_definition():
    for text in ("", "a", "é😀 one\ntwo\n\n", "line of words\n" * 40, "".join(chr(97 + i * i % 23) for i in range(500))):
        assert f.Fingerprint.of(text).hex() == naive(text)


@pytest.mark.parametrize("unit", ["a", "a line that is repeated\n"])
def test_lanes_of_long_repeats_do_not_wrap(unit):
    n = 100_000
    assert f.Fingerprint.of(unit * n).likeness(f.Fingerprint.of(unit * (n * 4 // 3))) > 0.999
    assert f.Fingerprint.of(unit * n).likeness(f.Fingerprint.of("quite another text " * n)) < 0.5


def test_homomorphic():
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 50))) for _ in range(8)]
    whole = f.Fingerprint.of("\n".join(parts))
    shuffled = parts[::-1]
    assert f.Fingerprint.of("\n".join(shuffled)).hex() == whole.hex()
    total = f.Fingerprint.of(parts[0])
    for p in parts[1:]:
        total = total + f.Fingerprint.of(p)
    assert total.hex() == whole.hex()
    assert (whole - f.Fingerprint.of(parts[3])).hex() == f.Fingerprint.of("\n".join(parts[:3] + parts[4:])).hex()
    assert f.Fingerprint.from_hex(whole.hex()).likeness(whole) == 1.0
    assert f.Fingerprint.of("a\na").hex() != f.Fingerprint.of("a").hex() != f.Fingerprint.of("b").hex()


def test_likeness_follows_overlap():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(900)]
    a, b, c = " ".join(words[:300]), " ".join(words[:200] + words[300:400]), " ".join(words[500:800])
    x, y, z = map(f.Fingerprint.of, (a, b, c))
    assert x.likeness(y) == pytest.approx(2 / 3, abs=0.15) and x.likeness(z) < 0.3


def test_small_tables(spark):
    assert f.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = f.edited_fingerprints(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abcdab").hexdigest()]
    assert f.fingerprints(spark.createDataFrame([(3, None)], "doc_id long, text string")).first().fingerprint == f.Fingerprint.of("").hex()


def test_very_long_text_and_repeated_rows(spark):
    long = "a line of the text\n" * 60_000
    rows = [(9, long), (5, "short"), (5, "short"), (1, long)]
    got = f.edited_fingerprints(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[9][0].fingerprint == by[1][0].fingerprint == f.Fingerprint.of(long).hex() and by[9][0].n_chars == len(long)
    assert sorted(r.near_next for r in by[5])[-1] == 1.0 and by[1][0].near_next == 1.0 and by[1][0].near_edited > 0.99
