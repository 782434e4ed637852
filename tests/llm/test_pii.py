import hashlib
import random
import re
import time

import numpy as np
import pytest

from tarn.llm import pii


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    for letters, n in (("ab@@..-+ 1234()  5,é😀", 60), ("0123456789 -", 40), ("+12345678(.)- ", 40), ("4 ", 40)):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
            assert pii.base_spans(t) == brute(t)
    assert pii.base_spans("x 4111 1111 1111 1111, a.b@c-d.org; 10.0.255.1 10.0.256.1 +49 (30) 1234567") == [(2, 2, 21), (23, 0, 34), (36, 1, 46), (58, 3, 74)]


@pytest.mark.parametrize("t", ["a" * 300000, "@" * 200000, "1" * 300000, "1." * 100000, "+1" + "(" * 200000, "a@" * 100000, "(1" * 100000, "1.2.3.4 x@y " * 20000])
def test_linear_time(t):
    begun = time.time()
    pii.candidates(t, pii.base_spans(t))
    assert time.time() - begun < 5


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"noise words {i} my phone is +1 555 010 {i:04d} thanks bye") for i in range(20)]
    rows += [(50 + i, f"of the {i} and the {i} of the") for i in range(20)]
    new = [(100, "noise words my phone is 555 010 4242 thanks bye"), (101, "the number 555 010 4243 of things"), (102, None), (103, ""), (104, "phone is")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + new + new[:1]], "doc_id long, text string, found int")
    by = {}
    for r in pii.find_pii(docs).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.spans for r in by[100]] == ["phone:24:36"] * 2
    assert all(r.n_phone == 0 and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in by[100])
    assert by[101][0].spans == by[102][0].spans == by[103][0].spans == by[104][0].spans == ""
    assert by[3][0].spans == "phone:26:41" and by[3][0].n_phone == 1 and len(by) == 45


def test_common_words_are_no_evidence(spark):
    rows = [(i, f"in the +1 555 010 {i:04d} of it") for i in range(20)] + [(100 + i, f"in the word{i} of it") for i in range(40)] + [(1000, "in the 555 010 4242 of it")]
    rows = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert rows[1000].spans == ""


def test_patterns_around_identifiers_of_several_words(spark):
    """One pair of words around spaced numbers, after words that vary; the same pair around other words is counted, too."""
    rows = [(i, f"lead{i} dial +1 (017) 555-{i:04d} now end{i}") for i in range(20)] + [(100, "other dial 017 555 4242 now end")]
    rows += [(200 + i, f"a{i} in +1 (018) 555-{i:04d} of b{i}") for i in range(20)] + [(300 + i, f"a{i} in word{i} and more of b{i}") for i in range(40)]
    rows += [(400, "other in 018 555 4242 of it")]
    spans = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[100] == "phone:11:23"
    assert spans[400] == ""


@pytest.mark.parametrize("n", [1, 150, 250, 500])
def test_neighbours_are_whole_chunks(n):
    """The patterns are of the same words as the second scan hashes, however long those are."""
    second, first, after = "s" * n, "f" * n, "r" * n
    text = f"{second} {first} 1.2.3.4 {after}"
    h = [np.array([pii._word_hash(w)], np.uint64) for w in (second, first, after)]
    at = text.index("1.2.3.4")
    assert pii._Chunks(text).patterns(at, at + 7) == (1, [int(pii._around(h[1], h[2])[0]), int(pii._ahead(h[0], h[1])[0])])


def test_candidates_beside_base_spans_and_of_long_runs():
    text = "x 7536784127813050 4845168114407329 y 1.2.3.4-55501742 z a@b.org@home"
    base = pii.base_spans(text)
    assert [text[a:b] for a, _, b in base] == ["1.2.3.4", "a@b.org"]
    assert [(text[a:b], k) for a, b, k in pii.candidates(text, base)] == [("7536784127813050", 4), ("4845168114407329", 4), ("55501742", 8)]
    assert pii.candidates("1" * 40, []) == [] and [(a, b) for a, b, _ in pii.candidates("12345678 " * 5, [])] == [(0, 17), (18, 35), (36, 44)]


def words_of(text):
    return [(m.start(), m.end(), m[0].strip(pii._STRIP).lower()) for m in re.finditer(r"[^ \t\n\r\f\v]+", text)]


def brute_spans(rows):
    """All spans of each text by scoring patterns of plain words, without hashes or tables."""
    texts = [t or "" for t in rows]
    words = [words_of(t) for t in texts]
    word = lambda d, i: words[d][i][2] if 0 <= i < len(words[d]) else ""
    mentions = []
    for d, t in enumerate(texts):
        base = pii.base_spans(t)
        for a, b, bits, seed in [(a, b, 1 << k, True) for a, k, b in base] + [(*c, False) for c in pii.candidates(t, base)]:
            i = sum(e <= a for _, e, _ in words[d])
            j = sum(s < b for s, _, _ in words[d])
            for kind in range(4):
                if bits >> kind & 1:
                    mentions.append((d, a, b, kind, t[a:b].lower(), j - i, seed, [("around", word(d, i - 1), word(d, j)), ("ahead", word(d, i - 2), word(d, i - 1))]))
    values, positives = {}, {}
    for _, _, _, kind, value, _, seed, patterns in mentions:
        for p in patterns if seed else ():
            values.setdefault((kind, p), set()).add(value)
            positives[kind, p] = positives.get((kind, p), 0) + 1
    induced = {x for x, v in values.items() if len(v) >= pii.MIN_SEEDS}
    lengths = {1} | {n for _, _, _, kind, _, n, _, patterns in mentions if any((kind, p) in induced for p in patterns)}
    total = {}
    for d, own in enumerate(words):
        for i in range(len(own)):
            for p in [("around", word(d, i - 1), word(d, i + n)) for n in lengths if i + n <= len(own)] + [("ahead", word(d, i - 2), word(d, i - 1))]:
                total[p] = total.get(p, 0) + 1
    edges = {}
    for _, _, _, kind, value, _, seed, patterns in mentions:
        for p in patterns if not seed else ():
            if (kind, p) in induced:
                edges[kind, p, value] = edges.get((kind, p, value), 0) + 1
    score, confidence = {}, {}
    for _ in range(pii.ROUNDS):
        for kind, p in induced:
            gained = sum(n * score.get((kind, v), 0.0) for (k, q, v), n in edges.items() if (k, q) == (kind, p))
            confidence[kind, p] = min(0.999, (positives[kind, p] + gained) / max(total.get(p, 0), positives[kind, p]))
        missed = {}
        for kind, p, v in edges:
            missed[kind, v] = missed.get((kind, v), 1.0) * (1 - confidence[kind, p])
        score = {x: 1 - m for x, m in missed.items()}
    out = [[(a, k, b) for a, k, b in pii.base_spans(t)] for t in texts]
    best = {}
    for d, a, b, kind, _, _, seed, patterns in mentions:
        for p in patterns if not seed else ():
            if confidence.get((kind, p), 0) >= pii.MIN_CONFIDENCE:
                best[d, a, b] = max(best.get((d, a, b), (0, -9)), (confidence[kind, p], -kind))
    for (d, a, b), (_, kind) in best.items():
        out[d].append((a, -kind, b))
    return [pii.written(sorted(x)) for x in out]


def planted(seed=6, n=240):
    """Texts with identifiers in a few wordings, a third of them in forms that only their wording gives away, and decoys."""
    rng = random.Random(seed)
    noise = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    texts, hidden, decoys = [], set(), set()
    for d in range(n):
        kind, seen = rng.choice(["phone", "email", "ip"]), rng.random() < 2 / 3
        if kind == "phone":
            value, lead, tail = ("+1 " if seen else "") + f"{rng.randint(200, 999)} {digits(3)} {digits(4)}", "reach me: ", " (mobile)"
        elif kind == "email":
            value, lead, tail = f"n{digits(4)}@host{digits(2)}" + (".org" if seen else ""), "write\u00a0to the address ", ", please"
        else:
            value, lead, tail = ".".join(str(rng.randint(1, 255)) for _ in range(3)) + (f".{rng.randint(1, 255)}" if seen else ".777"), "login from ", " ok"
        text = f"{noise(3)} {lead}{value}{tail} {noise(rng.choice([1, 1, 200]))}"
        at = text.index(value)
        if not seen:
            hidden.add((d, f"{kind}:{at}:{at + len(value)}"))
        if rng.random() < 0.4:
            text += f" {noise(1)} {digits(9)} {noise(1)}"
            decoys.add(d)
        texts.append(text + (f" reach me: +1 {digits(3)} {digits(3)} {digits(4)} (mobile)" * 2 if d % 50 == 0 else ""))
    return [*texts, "", None, "w" * 3000 + " 5550100 " + "v" * 3000], hidden


def test_against_brute_force_and_planted_identifiers(spark):
    texts, hidden = planted()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert [rows[i].spans for i in range(len(texts))] == brute_spans(texts)
    added = {(i, f"{pii.KINDS[s.kind]}:{s.start}:{s.end}") for i, r in rows.items() for s in r.found}
    assert len(added & hidden) >= 0.9 * len(hidden) > 50
    assert len(added & hidden) >= 0.95 * len(added)


@pytest.mark.parametrize("gap,n", [(" ", 450), ("\u00a0", 5)])
def test_long_words_and_other_spaces_in_contexts(spark, gap, n):
    lead, tail = "l" * n + gap + "m", "r" * n
    rows = [(i, f"x{i} {lead} +1 555 010 {i:04d} {tail} y{i}") for i in range(20)] + [(100, f"z {lead} 555 010 4242 {tail} z")]
    spans = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[-1][1].index("555")
    assert spans[100] == f"phone:{at}:{at + 12}"


def test_empty(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
