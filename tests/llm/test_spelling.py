"""Spelling variants against plain Python on small corpora."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchbook.llm import spelling

SCHEMA = "doc_id bigint, text string"


def plain_words(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    words = plain_words(rows)
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, form[w], words.get(form[w]), len(near[w]), root))
    return out


def answer(spark, rows, **kw):
    got = spelling.spelling_variants(
        spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS word", "2 AS n", "3 AS KEY"), **kw)
    rows = [tuple(r) for r in got.select("word", "n", "form", "form_n", "n_near", "root").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, letters="abcéÿ", n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = stems[min(int(rng.expovariate(0.2)), len(stems) - 1)]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(letters + "Z") * rng.randint(0, 2) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "\n", "—", "漢", "3"]).join(words)))
    return rows


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_random_corpora(spark, symbols):
    rows = corpus(symbols)
    got = answer(spark, rows, symbols=symbols)
    assert got == brute(rows) and any(r[2] for r in got) and any(r[4] > 3 for r in got)


def test_chains_lead_to_the_last_form(spark):
    chain = [("abcdef", 6), ("abcdeg", 40), ("abcdhg", 260), ("abcihg", 1600), ("xyzxyz", 6)]
    rows = [(2 * i, w + " ") for i, w in enumerate(w for w, n in chain for _ in range(n))]
    got = answer(spark, rows)
    assert got == brute(rows)
    assert {r[0]: r[5] for r in got}["abcdef"] == "abcihg"


def test_no_table_of_the_vocabulary_is_broadcast(spark):
    rows = spark.createDataFrame(corpus(3), SCHEMA)
    vocab = spelling.materialize(spelling.vocabulary(rows), "vocabulary")
    forms = spark.createDataFrame([("abcdef", "abcde"), ("abcde", "abcd")], "word string, form string")
    for frame in (spelling.near_words(vocab), spelling.spelling_variants(rows), spelling.follow_forms(forms)):
        assert frame.count() > 0
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 64)                  # texts are cut between words
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = [(None, "Wörter wörter WÖRTER worter×worter÷ Àéîõü"), (1, None), (2, ""), (3, " \t"),
            (4, "repeated words " * 50), (4, "repeated words " * 50), (5, "a" * 5000 + " " + "é" * 300),
            (6, "naïveté naïvete naivete " * 9), (7, "İstanbul ŁódźŁ Ångström " * 7)]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, []) == set()


def test_neighbourhood_is_complete():
    """Keys of the neighbourhood are exactly the keys of all strings one edit away."""
    word = np.array([[1, 2, 2, 3, 1]], np.uint64)
    got = set(spelling.neighbour_keys(word, 3)[0].tolist())
    w, want = word[0].tolist(), set()
    for i in range(len(w)):
        want.add(tuple(w[:i] + w[i + 1:]))
        want |= {tuple(w[:i] + [s] + w[i + 1:]) for s in (1, 2, 3)}
    for i in range(len(w) + 1):
        want |= {tuple(w[:i] + [s] + w[i:]) for s in (1, 2, 3)}
    key = lambda t: int(spelling.reduced_keys(np.array([t], np.uint64))[0])
    assert got == {key(t) for t in want}
