"""Substring operators against brute force."""

import random

import numpy as np
import pytest

from riskloom.llm import substring, suffixes

from .conftest import ODD

BIG = 2**63 - 1


def brute(docs, units, n):
    """Kept units of each document: units covered by an n-stretch that starts in a smaller id go."""
    first = {}
    cut = [units(t) for _, t in docs]
    for (i, _), own in zip(docs, cut):
        for k in range(len(own) - n + 1):
            key = tuple(own[k : k + n])
            first[key] = min(first.get(key, BIG), BIG if i is None else i)
    out = []
    for (i, t), own in zip(docs, cut):
        gone = set()
        for k in range(len(own) - n + 1):
            if first[tuple(own[k : k + n])] < (BIG if i is None else i):
                gone |= {*range(k, k + n)}
        out.append((i, t, gone))
    return out


def planted(rng, n, words):
    vocabulary = ["w%d" % k for k in range(words)] + ["é", "日本"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) for _ in range(8)]
    docs = []
    for i in rng.sample(range(10 * n), n):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 50))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(3), rng.choice(passages))
        docs.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    docs += [(10 * n + k, docs[k][1]) for k in range(5)] + [(docs[0][0], docs[1][1])]
    return docs


@pytest.mark.parametrize("window,words", [(13, 500), (5, 6), (4, 4), (1, 30)])
def test_words(spark, window, words):
    docs = planted(random.Random(window), 60, words) + (ODD if window == 13 else [])
    out = substring.repeats(spark.createDataFrame(docs, "doc_id long, text string"), window).collect()
    split = lambda t: (t or "").encode().split()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else BIG, r["text"] or "", r["n_words"], [p for a, b in zip(r["cut_from"], r["cut_to"]) for p in range(a, b)], r["kept"] or "") for r in out)
    expect = [(BIG if i is None else i, t or "", len(split(t)), sorted(g), b" ".join(w for k, w in enumerate(split(t)) if k not in g).decode()) for i, t, g in brute(docs, split, window)]
    assert got == sorted(expect)


def test_dedup_keeps_columns(spark, odd):
    out = substring.dedup(odd)
    assert out.columns == odd.columns
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (1, None) in got and (9, ODD[8][1]) in got and (8, ODD[7][1]) in got
    assert not any(i == 10 for i, _ in got)
    assert substring.dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize("window,words,spacing", [(50, 300, 0), (8, 3, 0), (12, 40, 1)])
def test_bytes(spark, window, words, spacing):
    docs = planted(random.Random(window), 40, words) + (ODD + [(77, "aaaa" * 200), (78, "a" * 333 + "b" + "a" * 100), (79, "abababab" * 40)] if window == 50 else [])
    out = suffixes.repeats(spark.createDataFrame(docs, "doc_id long, text string"), window).collect()
    raw = lambda t: list((t or "").encode())
    got = sorted((r["doc_id"] if r["doc_id"] is not None else BIG, r["text"] or "", r["n_bytes"], [p for a, b in zip(r["cut_from"], r["cut_to"]) for p in range(a, b)], bytes(r["kept"])) for r in out)
    expect = [(BIG if i is None else i, t or "", len(raw(t)), sorted(g), bytes(c for k, c in enumerate(raw(t)) if k not in g)) for i, t, g in brute(docs, raw, window)]
    assert got == sorted(expect)


def test_intervals_equal_brute_force_maximal_repeats():
    rng = np.random.default_rng(2)
    for _ in range(20):
        texts = sorted({bytes(rng.choice(np.frombuffer(b"ab", np.uint8), rng.integers(5, 14))) for _ in range(6)})
        size = np.array([len(t) for t in texts])
        hi = np.cumsum(size)
        least = np.arange(len(texts)) * 10
        f, s, n, d = suffixes.repeat_groups(np.frombuffer(b"".join(texts), np.uint8), hi - size, hi, least, 3)
        got = {}
        for a, b, c, e in zip(f.tolist(), s.tolist(), n.tolist(), d.tolist()):
            got.setdefault(texts[a][b : b + c], set()).add((a, b, e))
        expect = {}
        for a, t in enumerate(texts):
            for b in range(len(t)):
                for c in range(3, len(t) - b + 1):
                    expect.setdefault(t[b : b + c], []).append((a, b))
        for w, where in list(expect.items()):
            before = {texts[a][b - 1] if b else (a, "^") for a, b in where}
            after = {texts[a][b + len(w)] if b + len(w) < len(texts[a]) else (a, "$") for a, b in where}
            start = any(b == 0 for _, b in where)
            if len(where) < 2 or len(after) < 2 or not (start or len(before) > 1):
                del expect[w]
            else:
                expect[w] = {(a, b, min(least[x] for x, _ in where)) for a, b in where}
        assert got == expect


def test_bytes_of_an_empty_table(spark, odd):
    assert suffixes.repeats(odd.limit(0)).count() == 0
    out = suffixes.repeats(odd)
    assert {*odd.columns} <= {*out.columns} and out.count() == odd.count()
