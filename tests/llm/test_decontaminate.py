"""Suffix automaton against brute force."""

import random
import re

from riskloom.llm import decontaminate as d


def brute(text, items, window):
    ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes((text or "").encode()).lower())
    hit, found = set(), set()
    for i, t in items:
        own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == own[k : k + n]:
                    hit |= {*range(p, p + n)}
                    found.add(i)
    return len(ws), hit, found


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "c", "Dé", "7x"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9])))) for k in range(14)] + [(90, None), (91, "a b c a b"), (92, "a b c a b")]
    docs = [(k, "-".join(word() for _ in range(rng.randrange(40)))) for k in range(60)] + [(70, None), (71, ""), (72, "zz " * 30), (70, "a,b.c a!b")]
    for window, few in ((4, items), (3, items[:6]), (5, [x for x in items if len((x[1] or "").split()) >= 4])):
        for block in (2_000_000, 6):
            out = d.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(few, "item_id long, text string"), window, block).collect()
            got = {}
            for r in out:
                n, hit, found = got.setdefault((r["doc_id"], r["text"]), [r["n_words"], set(), set()])
                hit |= {p for a, b in zip(r["hit_from"], r["hit_to"]) for p in range(a, b)}
                found |= {*r["item_ids"]}
            for i, t in docs:
                assert tuple(got[i, t]) == brute(t, few, window), (i, t)


def test_clean_cuts_spans_and_keeps_the_rest(spark, odd):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank"), (2, "!!!")], "item_id long, text string")
    out = {(r["doc_id"], r["text"]) for r in d.clean(odd, items, 10).collect()}
    assert (9, "The , then it sleeps under a tree until the evening comes.") not in out
    assert (9, "The  at noon, then it sleeps under a tree until the evening comes.") in out
    assert (1, None) in out and (8, "日本語 テキスト 😀 café Ünïcode x") in out
    whole = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank", "z")], "doc_id long, text string, more string")
    assert d.clean(whole, items, 10).count() == 0
    assert d.clean(odd, items.limit(0), 10).count() == odd.count()
    assert d.hits(odd, items.limit(0), 10).count() == odd.count()
