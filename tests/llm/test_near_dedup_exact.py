"""Near-dedup by similarity finds exactly the groups of the all-pairs definition: short texts, large families, any order."""

import random

import numpy as np

from riskloom.llm import simhash

from .test_pipeline import shingles
from .test_simhash import grouped


def expected(docs):
    """Smallest id of each group of texts linked by a Jaccard similarity of 0.8, from all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    codes = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    held = np.zeros((len(sets), len(codes)), np.float32)
    for row, own in zip(held, sets.values()):
        row[[codes[s] for s in own]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    near = 5 * both >= 4 * (n[:, None] + n - both)
    at = {i: k for k, i in enumerate(sets)}
    roots, least = grouped([*sets], lambda a, b: near[at[a], at[b]]), {}
    for i, r in roots.items():
        least[r] = min(i, least.get(r, i))
    return {*least.values()}


def kept(spark, docs):
    return {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_short_texts(spark):
    rng = random.Random(11)
    docs = []
    for _ in range(300):
        base = ["w%d" % rng.randrange(10**6) for _ in range(rng.randrange(8, 13))]
        docs += [base, base + ["x%d" % rng.randrange(10**6)]]  # 4 of 5 shingles and up
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    assert kept(spark, docs) == expected(docs) == {*range(0, 600, 2)}


def test_family_of_templates_with_one_near_copy_each(spark):
    rng = random.Random(12)
    word = lambda: "w%d" % rng.randrange(10**6)
    base, docs = [word() for _ in range(150)], []
    for _ in range(250):
        own = list(base)
        for at in rng.sample(range(10), 2):
            own[at * 15 + rng.randrange(15)] = word()  # under 0.8 to most others
        copy = list(own)
        copy[rng.randrange(len(copy))] = word()
        docs += [own, copy]
    docs = [(i, " ".join(d)) for i, d in zip(rng.sample(range(10_000), len(docs)), docs)]
    assert kept(spark, docs) == expected(docs)


def test_pairs_inside_a_family_are_all_found(spark):
    rng = random.Random(13)
    word = lambda: "w%d" % rng.randrange(10**6)
    base, docs = [word() for _ in range(184)], []
    for _ in range(250):
        own = list(base) + [word() for _ in range(26)]  # about 0.77 to every other
        copy = list(own)
        copy[-1 - rng.randrange(20)] = word()
        docs += [own, copy]
    docs = [(i, " ".join(d)) for i, d in zip(rng.sample(range(10_000), len(docs)), docs)]
    want = expected(docs)
    assert len(want) == 250 and kept(spark, docs) == want


def test_planted_pairs_by_similarity(spark):
    """1,000 pairs a band: all of 0.8 or more are joined, none of less."""
    rng = random.Random(14)
    word = lambda: "w%d" % rng.randrange(10**7)
    docs, bands = [], {0.75: 0, 0.8: 0, 0.85: 0, 0.9: 0}
    while min(bands.values()) < 1000:
        base = [word() for _ in range(rng.randrange(60, 160))]
        copy = list(base)
        for at in rng.sample(range(2, len(base) - 2), rng.randrange(1, 5)):
            copy[at] = word()
        pair = " ".join(base), " ".join(copy)
        a, b = map(shingles, pair)
        near = len(a & b) / len(a | b)
        band = max((x for x in bands if x <= near), default=None)
        if band and near < 0.95 and bands[band] < 1000:
            bands[band] += 1
            docs.append((near >= 0.8, pair))
    got = kept(spark, [(2 * k + j, t) for k, (_, pair) in enumerate(docs) for j, t in enumerate(pair)])
    assert got == {2 * k for k in range(len(docs))} | {2 * k + 1 for k, (same, _) in enumerate(docs) if not same}
