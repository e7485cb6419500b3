"""SimHash fingerprints, links and components against brute force."""

import random
import re

import xxhash

from riskloom.llm import graph, simhash

from .conftest import ODD


def fingerprint(text, k=3):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hs = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in ([ws[i : i + k] for i in range(len(ws) - k + 1)] or ([ws] if ws else []))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grouped(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_whole_operator(spark, odd):
    out = simhash.near_duplicates(odd).collect()
    prints = {(i, t): fingerprint(t) for i, t in ODD}
    assert sorted((r["doc_id"] or 0, r["fp"] % 2**64) for r in out) == sorted((i or 0, f) for (i, t), f in prints.items())
    roots = grouped(sorted({*prints.values()}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, t), f in prints.items():
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out) == sorted((i or 0, least.get(roots[f], 0)) for (i, t), f in prints.items())
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    fps = {*seeds}
    for _ in range(300):
        f = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = lambda f: f - 2**64 if f >> 63 else f
    frame = spark.createDataFrame([(signed(f),) for f in fps] * 2, "fp long")
    for distance in (0, 2, 4):
        got = {r["node"]: r["root"] for r in graph.components(simhash.links(frame, distance)).collect()}
        expect = grouped(sorted(fps), lambda a, b: (a ^ b).bit_count() <= distance)
        by_got, by_expect = {}, {}
        for f in fps:
            by_got.setdefault(got.get(signed(f), signed(f)), set()).add(f)
            by_expect.setdefault(expect[f], set()).add(f)
        assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_expect.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in range(1000, 1300)}) == 1
    assert got[0] != got[1000] and len(got) == 601
