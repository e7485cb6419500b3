"""LM scores: histories by text, and what the codes of a pack's words take to unfold."""

import tracemalloc
from collections import Counter

import numpy as np

from riskloom.llm import lm


def test_histories_are_those_of_each_text():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 40, 0, 7, 300, 1, 0])
    key = rng.choice(np.array([0, 1, 9, 1 << 16, 2**32 - 1], np.uint32), int(size.sum()))
    flag = rng.random(len(key)) < 0.4
    n, ones = lm.before_counts(key, size, flag)
    at = 0
    for events in size.tolist():
        seen, flagged = Counter(), Counter()
        for k in range(at, at + events):
            assert (n[k], ones[k]) == (seen[key[k]], flagged[key[k]])
            seen[key[k]] += 1
            flagged[key[k]] += int(flag[k])
        at += events
    assert (lm.before_counts(key, size)[0] == n).all()
    assert [len(x) for x in lm.before_counts(key[:0], size[:1], flag[:0])] == [0, 0]


def test_paths_of_a_pack_unfold_piece_by_piece():
    """Beside the result, no 64-bit numbers of every bit of every word but one."""
    rng = np.random.default_rng(4)
    weights = rng.integers(1, 50, 50_000)
    length, code, share = lm.climb(weights)
    symbols = rng.integers(0, 32, len(weights))
    tracemalloc.start()
    paths = lm.Paths.of(symbols, lm.Tails(length, code, share))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * len(paths.node), most / len(paths.node)
    for w in (0, 777, 49_999):
        bits = format(int(code[w]), f"0{int(length[w])}b")
        at = slice(int(paths.start[w]), int(paths.start[w] + length[w]))
        assert paths.bit[at].tolist() == [b == "1" for b in bits]
        before = np.array([int("1" + bits[:k], 2) for k in range(len(bits))], np.uint64)
        assert (paths.node[at] == lm.inner_node(np.full(len(bits), symbols[w]), before)).all()
