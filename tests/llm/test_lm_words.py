"""LM scores: every learned word has a code of its own, all bits of which are mixed."""

import heapq
import math
from collections import defaultdict

import numpy as np

from riskloom.llm import lm

from .test_models import random_texts


def test_inner_codes_are_huffman_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        sums, frequent = rng.integers(0, 40, n) ** 2, rng.random(n) < 0.1
        tails, leaf = lm.inner_codes(sums, frequent)
        known = np.flatnonzero((sums > 0) & ~frequent)
        weights = [max(1, int((sums[known] == 1).sum())), *sums[known].tolist()]
        heap, cost = sorted(weights), 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert (leaf[(sums == 0) & ~frequent] == 0).all() and len({*leaf[known].tolist()}) == len(known)
        assert (tails.length[leaf[frequent]] == 0).all()
        words = [format(int(c), f"0{k}b") if k else "" for c, k in zip(tails.code, tails.length)][:-1]
        assert sum(w * len(c) for w, c in zip(weights, words)) == cost
        mass, ends = defaultdict(int), np.cumsum(tails.length)
        for w, c in zip(weights, words):
            for k in range(len(c) + 1):
                mass[c[:k]] += w
        assert len(weights) == 1 or sum(2.0 ** -len(c) for c in words) == 1
        for c, end in zip(words, ends):
            for k, share in enumerate(tails.share[end - len(c) : end]):
                assert abs(0.5 + (int(share) + 0.5) / 512 - mass[c[:k] + "1"] / mass[c[:k]]) < 1 / 256


def full_model(texts, top, classes):
    """As ``lm.score`` builds it: (model, count of each key, distinct keys, codes inside classes by key)."""
    keys, tokens = lm.stream(texts)
    distinct, words, n = np.unique(keys, return_inverse=True, return_counts=True)
    first = np.lexsort((distinct, -n))[:top]
    frequent = np.zeros(len(distinct), bool)
    frequent[first] = True
    own, left = lm.class_of(distinct, classes), np.where(frequent, 0, n + (n == 1))
    code = lm.Code.build(distinct[first], n[first], np.bincount(own, left, classes).astype(np.int64))
    inner, unknown = {}, {}
    for c in range(classes):
        at = np.flatnonzero(own == c)
        tails, leaf = lm.inner_codes(n[at], frequent[at])
        inner |= {int(distinct[i]): tails.pick(np.array([k])) for i, k in zip(at, leaf)}
        unknown[c] = tails.pick(np.array([0]))
    tails, paths = paths_of(code, inner, unknown, distinct)
    symbols = code.symbols(distinct)[words]
    outer, deep = lm.Bits.of(code, symbols, tokens), lm.Bits.inside(code, symbols, tokens, paths, words, keys)
    nodes = np.bincount(outer.node * 2 + outer.bit, minlength=2 * (len(code.length) - 1)).reshape(-1, 2)
    table = lambda b: np.stack([np.bincount(s * 2 + b.bit, minlength=2 << lm.TABLE_BITS) for s in b.slots]).reshape(lm.CONTEXTS, -1, 2).astype(np.float32)
    none = np.zeros(classes, np.int64)
    return lm.Model.build(code, int(n.sum()), len(distinct), none, none, nodes, table(outer), table(deep)), dict(zip(distinct.tolist(), n.tolist())), distinct, inner, unknown


def paths_of(code, inner, unknown, distinct):
    each = [inner.get(int(k), unknown[int(k) % code.classes]) for k in distinct]
    tails = lm.Tails(*(np.concatenate([getattr(t, f) for t in each]) for f in ("length", "code", "share")))
    return tails, lm.Paths.of(code.symbols(distinct), tails)


def score(model, count, inner, unknown, keys, tokens):
    distinct, words = np.unique(keys, return_inverse=True)
    n = np.array([count.get(int(k), 0) for k in keys])
    return lm.score_texts(model, keys, tokens, n, paths_of(model.code, inner, unknown, distinct)[1], words, model.code.symbols(keys))[0]


def scalar(model, count, inner, unknown, keys):
    """The same, bit by bit with plain numbers; histories by exact nodes."""
    code, wide = model.code, (1 << 64) - 1
    mixed = lambda x: int(lm.mix64(np.array([x & wide], np.uint64))[0])
    logit = lambda p: math.log(p) - math.log1p(-p)
    frequent = {int(k): i for i, k in enumerate(code.keys)}
    tables = [t.view(np.float32).reshape(lm.CONTEXTS, -1, 2) for t in (model.seen, model.inner_seen)]
    weights, refine = [[float(x) for x in w] for w in model.first_weights()], [1 / (1 + math.exp(8 - i)) for i in range(17)]
    edges = {sum(lm.FIRST[:k]) for k in range(1, len(lm.FIRST) + 1)} | {sum(lm.FIRST) + lm.BLOCK * k for k in range(1, len(keys))}
    symbols, last, here, strange, words, pending, done, out = [], [], {}, {}, {}, [], 0, 0.0
    for at, key in enumerate(map(int, keys)):
        symbol = frequent.get(key, len(frequent) + key % code.classes)
        tail = inner.get(key, unknown[key % code.classes])
        far = sum((w + 1) * odd for w, odd in zip(last[::-1], (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)))
        path = [(False, int(code.node[symbol, k]), int(code.node[symbol, k]), bool(code.bit[symbol, k]), float(model.node_odds[code.node[symbol, k]])) for k in range(int(code.length[symbol]))]
        bits = format(int(tail.code[0]), f"0{int(tail.length[0])}b") if tail.length[0] else ""
        for k, bit in enumerate(bits):
            number = int(lm.inner_node(np.array([symbol]), np.array([int("1" + bits[:k], 2)], np.uint64))[0])
            path.append((True, (symbol, bits[:k]), number, bit == "1", logit(0.5 + (int(tail.share[k]) + 0.5) / 512)))
        for deep, node, number, bit, base in path:
            names = [int(k) for k in keys[:at]] if deep else symbols
            one, two = ((names[-k] + 1) & wide if at >= k else 0 for k in (1, 2))
            spread = number * 0xA24BAED4963EE407
            slots = [mixed(c + spread) >> (64 - lm.TABLE_BITS) for c in (one * 0x9FB21C651E98DF25, one * 0x9FB21C651E98DF25 + two * 0xE7037ED1A0B428DB, far)]
            seen = [tables[deep][j, s] for j, s in enumerate(slots)]
            x = [base] + [base * (1 - float(trust)) + float(own) for trust, own in seen]
            n, ones = here.get(node, (0, 0))
            prior = lm.INNER_PRIOR if deep else lm.PRIOR
            x += [logit((ones + prior / (1 + math.exp(-x[3]))) / (n + prior)), 0.3]
            levels = [sum(6 * float(trust) / (1 - float(trust)) > least for least in (2.5, 29.5, 299.5)) for trust, _ in seen]
            gate = lm.GATES + 4 * min(n, 3) + levels[0] if deep else 4 * levels[0] + levels[1]
            t = min(12.0, max(-12.0, sum(w * v for w, v in zip(weights[gate], x))))
            p, spot = 1 / (1 + math.exp(-t)), min(15.999, max(0.0, t + 8))
            cell = int(spot)
            final = min(1 - 1e-6, max(1e-6, 0.6 * p + 0.4 * ((1 - spot + cell) * refine[cell] + (spot - cell) * refine[cell + 1])))
            out += math.log(final if bit else 1 - final)
            pending.append((gate, x, bit - p, cell + (spot - cell > 0.5), bit))
            here[node] = n + 1, ones + bit
            done += 1
            if done in edges:
                for g, v, err, *_ in pending:
                    weights[g] = [w + 0.002 * err * y for w, y in zip(weights[g], v)]
                for c in {c for *_, c, _ in pending}:
                    own = [b for *_, k, b in pending if k == c]
                    refine[c] += (sum(own) - len(own) * refine[c]) / (len(own) + 12)
                pending = []
        if key in frequent:
            last = [*last, symbol][-3:]
        elif key not in count:
            c = key % code.classes
            seen, again = strange.get(c, (0, 0))
            same = words.get(key, 0)
            trust = (again + 0.2) / (seen + 4) if seen else 0.0
            out += math.log(trust * same / max(seen, 1) + 1 - trust)
            strange[c], words[key] = (seen + 1, again + (same > 0)), same + 1
        symbols.append(symbol)
    return out / math.log(10)


def test_scores_with_all_codes_equal_bit_by_bit():
    texts = random_texts(6, 80)
    model, count, _, inner, unknown = full_model(texts, 6, 4)
    own = [*random_texts(7, 12), *random_texts(8, 2, 1500), b"", b"never seen words of this kind seen seen", b"a " * 3000]
    keys, tokens = lm.stream(own)
    got = score(model, count, inner, unknown, keys, tokens)
    for ks, s in zip(np.split(keys, np.cumsum(tokens)[:-1]), got):
        assert math.isclose(scalar(model, count, inner, unknown, ks), s, rel_tol=2e-5), (len(ks), s)


def test_all_codes_are_a_distribution_over_the_next_word():
    """Probabilities of all learned words, and of an unknown one of each class, after a prefix sum to one."""
    model, count, distinct, inner, unknown = full_model(random_texts(4, 60), 4, 3)
    rng = np.random.default_rng(5)
    strange = [next(k for k in range(10**6, 10**7) if k % 3 == c and k not in count) for c in range(3)]
    for size in (0, 1, 3, 400):
        prefix = distinct[rng.integers(0, len(distinct), size)]
        one = lambda ks: score(model, count, inner, unknown, np.array(ks, np.uint64), np.array([len(ks)]))[0]
        before = one(prefix) if size else 0.0
        total = sum(10 ** (one([*prefix.tolist(), k]) - before) for k in [*distinct.tolist(), *strange])
        assert math.isclose(total, 1, abs_tol=1e-5), total


def test_contexts_see_words_beyond_the_frequent_ones(spark):
    """Rare words that follow each other: the true successor scores above another of the same class and count."""
    from pyspark.sql import functions as F

    names = [f"rare{k}" for k in range(600)]
    by_class = defaultdict(list)
    for w, c in zip(names, lm.class_of(lm.stream([w.encode() for w in names])[0][::2], 32).tolist()):
        by_class[c].append(w)
    pairs = [ws[:4] for ws in by_class.values() if len(ws) >= 4]  # two pairs, all of one class
    filler = [" ".join(f"f{(k * 37 + j) % 300}" for j in range(60)) for k in range(100)]
    texts = [*filler, *[f"{a} {b} {c} {d}" for a, c, b, d in pairs for _ in range(12)]]
    right, wrong = [f"{a} {b}" for a, c, b, d in pairs], [f"{a} {d}" for a, c, b, d in pairs]
    rows = [(k, t) for k, t in enumerate([*texts, *right, *wrong])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lm.score(docs, F.col("doc_id") < len(texts)).orderBy("doc_id").collect()][len(texts) :]
    for a, b in zip(got[: len(pairs)], got[len(pairs) :]):
        assert math.isclose(a["base_score"], b["base_score"]) and a["n_known"] == 3
    gains = [a["score"] - b["score"] for a, b in zip(got[: len(pairs)], got[len(pairs) :])]
    assert len(pairs) >= 20 and sum(gains) / len(gains) > 0.3 and min(gains) > 0, (min(gains), sum(gains) / len(gains))
