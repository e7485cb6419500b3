"""Trained operators: held-out accuracy, exact base counts, and brute force for the inner parts."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from riskloom.llm import language, lm, quality, queries

from .conftest import ODD

DATA = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    size, k = np.array([3, 0, 1, 4]), 3
    score, move = rng.normal(size=(8, k)), rng.normal(size=(k, k))
    got, pairs = language.marginals(score, size, move, pairs=True)
    at, both = 0, np.zeros((k, k))
    for n in size:
        total, single, double = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = math.exp(sum(score[at + i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                single[i, y] += w
            for a, b in zip(path, path[1:]):
                double[a, b] += w
        assert np.allclose(got[at : at + n], single / total, atol=1e-6)
        both += double / total
        at += n
    assert np.allclose(pairs, both, atol=1e-6)


def test_language_accuracy_and_odd_rows(spark, odd):
    out = queries.op9_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    field = language.learn(spark.read.parquet(f"{DATA}/documents.parquet"), per_language=40)
    got = language.predict(odd, field).collect()
    assert len(got) == len(ODD)
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in field.languages and 0 < r["score"] <= 1
    assert {r["lang_pred"] for r in language.predict(odd, language.learn(odd.limit(0))).collect()} == {"und"}
    assert language.predict(odd.limit(0), field).count() == 0
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars BETWEEN 500 AND 900").collect()}
    halves = [docs["en"][:300], docs["es"][:300]]
    labels = language.label_words(" ".join(halves), field)
    n = len(language.words_of(halves[:1]).first)
    assert labels[:n].count("en") > 0.8 * n and labels[n:].count("es") > 0.8 * (len(labels) - n)


def test_quality_held_out(spark, odd):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    out = queries.op5_quality(spark, DATA).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.9
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.fit(x, y, trees=40)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    for row, s in zip(x[:20], forest.score(x)[:20]):  # a plain walk
        total = forest.base
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] + int(row[forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        assert math.isclose(s, 1 / (1 + math.exp(-total)))
    assert quality.predict(odd, forest := quality.fit(np.zeros((0, 28)), np.zeros(0))).count() == len(ODD) and forest.score(np.zeros((1, 28)))[0] == 0.5


def test_quality_statistics_by_definition():
    text = "Ab, ab! x|y 12 é\nAb ab <b>.\n\nA-very-long-word-of-over-20-letters ends."
    raw = text.encode()
    got = dict(zip(quality.FEATURES, quality.statistics(raw)))
    words, lines, n = raw.split(), raw.split(b"\n"), len(raw)
    part = lambda ok: sum(map(ok, raw)) / n
    want = {
        "log_bytes": math.log(n + 1), "log_words": math.log(len(words) + 1), "word_mean": sum(map(len, words)) / len(words), "upper": part(lambda c: 65 <= c <= 90), "digits": part(lambda c: 48 <= c <= 57),
        "non_ascii": part(lambda c: c >= 128), "space": part(lambda c: c in b" \t\n\r\v\f"), "bar": part(lambda c: c == 124), "distinct_words": len({*words}) / len(words), "top_word": max(Counter(words).values()) / len(words),
        "distinct_pairs": len({*zip(words, words[1:])}) / (len(words) - 1), "log_lines": math.log(len(lines) + 1), "distinct_lines": len({*lines}) / len(lines), "line_mean": n / len(lines),
        "entropy": -sum(k / n * math.log2(k / n) for k in Counter(raw).values()), "end_marks": sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), "long_words": sum(len(w) > 20 for w in words) / len(words),
        "title_words": sum(w[:1].isupper() for w in words) / len(words), "stops": raw.count(b".") / len(words), "commas": raw.count(b",") / len(words), "exclaim": raw.count(b"!") / n, "deflated": len(zlib.compress(raw, 1)) / (n + 16),
    }
    for name, value in want.items():
        assert math.isclose(got[name], value, rel_tol=1e-9), name
    assert len(got) == len(quality.FEATURES) == len(quality.statistics(b""))


def test_quality_first_split_is_the_best_one():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(80, 2)), 1)
    y = (x[:, 1] + rng.normal(size=80) > 0.3).astype(float)
    forest = quality.fit(x, y, trees=1, depth=1, bins=256, least=5, rate=1.0)
    p = y.mean()
    g, h = p - y, np.full(80, p * (1 - p))
    leaf = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = {(f, t): leaf(x[:, f] <= t) + leaf(x[:, f] > t) for f in range(2) for t in np.unique(x[:, f]) if 5 <= (x[:, f] <= t).sum() <= 75}
    f, t = int(forest.feature[0]), float(forest.threshold[0])
    left = x[:, f] <= t
    assert math.isclose(leaf(left) + leaf(~left), max(gains.values()), rel_tol=1e-9)
    for side, at in ((left, forest.left[0]), (~left, forest.left[0] + 1)):
        assert math.isclose(forest.value[at], -g[side].sum() / (h[side].sum() + 1), rel_tol=1e-9)


def test_lm_base_and_gain(spark):
    rows = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    counts = Counter()
    for i, ws in rows.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*ws, b""])
    n, v = sum(counts.values()), len(counts)
    out = queries.op4_lm_score(spark, DATA).collect()
    assert len(out) == len(rows)
    gain = 0.0
    for r in out:
        own = [*rows[r["doc_id"]], b""]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
        if r["held_out"]:
            gain += (r["score"] - r["base_score"]) / len(own)
    assert gain / sum(r["held_out"] for r in out) > 0.1


def lm_model(texts, top, classes):
    """(model, counts by key, distinct keys) of some training texts."""
    keys, tokens = lm.stream(texts)
    distinct, n = np.unique(keys, return_counts=True)
    first = np.argsort(-n, kind="stable")[:top]
    rest = np.ones(len(distinct), bool)
    rest[first] = False
    own = lm.class_of(distinct, classes)
    held, kinds = np.bincount(own[rest], n[rest], classes), np.bincount(own[rest], minlength=classes)
    code = lm.Code.build(distinct[first], n[first], held)
    b = lm.Bits.of(code, code.symbols(keys), tokens)
    nodes = np.bincount(b.node * 2 + b.bit, minlength=2 * (len(code.length) - 1)).reshape(-1, 2)
    table = np.stack([np.bincount(s * 2 + b.bit, minlength=2 << lm.TABLE_BITS) for s in b.slots]).reshape(lm.CONTEXTS, -1, 2).astype(np.float32)
    return lm.Model.build(code, int(n.sum()), len(distinct), held, kinds, nodes, table), dict(zip(distinct.tolist(), n.tolist())), distinct


def random_texts(seed, n, most=30):
    rng = random.Random(seed)
    words = [w * k for w in "abcdefgh" for k in (1, 1, 1, 2, 3)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, most))).encode() for _ in range(n)]


def test_lm_is_a_distribution_over_the_next_word():
    """Probabilities of all words (and of an unknown one of each class) after a prefix sum to one."""
    model, count, distinct = lm_model(random_texts(4, 60), 4, 3)
    rng = random.Random(5)
    unknown = [next(k for k in range(10**6, 10**7) if k % 3 == c and k not in count) for c in range(3)]
    for prefix in ([], [0], [3, 5, 3], rng.choices(range(len(distinct)), k=400)):
        own = distinct[prefix].astype(np.uint64)
        score = lambda ks: lm.score_texts(model, ks, np.array([len(ks)]), np.array([count.get(int(k), 0) for k in ks]))[0][0]
        before = score(own) if len(prefix) else 0.0
        total = sum(10 ** (score(np.append(own, np.uint64(k))) - before) for k in [*distinct.tolist(), *unknown])
        assert math.isclose(total, 1, abs_tol=1e-5), total


def scalar_score(model, keys, count):
    """The same model, bit by bit with plain numbers."""
    code, wide = model.code, (1 << 64) - 1
    frequent = {int(k): i for i, k in enumerate(code.keys)}
    mixed = lambda x: int(lm.mix64(np.array([x & wide], np.uint64))[0])
    logit = lambda p: math.log(p) - math.log1p(-p)
    table = model.seen.view(np.float32).reshape(lm.CONTEXTS, -1, 2)
    weights = [[float(x) for x in w] for w in model.first_weights()]
    refine = [1 / (1 + math.exp(8 - i)) for i in range(17)]
    symbols, last, here, turn, words, pending, done, out = [], [], {}, {}, {}, [], 0, 0.0
    edges = [*np.cumsum(lm.FIRST).tolist()]
    while edges[-1] < 20 * len(keys):
        edges.append(edges[-1] + lm.BLOCK)
    for key in keys:
        key = int(key)
        symbol = frequent.get(key, len(frequent) + key % code.classes)
        one, two = (symbols[-k] + 1 if len(symbols) >= k else 0 for k in (1, 2))
        far = sum((w + 1) * odd for w, odd in zip(last[::-1], (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)))
        for level in range(int(code.length[symbol])):
            node, bit = int(code.node[symbol, level]), bool(code.bit[symbol, level])
            deep, first = node * 0xA24BAED4963EE407, one * 0x9FB21C651E98DF25
            slots = [mixed(c + deep) >> (64 - lm.TABLE_BITS) for c in (first, first + two * 0xE7037ED1A0B428DB, far)]
            base = float(model.node_odds[node])
            x = [base] + [base * (1 - float(table[j, s, 0])) + float(table[j, s, 1]) for j, s in enumerate(slots)]
            n, ones = here.get(node, (0, 0))
            prior = 1 / (1 + math.exp(-x[3]))
            x += [logit((ones + 6 * prior) / (n + 6)), 0.3]
            gate = 0
            for j in range(2):
                seen = 6 * float(table[j, slots[j], 0]) / (1 - float(table[j, slots[j], 0]))
                gate = 4 * gate + sum(seen > least for least in (2.5, 29.5, 299.5))
            t = min(12.0, max(-12.0, sum(w * v for w, v in zip(weights[gate], x))))
            p, spot = 1 / (1 + math.exp(-t)), min(15.999, max(0.0, t + 8))
            cell = int(spot)
            final = 0.6 * p + 0.4 * ((1 - (spot - cell)) * refine[cell] + (spot - cell) * refine[cell + 1])
            final = min(1 - 1e-6, max(1e-6, final))
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
        if key not in frequent:
            c = key % code.classes
            seen, again = turn.get(c, (0, 0))
            same = words.get(key, 0)
            share = (count.get(key, 0) + 0.5) / model.mass[c]
            trust = (again + 0.2) / (seen + 4) if seen else 0.0
            out += math.log(trust * same / max(seen, 1) + (1 - trust) * share)
            turn[c], words[key] = (seen + 1, again + (same > 0)), same + 1
        else:
            last.append(symbol)
            last = last[-3:]
        symbols.append(symbol)
    return out / math.log(10)


def test_lm_score_equals_bit_by_bit():
    texts = random_texts(6, 80)
    model, count, _ = lm_model(texts, 6, 4)
    own = [*random_texts(7, 12), *random_texts(8, 2, 1500), b"", b"never seen words of this kind seen seen"]
    keys, tokens = lm.stream(own)
    got = lm.score_texts(model, keys, tokens, np.array([count.get(int(k), 0) for k in keys]))[0]
    for ks, score in zip(np.split(keys, np.cumsum(tokens)[:-1]), got):
        assert math.isclose(scalar_score(model, ks, count), score, rel_tol=2e-5), (len(ks), score)


def test_lm_long_texts_stand_alone(spark):
    """Equal texts score equally, also beside a text of megabytes; all its columns pass."""
    from pyspark.sql import functions as F

    long = " ".join("w%d" % (k * 7919 % 60_000) for k in range(300_000))
    rows = [(i, t, i, "x") for i, t in enumerate([long, "a b c a b", *[f"w{k} w{k + 1} a" for k in range(200)], "a b c a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _learn long, pack string")
    out = lm.score(docs, F.lit(True))
    assert out.columns[:4] == docs.columns
    got = out.orderBy("doc_id").collect()
    assert got[1]["score"] == got[-1]["score"] and got[0]["n_tokens"] == 300_001
    assert lm.slices(np.array([5, 200_000, 3, 4, 99_998]), 100_000) == [(0, 1), (1, 2), (2, 4), (4, 5)]


def test_lm_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    out = lm.score(odd, F.col("doc_id") % 2 == 0)
    got = out.collect()
    assert len(got) == len(ODD) and {*odd.columns} <= {*out.columns}
    same = [r["score"] for r in got if r["text"] == "word"]
    assert len(same) == 2 and same[0] == same[1]
    assert all(r["n_tokens"] == 1 for r in got if not (r["text"] or "").strip())
    assert lm.score(odd, F.lit(False)).agg(F.sum("n_known"), F.max("train_tokens")).first() == (0, 0)
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0
