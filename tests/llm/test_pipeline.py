"""Near-dedup by similarity and the pipeline's stages against brute force."""

import random

import public_tokenizers

import corpus_pipeline
from riskloom.llm import decontaminate, simhash

from .conftest import ODD
from .test_decontaminate import brute as hit_words

DATA = "/root/testdata/sf0.001"


def shingles(text, k=5):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) > k else ({tuple(ws)} if ws else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "w%d" % rng.randrange(4000)
    docs = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(60, 400))]
        docs.append(base)
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(base) // 60, len(base) // 8])):
                near[rng.randrange(len(near))] = word()
            docs.append(near)
    docs = [(i, " ".join(d)) for i, d in zip(rng.sample(range(10_000), len(docs)), docs)]
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    expect = {find(i) for i in sets}
    got = {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert expect <= got and len(got - expect) <= 2  # verified pairs only; a rare miss at the very threshold


def test_near_dedup_odd_rows(spark, odd):
    out = simhash.dedup(odd)
    assert out.columns == odd.columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in out.collect())
    assert (1, None) in got and not any(i in (2, 3, 5, 10) for i, _ in got) and (4, "word") in got and (9, ODD[8][1]) in got
    assert simhash.dedup(odd.limit(0)).count() == 0
    assert simhash.dedup(odd.unionAll(odd)).count() == len(got)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, DATA).persist()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count() and {*after} <= {*before}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "simhash_near_dedup":
            left = [shingles(r["text"]) for r in after.values()]
            assert not any(jaccard(a, b) >= 0.85 for x, a in enumerate(left) for b in left[:x])
        if name == "substring_dedup":
            first, kept = {}, {}
            for i, r in sorted(before.items()):
                ws = (r["text"] or "").split()
                gone = set()
                for p in range(len(ws) - 49):
                    if first.setdefault(tuple(ws[p : p + 50]), i) < i:
                        gone |= {*range(p, p + 50)}
                kept[i] = [w for p, w in enumerate(ws) if p not in gone]
            assert {i: r["text"].split() for i, r in after.items()} == {i: w for i, w in kept.items() if w or not before[i]["text"].split()}
        if name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            for i, r in before.items():
                n, hit, _ = hit_words(r["text"], items, 10)
                if len(hit) > n / 2:
                    assert i not in after
                else:
                    own = decontaminate.words(r["text"].encode())
                    assert decontaminate.words(after[i]["text"].encode()) == [w for p, w in enumerate(own) if p not in hit]
        if name == "byte_bpe":
            assert all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in after.values())


def test_language_stage_rejects_what_has_no_letters(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = spark.createDataFrame([(10**9, "123 456 !!", "en", "s", 10), (10**9 + 1, None, "en", "s", 0)], docs.schema)
    out = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionAll(junk), DATA).collect()}
    assert 10**9 not in out and 10**9 + 1 not in out and len(out) > 0.97 * docs.count()
    assert public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_stages_start_without_garbage(spark, odd, monkeypatch):
    called = []
    monkeypatch.setattr(corpus_pipeline, "give_back", called.append, raising=False)
    docs = odd.drop("pack", "ids", "media")
    for name, stage in corpus_pipeline.STAGES:
        called.clear()
        stage(spark, docs, DATA)
        assert called, name
