"""Plumbing: sizes, buckets, hashes, planes."""

import re

import numpy as np
import pyarrow as pa

from riskloom.llm import common


def test_planes_round_trip():
    for dtype in (np.int64, np.uint32, np.int32):
        x = np.random.default_rng(0).integers(0, 2**31 - 1, 57).astype(dtype)
        assert (common.unplanes(common.planes(x), dtype) == x).all()
    assert len(common.unplanes(b"", np.int64)) == 0


def test_buckets_cover_all_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    keys[-1] = 2**64 - 1
    for n in (1, 3, 7, 64, 100, 100_000, 2**32 - 1):
        assert common.bucket_of(keys, n).tolist() == [int(k) * n >> 64 for k in keys]
        found = common.pieces(keys, n)
        assert [lo for _, lo, _ in found] + [1000] == [0] + [hi for _, _, hi in found] and len({b for b, _, _ in found}) == len(found)
    assert common.pieces(keys[:0], 5) == []


def test_fresh_names(spark):
    assert common.fresh(spark.range(1), "pack") == "pack"
    assert common.fresh(spark.range(1).selectExpr("id AS Pack", "id AS _pack"), "pack") == "__pack"


def test_words_and_hashes():
    texts = [b"", b"a b", b" \t\n", b"x\x0by  z ", "é ü w".encode(), b"a b"]
    data, start, end, counts = common.words_at(texts)
    words = [data[a:b].tobytes() for a, b in zip(start, end)]
    expect = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
    assert words == [w for ws in expect for w in ws] and counts.tolist() == [len(ws) for ws in expect]
    for piece in (1, 5, 1 << 20):
        h = common.hash_words(data, start, end, piece)
        assert len({*zip(words, h.tolist())}) == len({*words}) == len({*h.tolist()})


def test_hasher_depends_on_content_only():
    data = np.frombuffer(b"abcabcab" * 9, np.uint8)
    h = common.Hasher(data)
    at = np.arange(len(data) - 5)
    keys = h(at, at + 5)
    assert all((keys[i] == keys[j]) == (data[i : i + 5] == data[j : j + 5]).all() for i in at for j in at)
    assert (h.all(5)[: len(at)] == keys).all()


def test_ranges_runs_and_slices():
    assert common.ranges(np.array([5, 1]), np.array([2, 3])).tolist() == [5, 6, 1, 2, 3]
    assert [x.tolist() for x in common.runs(np.array([True, False, True, True]))] == [[0, 2], [1, 4]]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 10, "z"]), pa.array([1, 2, 3, 4])], names=["text", "n"])
    parts = list(common.text_slices(batch, "text", 8))
    assert sum(len(p) for p in parts) == 4 and [i for p in parts for i in p.column(1).to_pylist()] == [1, 2, 3, 4]
    assert list(common.text_slices(batch.slice(0, 0), "text")) == []


def test_checkpoints_restore_the_session(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    out = common.cut(spark.range(10).repartition(3, "id"))
    assert out.count() == 10 and out.count() == 10 and spark.conf.get(name, "false") == before


def test_give_back_collects_the_heap(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))
    before = full()
    common.give_back(spark, always=True)
    assert full() == before + 1
    common.give_back(spark)  # a local master has no executors beside the driver
    assert full() == before + 1
