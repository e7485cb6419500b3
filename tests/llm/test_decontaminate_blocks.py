"""Several blocks of items give what one block gives."""

from functools import partial

from riskloom.llm import decontaminate as d
from riskloom.llm import queries

from .test_decontaminate import brute

DATA = "/root/testdata/sf0.001"


def test_query_gives_one_row_per_document_at_any_block_size(spark, monkeypatch):
    whole = sorted(map(tuple, queries.op8_decontaminate(spark, DATA).collect()))
    monkeypatch.setattr(d, "hits", partial(d.hits, block_words=300))
    parts = sorted(map(tuple, queries.op8_decontaminate(spark, DATA).collect()))
    assert parts == whole and any(r[-1] for r in parts) and len({r[0] for r in parts}) == len(parts)


def test_hits_of_several_blocks_are_united_per_row(spark, odd):
    items = [(1, "a b c d e"), (2, "d e f g h"), (1, "x y z p q"), (3, "f g h i j")]
    docs = [(1, "0 a b c d e f g h i j 0"), (1, "x y z p q"), (None, "d e f g h"), (None, "nothing"), (2, None)]
    out = d.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, 3).collect()
    got = sorted((r["text"] or "", r["n_words"], r["hit_from"], r["hit_to"], r["item_ids"]) for r in out)
    assert got == [("", 0, [], [], []), ("0 a b c d e f g h i j 0", 12, [1], [11], [1, 2, 3]), ("d e f g h", 5, [0], [5], [2]), ("nothing", 1, [], [], []), ("x y z p q", 5, [0], [5], [1])]


def test_clean_judges_all_blocks_at_once(spark, odd):
    items = [(1, "a b c d e"), (2, "d e f g h"), (3, "p q r s t"), (4, "k1 k2 k3 k4 l1")]
    docs = [
        (1, "a b c d e 1 2 3 4 p q r s t 5 6"),  # 10 of 16 words, 5 a block
        (2, "1 2 3 4 5 6 7 8 a b c d e f g h 9"),  # spans of two blocks overlap
        (3, "1 2 3 4 5 6 k1 k2 a b c d e k3 k4 l1 7 8 9"),  # cutting one block's span would join another's
        (4, "plain"), (5, None),
    ]
    own = lambda block: {(r["doc_id"], r["text"]) for r in d.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, block_words=block).collect()}
    whole, parts = own(2_000_000), own(3)
    assert parts == whole
    assert {i for i, _ in parts} == {2, 3, 4, 5} and all(brute(t, items, 5)[1] == set() for i, t in parts if i != 3) and (2, "1 2 3 4 5 6 7 8  9") in parts
    assert (3, "1 2 3 4 5 6 k1 k2  k3 k4 l1 7 8 9") in parts
    pair = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank"), (2, "under a tree until the evening comes")], "item_id long, text string")
    assert sorted(map(str, d.clean(odd, pair, 5, block_words=3).collect())) == sorted(map(str, d.clean(odd, pair, 5).collect()))
