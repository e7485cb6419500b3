"""Every operator and stage: empty tables, repeated rows, a text of megabytes, columns whose names clash with internal ones."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from riskloom.llm import bpe, common, decontaminate, language, lm, media, quality, simhash, substring, suffixes

DATA = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, _learn string, _pack string, pack string, _key string, _rank string, _row long, _text string, key string, node long, id long, h long, kind string, bucket long"


@pytest.fixture(scope="module")
def clashing(spark):
    long = " ".join("w%d" % (k * 7919 % 50_021) for k in range(250_000))
    texts = [long, "alpha beta gamma", None, "", "alpha beta gamma", long]
    rows = [(i, t, "en", *["x"] * 5, i, "y", "z", 5, 6, 7, "k", 8) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[1:2], CLASH)


def same_rows(out, docs):
    """All columns of the input, unchanged, whatever was added."""
    key = lambda r: tuple(str(r[c])[:50] for c in docs.columns)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))


def operators(spark):
    from pyspark.sql import functions as F

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    return {
        "op1": suffixes.repeats, "op2": lambda d: media.read_back(media.store(d)), "op3": lambda d: bpe.decode(bpe.encode(d, path, pattern), path, pattern), "op4": lambda d: lm.score(d, F.lit(True)),
        "op5": lambda d: quality.predict(d, quality.learn(d, d.selectExpr("doc_id", "doc_id % 2 AS quality"))), "op7": substring.repeats, "op9": lambda d: language.predict(d, language.learn(d)),
    }, {"op6": simhash.near_duplicates, "op8": lambda d: decontaminate.hits(d, items)}


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op9"])
def test_operators_pass_all_columns(spark, clashing, name):
    same_rows(operators(spark)[0][name](clashing), clashing)
    assert operators(spark)[0][name](clashing.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op6", "op8"])
def test_operators_of_fixed_columns(spark, clashing, name):
    operator = operators(spark)[1][name]
    assert operator(clashing).count() == clashing.count() and operator(clashing.limit(0)).count() == 0


def test_results_on_a_text_of_megabytes(spark, clashing):
    out = {(r["doc_id"], r["_row"]): r for r in substring.repeats(clashing).collect()}
    assert out[5, 5]["kept"] == "" and out[0, 0]["cut_from"] == []
    cut = {r["doc_id"]: r for r in suffixes.repeats(clashing).collect()}
    assert bytes(cut[5]["kept"]) == b"" and cut[0]["cut_from"] == []
    got = simhash.dedup(clashing)
    assert got.columns == clashing.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2]
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(clashing).collect()}
    assert prints[5] == 0 and prints[4] == 1
    scores = {r["doc_id"]: r["score"] for r in lm.score(clashing, clashing["doc_id"] < 3).collect()}
    assert scores[0] == scores[5] and scores[1] == scores[4]
    back = media.read_back(media.store(clashing.where("doc_id = 0"))).first()
    assert hashlib.sha256(bytes(back["payload"])).digest() == hashlib.sha256(media.pad(back["text"].encode())).digest()


def test_stages_take_empty_tables_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word", None, None, 4), (2, "word", None, None, 4)], docs.schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        out = stage(spark, odd, DATA)
        assert k == 4 or out.columns == docs.columns
        assert out.count() == {"simhash_near_dedup": 2, "language_id": out.count()}.get(name, 5), name


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        common.shared_dir(Session)
