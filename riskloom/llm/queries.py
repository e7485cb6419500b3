"""Queries over the ten operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, lm, media, quality, simhash, substring, suffixes, warc
from .common import bounded, cut
from .oracles import ORACLES

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("cut_from").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    back = media.read_back(media.store(docs).select("doc_id", "n_bytes", "media"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, TOKENIZER, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, TOKENIZER, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _remainder(n: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``n``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm.score(docs, learn_from=_remainder(5) != 1)
    return out.select("doc_id", F.coalesce(_remainder(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.learn(docs, _table(spark, sf_dir, "labels"), allowed=_remainder(5) != 0)
    return quality.predict(docs, forest).select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = language.learn(docs, allowed=_remainder(4) != 2)
    return language.predict(docs.select("doc_id", "text"), field).select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, distance=2, seed=42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    gone = F.aggregate(F.arrays_zip("cut_from", "cut_to"), F.lit(0).cast("long"), lambda a, x: a + x["cut_to"] - x["cut_from"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    spans = found.select("doc_id", "n_words", "item_ids", F.transform(F.arrays_zip("hit_from", "hit_to"), lambda x: x["hit_to"] - x["hit_from"]).alias("lengths"))
    n_hit = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_sort(F.col("item_ids").cast("array<string>"))
    return spans.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(warc.write(warc.decide(_table(spark, sf_dir, "pages"))))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_suffix_array, op2_media_columns, op3_byte_bpe, op4_lm_score, op5_quality, op6_simhash, op7_substring, op8_decontaminate, op9_language, op10_warc)}


__all__ = ["ORACLES", "QUERIES"]
