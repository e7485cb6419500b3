"""Corpus pipeline: language ID, near-dedup, substring dedup, benchmark decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is
written and read again before the next, so that a lost executor costs one
stage at most.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, language, simhash, substring
from riskloom.llm.common import bounded, give_back, shared_dir

#: A document goes if less than this share of its words is of one known language.
MIN_SHARE = 0.4


def ready(spark: SparkSession) -> None:
    """Before each stage: Arrow batches of 1 MB, and executors without the garbage of the stage before."""
    bounded(spark, 1)
    give_back(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown (no letters) or whose best language holds under MIN_SHARE go; ``lang`` becomes the prediction."""
    ready(spark)
    field = language.learn(docs)
    give_back(spark)
    out = language.predict(docs, field).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))
    return out.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    ready(spark)
    return simhash.dedup(docs, words=5, similarity=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds go from the later ones."""
    ready(spark)
    return sized(substring.dedup(docs, window=50))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 10 words or more of a benchmark item go; documents that are mostly such spans go as a whole."""
    ready(spark)
    return sized(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.5))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and whether they decode to the text."""
    ready(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    same = F.col("decoded") == F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return out.select("doc_id", "lang", "source", F.col("ids").alias("tokens"), F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


def sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("byte_bpe", tokenize),
]

#: Trained models, components and automata are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of an earlier stage, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder, which goes when the next stands.  The last stays: it is the result."""
    import uuid

    docs, top, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        own = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        docs = spark.read.parquet(own)
        if before:
            remove(spark, before)
        before = own
    return docs
