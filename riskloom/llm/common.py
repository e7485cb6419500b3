"""Shared plumbing: sizing, packs of documents and hash-bucketed exchanges.

A *pack* is a small group of documents (a few MB of text) chosen by a hash of
the document's id and text.  Operators that need facts about the whole corpus send one
compact blob per (pack, bucket) instead of one row per word, reduce every
bucket on its own, and send the answers back to the packs that asked.  Every
key is pre-aggregated inside its pack, so that a key held by a third of all
rows costs one entry per pack; no group ever holds more than its own packs or
its own share of the hash space.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20
#: Internal order of rows without an id: after all others.
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Layout:
    """How one input is dealt out: partitions, packs, hash buckets."""

    partitions: int
    packs: int
    buckets: int
    total_bytes: int


def layout(docs: DataFrame, text_col: str = "text", pack_mb: float = 4, bucket_mb: float = 32) -> Layout:
    """Sizes from the data: packs of about ``pack_mb``, buckets answering for about ``bucket_mb`` of text."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(total / (32 * MB)))
    return Layout(parts, max(2 * parts, math.ceil(total / (pack_mb * MB))), max(parts, math.ceil(total / (bucket_mb * MB))), total)


def bounded(spark: SparkSession, batch_mb: int = 4) -> SparkSession:
    """Bound the bytes (not only the rows) of Arrow batches of this session: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_mb * MB)
    return spark


def trim() -> None:
    """Give freed memory back: Python workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(work: Callable) -> Callable:
    """A ``mapInArrow`` function that trims memory at the end of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.  Where the session names none, a local one serves a local master (tests); on a cluster that raises."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: cuts lineage, survives lost executors.

    The shuffle files that led to it are of no further use and go at once.  So
    do the size estimates: those of joins are products, and over the rounds of
    a loop they would grow to numbers of millions of digits on the driver.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        done = df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(cleanup, before)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def give_back(spark: SparkSession, always: bool = False) -> None:
    """Executors collect their garbage and return the free heap to the system, on a cluster (or ``always``).

    A JVM keeps what its heap has once grown to, while the Python workers beside
    it need memory of the same executor.  One small task an executor.
    """
    sc = spark.sparkContext
    if not always and re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        return
    n = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have (names are not case-sensitive)."""
    used = {c.lower() for c in docs.columns}
    while name in used:
        name = f"_{name}"
    return name


def pack_of(at: Layout, id_col: str, text_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(at.packs)).cast("int")


def packed(docs: DataFrame, at: Layout, pack_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``pack_col``, dealt by it: a hash of id and text, so that rows without an id or of one id are spread.

    The exchange is the same node wherever the result is used, so Spark reuses it.
    """
    return docs.select(pack_of(at, id_col, text_col).alias(pack_col), "*").repartition(at.partitions, pack_col)


def ordered(table: pa.Table, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, list[bytes], pa.Table]:
    """(ids, UTF-8 texts, table) of a pack, in an order that any re-run repeats: by id, then text.  Null text: empty."""
    table = table.sort_by([(id_col, "ascending"), (text_col, "ascending")]).combine_chunks()
    ids = table[id_col].cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
    return ids, [x or b"" for x in table[text_col].cast(pa.binary()).to_pylist()], table


def planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane: equal high bytes compress well in a shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


BLOB = "bucket int, pack int, x binary, y binary, z binary"
BLOB_TYPES = pa.schema([("bucket", pa.int32()), ("pack", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])


def blobs(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(BLOB_TYPES.types)], schema=BLOB_TYPES)


def mark_shared(buckets: int) -> "callable":
    """Reducer of sorted distinct keys: which of them other packs hold too.

    ``x`` are the low 32 bits of the keys, ``y`` bits for keys that several
    documents of the pack hold, ``z`` bits for keys that may serve as reference
    (empty: all).  Answers per pack: bits of the keys held by two documents or
    more, of which at least one as reference.
    """

    def reduce(table: pa.Table) -> pa.Table:
        trim()
        packs, bucket = table["pack"].to_pylist(), table["bucket"][0].as_py()
        x = table["x"].combine_chunks()
        n = pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k).view(bool) if b else np.ones(k, bool) for b, k in zip(table[c].to_pylist(), n.tolist())])
        several, reference = bits("y"), bits("z")
        order = np.frombuffer(b"".join(x.to_pylist()), np.uint32).astype(np.uint64)
        order <<= np.uint64(32)  # in place: a bucket is the largest thing that a worker holds
        order |= np.arange(len(order), dtype=np.uint64)
        order.sort()
        at, key = order.astype(np.uint32), (order >> np.uint64(32)).astype(np.uint32)
        del order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        good = ((size > 1) | np.logical_or.reduceat(several[at], first)) & np.logical_or.reduceat(reference[at], first)
        out = np.zeros(len(at), bool)
        out[at] = np.repeat(good, size)
        ends = np.cumsum(n)
        return blobs([(bucket, p, np.packbits(out[e - k : e]).tobytes(), None, None) for p, e, k in zip(packs, ends.tolist(), n.tolist())])

    return reduce


def offer(pack: int, keys: np.ndarray, several: np.ndarray, reference: np.ndarray | None, buckets: int) -> pa.Table:
    """Blobs for ``mark_shared`` from sorted distinct 64-bit keys."""
    low = spread(keys, buckets)
    return blobs([
        (b, pack, low[lo:hi].tobytes(), np.packbits(several[lo:hi]).tobytes(), None if reference is None else np.packbits(reference[lo:hi]).tobytes())
        for b, lo, hi in pieces(keys, buckets)
    ])


def spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of each key that tell keys of one bucket apart: those below the bits that the bucket itself fixes."""
    return (keys >> np.uint64(max(0, 32 - max(buckets - 1, 0).bit_length()))).astype(np.uint32)


def answers(table: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Flags for the same keys from the reducer's answers to one pack."""
    where, out = {b: (lo, hi) for b, lo, hi in pieces(keys, buckets)}, np.zeros(len(keys), bool)
    for b, x in zip(table["bucket"].to_pylist(), table["x"].to_pylist()):
        lo, hi = where[b]
        out[lo:hi] = np.unpackbits(np.frombuffer(x, np.uint8), count=hi - lo).view(bool)
    return out


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 2 * MB) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch holding about ``limit`` bytes of ``column`` each (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.array([0 if x is None else x for x in pc.binary_length(col).to_pylist()], dtype=np.int64)
    step = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(batch)] if len(batch) else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd base of the byte hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of any stretch of a byte string from prefix sums."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(10, int(len(data) + 1).bit_length())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values()[data] * _powers(size, BASE)[: len(data)], dtype=np.uint64)])
        self.inverse = _powers(size, INVERSE)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.inverse[lo])

    def all(self, n: int) -> np.ndarray:
        """Of the ``n`` bytes from each position on."""
        m = len(self.sums) - n
        return mix64((self.sums[n:] - self.sums[:m]) * self.inverse[:m])


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words_at(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, word starts, word ends, words per text); words end at ASCII white space."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    blank = _BLANK[data]
    start, end = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    return data, start, end, np.diff(np.concatenate([[0], np.searchsorted(start, ends, side="right")]))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = MB) -> np.ndarray:
    """64-bit hash of each word of a byte string, about ``piece`` bytes at a time."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + piece)))
        first = start[lo]
        out[lo:hi] = Hasher(data[first : end[hi - 1]])(start[lo:hi] - first, end[lo:hi] - first)
        lo = hi
    return mix64(out + (end - start).astype(np.uint64))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of ``buckets`` (under 2^32) equal ranges of the 64-bit numbers holds each key."""
    n, low = np.uint64(buckets), np.uint64(32)
    return ((keys >> low) * n + ((keys & np.uint64(0xFFFFFFFF)) * n >> low)) >> low


def pieces(sorted_keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that sorted keys fall into, and of no others: their number does not cost."""
    own = bucket_of(sorted_keys, buckets)
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return list(zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)]))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]
