"""Substring dedup with fixed-block anchors.

Every document is a reference cut into non-overlapping blocks of half a window
(7 words for windows of 13), so that any window holds one whole block.  The
blocks are indexed; every rolling stretch of a block's length probes the index
(first exchange: one compact blob of distinct keys per pack and bucket).
Around each hit, on both sides, all windows that hold the anchor are keyed and
compared corpus-wide (second exchange), which extends hits word by word to
maximal exact repeats.  A window that also starts in a document with a smaller
id is removed; runs of removed words are the repeats.

Window keys are 64-bit hashes of word sequences; two windows are taken for
equal if their keys are.  Both exchanges send a key once per pack, however
often it occurs there.

Defined results: null text has no words; texts shorter than a window lose
nothing; documents of equal id do not remove each other; a null id ranks after
all others; repeated rows keep their row; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOB, answers, blobs, fresh, hash_words, layout, mark_shared, mix64, offer, ordered, packed, pieces, planes, runs, trim, unplanes, words_at

BASE = np.uint64(0x9E3779B97F4A7C15)


def stretch_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """Key of the ``n`` words from each position on (positions where they fit in the pack)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= BASE
        out += hashes[j : j + m]
    return mix64(out)


class Pack:
    """Words of one pack, laid end to end."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str):
        trim()
        self.ids, self.texts, self.table = ordered(table, id_col, text_col)
        data, start, end, self.counts = words_at(self.texts)
        self.hashes = hash_words(data, start, end)
        ends = np.cumsum(self.counts)
        self.start, self.end = ends - self.counts, ends
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)

    def stretches(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of all stretches of ``n`` words inside one document."""
        keys = stretch_keys(self.hashes, n)
        at = np.flatnonzero(np.arange(len(keys)) + n <= self.end[self.doc[: len(keys)]]) if len(keys) else np.zeros(0, np.int64)
        return at, keys[at]

    def blocks(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions, inverse, distinct keys, held by several ids, of a reference block)."""
        at, keys = self.stretches(size)
        distinct, inverse = np.unique(keys, return_inverse=True)
        several = differ(inverse, len(distinct), self.ids[self.doc[at]])
        reference = np.zeros(len(distinct), bool)
        reference[inverse[(at - self.start[self.doc[at]]) % size == 0]] = True
        return at, inverse, distinct, several, reference


def differ(inverse: np.ndarray, n: int, ids: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` groups has more than one id."""
    one = np.zeros(n, np.int64)
    one[inverse] = ids
    out = np.zeros(n, bool)
    out[inverse[one[inverse] != ids]] = True
    return out


def least_of(inverse: np.ndarray, n: int, ids: np.ndarray) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, inverse, ids)
    return out


def repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", pack_mb: float = 2, bucket_mb: float = 16) -> DataFrame:
    """``docs`` with ``n_words``, ``cut_from``, ``cut_to`` (half-open word spans of the repeats) and ``kept`` (words left, joined by one space).

    ``pack_mb`` and ``bucket_mb`` bound what a worker holds at a time; no result depends on them.
    """
    size = (window + 1) // 2
    added = [T.StructField("n_words", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("cut_from", "cut_to")], T.StructField("kept", T.StringType())]
    own = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    docs = docs.select(*[docs[f.name] for f in own])
    at, pack_col = layout(docs, text_col, pack_mb, bucket_mb), fresh(docs, "pack")
    dealt = packed(docs, at, pack_col, id_col, text_col)
    n_buckets = at.buckets

    def probe(table: pa.Table) -> pa.Table:
        p = Pack(table, id_col, text_col)
        _, _, keys, several, reference = p.blocks(size)
        return offer(table[pack_col][0].as_py(), keys, several, reference, n_buckets)

    def extend(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table) or not len(found):
            return blobs([])
        p = Pack(table, id_col, text_col)
        at, inverse, keys, _, _ = p.blocks(size)
        hit = np.zeros(len(p.hashes) + 1, np.int32)
        hit[at] = answers(found, keys, n_buckets)[inverse]
        before = np.concatenate([[0], np.cumsum(hit)])
        at, keys = p.stretches(window)
        near = before[at + window - size + 1] > before[at]
        at, keys = at[near], keys[near]
        distinct, inverse = np.unique(keys, return_inverse=True)
        ids = p.ids[p.doc[at]]
        several, least = differ(inverse, len(distinct), ids), least_of(inverse, len(distinct), ids)
        pack = table[pack_col][0].as_py()
        return blobs([(b, pack, distinct[lo:hi].tobytes(), planes(least[lo:hi]), np.packbits(several[lo:hi]).tobytes()) for b, lo, hi in pieces(distinct, n_buckets)])

    def first_owner(table: pa.Table) -> pa.Table:
        trim()
        packs, bucket = table["pack"].to_pylist(), table["bucket"][0].as_py()
        keys = [np.frombuffer(x, np.uint64) for x in table["x"].to_pylist()]
        least = np.concatenate([unplanes(y, np.int64) for y in table["y"].to_pylist()])
        several = np.concatenate([np.unpackbits(np.frombuffer(z, np.uint8), count=len(k)).view(bool) for z, k in zip(table["z"].to_pylist(), keys)])
        n, every = np.array([len(k) for k in keys]), np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        key = every[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        share = (count > 1) | np.logical_or.reduceat(several[order], first)
        owner, told = np.empty(len(key), np.int64), np.empty(len(key), bool)
        owner[order], told[order] = np.repeat(np.minimum.reduceat(least[order], first), count), np.repeat(share, count)
        out, lo = [], 0
        for pack, k in zip(packs, n.tolist()):
            pick = np.flatnonzero(told[lo : lo + k]) + lo
            if len(pick):
                out.append((bucket, pack, every[pick].tobytes(), planes(owner[pick]), None))
            lo += k
        return blobs(out)

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table):
            return schema_table([])
        p = Pack(table, id_col, text_col)
        gone = np.zeros(len(p.hashes) + 1, np.int32)
        if len(found):
            rows = found.sort_by("bucket")
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["x"].to_pylist()])
            owner = np.concatenate([unplanes(y, np.int64) for y in rows["y"].to_pylist()])
            at, own = p.stretches(window)
            slot = np.searchsorted(keys, own)
            slot[slot == len(keys)] = 0
            covered = (keys[slot] == own) & (owner[slot] < p.ids[p.doc[at]])
            np.add.at(gone, at[covered], 1)
            np.add.at(gone, at[covered] + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        lo, hi = [], []
        kept: list = []
        for i, (a, b) in enumerate(zip(p.start.tolist(), p.end.tolist())):
            mask, words = gone[a:b], p.texts[i].split()
            x = y = np.zeros(0, np.int64)
            if mask.any():
                x, y = runs(mask)
                words = [w for w, g in zip(words, mask.tolist()) if not g]
            lo.append(x.tolist())
            hi.append(y.tolist())
            kept.append(b" ".join(words))
        return schema_table([*[p.table[f.name].combine_chunks() for f in own_fields], pa.array(p.counts, pa.int64()), pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())])

    own_fields = own
    schema = T.StructType([*own, *added])

    def schema_table(columns: list) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        if not columns:
            return arrow.empty_table()
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=arrow.names)

    asked = dealt.groupBy(pack_col).applyInArrow(probe, BLOB)
    found = asked.groupBy("bucket").applyInArrow(mark_shared(n_buckets), BLOB)
    windows = dealt.groupBy(pack_col).cogroup(found.withColumnRenamed("pack", pack_col).groupBy(pack_col)).applyInArrow(extend, BLOB)
    owners = windows.groupBy("bucket").applyInArrow(first_owner, BLOB)
    return dealt.groupBy(pack_col).cogroup(owners.withColumnRenamed("pack", pack_col).groupBy(pack_col)).applyInArrow(finish, schema)


def dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", pack_mb: float = 1, bucket_mb: float = 6) -> DataFrame:
    """``docs`` whose texts lost their repeated windows: what stays keeps its own spacing; texts without repeats stay as they are.  A text that loses all its words goes."""
    own = [f for f in docs.schema.fields if f.name not in ("n_words", "cut_from", "cut_to", "kept")]
    out = repeats(docs, window, id_col, text_col, pack_mb, bucket_mb)
    changed = F.size("cut_from") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col(text_col))
    return out.where(~changed | (F.octet_length("kept") > 0)).select(*[text.alias(f.name) if f.name == text_col else F.col(f.name) for f in own])
