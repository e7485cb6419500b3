"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct pre-tokens of a slice of texts are grouped by length into padded
matrices.  In every round each row looks up the ranks of its adjacent pairs in
a hash table, merges its leftmost pair of minimum rank, and is compacted by
one column; rows without a mergeable pair leave the matrix.  Pre-tokens over
``LONG`` bytes take the same merges from a heap, which keeps them n log n.

Defined results: null or empty text gives no ids and decodes to empty bytes;
equal texts give equal ids; other columns pass through unchanged.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import MB, ranges, text_slices, tidy, trim

LONG = 256
NONE = np.int32(2**31 - 1)
#: Entries of the pre-token cache of one worker.
CACHE = 80_000
#: Tokens decoded at a time.
TOKENS = 100_000


class Codec:
    """Ranks of one vocabulary as flat arrays."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.token_len = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self._hash(np.array([a * self.size + b for a, b in pairs], dtype=np.int64), np.array([*pairs.values()], dtype=np.int32))
        self.cache: dict[str, int] = {}
        self._reset()
        del ranks, tokens, pairs
        trim()

    def _reset(self) -> None:
        self.cache.clear()
        self.pool, self.pool_len, self.pool_at, self.pool_size = [], [], [], 0

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32), 0
        left = np.arange(len(keys))
        while len(left):
            at = (self._slot(keys[left]) + self.probes) & self.mask
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.values[at[placed]] = keys[left[placed]], values[left[placed]]
            left = np.delete(left, placed)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE where there is none."""
        keys = a.astype(np.int64) * self.size + b
        at = self._slot(keys)
        found, out = self.keys[at], self.values[at].copy()
        miss = np.flatnonzero((found != keys).ravel())
        flat = out.reshape(-1)
        flat[miss] = NONE
        miss = miss[found.reshape(-1)[miss] >= 0]
        keys, at = keys.reshape(-1), at.reshape(-1)
        for step in range(1, self.probes):
            if not len(miss):
                break
            slot = (at[miss] + step) & self.mask
            seen = self.keys[slot]
            hit = seen == keys[miss]
            flat[miss[hit]] = self.values[slot[hit]]
            miss = miss[~hit & (seen >= 0)]
        return out

    def _merge_matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """ids of each row of an (n, L) matrix of single-byte ids."""
        out: list = [None] * len(rows)
        who = np.arange(len(rows))
        pairs = self.pair_ranks(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else np.zeros((len(rows), 0), np.int32)
        while len(who):
            width = rows.shape[1]
            best = pairs.argmin(axis=1) if width > 1 else np.zeros(len(who), np.int64)
            rank = pairs[np.arange(len(who)), best] if width > 1 else np.full(len(who), NONE)
            done = rank == NONE
            if done.any():
                for i, ids in zip(who[done].tolist(), rows[done]):
                    out[i] = ids
                live = ~done
                who, rows, pairs, best, rank = who[live], rows[live], pairs[live], best[live], rank[live]
                if not len(who):
                    break
            n = np.arange(len(who))
            rows[n, best] = rank
            keep = np.ones(rows.shape, bool)
            keep[n, best + 1] = False
            rows = rows[keep].reshape(len(who), width - 1)
            keep = np.ones(pairs.shape, bool)
            keep[n, best] = False
            pairs = pairs[keep].reshape(len(who), width - 2)
            if width > 2:
                has = np.flatnonzero(best > 0)
                pairs[has, best[has] - 1] = self.pair_ranks(rows[has, best[has] - 1], rows[has, best[has]])
                has = np.flatnonzero(best < width - 2)
                pairs[has, best[has]] = self.pair_ranks(rows[has, best[has]], rows[has, best[has] + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        rank = self.pair_ranks(ids[:-1], ids[1:])
        ids, after, before = ids.tolist(), list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap = [(r, i) for i, r in enumerate(rank.tolist()) if r != NONE]
        heapq.heapify(heap)
        current = dict((i, r) for r, i in heap)

        def again(i: int) -> None:
            j = after[i]
            current.pop(i, None)
            if j < len(ids):
                r = int(self.pair_ranks(np.array([ids[i]]), np.array([ids[j]]))[0])
                if r != NONE:
                    current[i] = r
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if current.get(i) != r:
                continue
            j = after[i]
            ids[i], after[i] = r, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            current.pop(j, None)
            ids[j] = -1
            again(i)
            if before[i] >= 0:
                again(before[i])
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new distinct pre-tokens and put them into the pool."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            by_length.setdefault(len(b) if len(b) <= LONG else 0, []).append((p, b))
        for length, own in by_length.items():
            if length:
                found: list[np.ndarray] = []
                step = max(1, MB // length)
                for i in range(0, len(own), step):
                    raw = b"".join(b for _, b in own[i : i + step])
                    found += self._merge_matrix(self.single[np.frombuffer(raw, np.uint8)].reshape(-1, length))
            else:
                found = [self._merge_long(b) for _, b in own]
            for (p, _), ids in zip(own, found):
                self.cache[p] = len(self.pool_len)
                self.pool.append(ids)
                self.pool_len.append(len(ids))
                self.pool_at.append(self.pool_size)
                self.pool_size += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        if len(self.cache) > CACHE:
            self._reset()
        pieces, counts, find = [], [], self.pattern.findall
        for t in texts:
            own = find(t) if t else []
            counts.append(len(own))
            pieces += own
        self._learn([p for p in dict.fromkeys(pieces) if p not in self.cache])
        at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        flat = np.concatenate(self.pool) if self.pool else np.zeros(0, np.int32)
        self.pool = [flat]
        length = np.array(self.pool_len, dtype=np.int64)[at] if len(at) else np.zeros(0, np.int64)
        ids = flat[ranges(np.array(self.pool_at, dtype=np.int64)[at], length)] if len(at) else flat[:0]
        ends = np.concatenate([[0], np.cumsum(length)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all sequences, bytes per sequence)."""
        length = self.token_len[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.token_bytes[ranges(self.token_at[ids], length)], np.diff(ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col`` (array<int>); an existing column of that name is replaced."""
    rest = [f for f in docs.schema.fields if f.name != ids_col]
    schema = T.StructType([*rest, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            trim()
            for part in text_slices(batch, text_col, MB // 2):
                ids, counts = own.encode(part.column(part.schema.get_field_index(text_col)).to_pylist())
                column = pa.ListArray.from_arrays(_offsets(counts), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[f.name for f in schema.fields])

    return docs.select(*[docs[f.name] for f in rest]).mapInArrow(work, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col`` (binary): the bytes that ``ids_col`` stands for."""
    rest = [f for f in docs.schema.fields if f.name != out_col]
    schema = T.StructType([*rest, T.StructField(out_col, T.BinaryType(), False)])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            trim()
            sizes = np.array([x or 0 for x in pc.list_value_length(batch.column(batch.schema.get_field_index(ids_col))).to_pylist()], dtype=np.int64)
            edge = np.flatnonzero(np.diff(np.cumsum(sizes) // TOKENS)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(batch)]):
                part, counts = batch.slice(lo, hi - lo), sizes[lo:hi]
                lists = part.column(part.schema.get_field_index(ids_col))
                flat, n_bytes = own.decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), counts)
                column = pa.Array.from_buffers(pa.binary(), len(part), [None, _offsets(n_bytes).buffers()[1], pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[f.name for f in schema.fields])

    return docs.select(*[docs[f.name] for f in rest]).mapInArrow(work, schema)
