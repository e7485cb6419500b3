"""Benchmark decontamination with a generalised suffix automaton of test items.

Item words (lower-cased, cut at every ASCII character that is no letter or
digit) go into one automaton, item by item; every state keeps the items whose
words pass through it.  Training documents stream through it word by word: the
automaton gives, at each word, the longest suffix that is a factor of an item.
A match of ``window`` words or more hits all its words; so does a whole item
that is shorter than a window.

Words that no item has, and neighbours that no item has side by side, end any
match; a vectorised test of those leaves only the stretches that the automaton
must walk, which changes no result.

The items go in blocks of bounded size (``block_words``), each a broadcast of
its own; documents are read once per block, and what the blocks hit in a row is
united before anything is counted or cut, so that the block size changes no
result.  Null text has no words.  Items without words, and repeated items, are
allowed (each item keeps its own id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, runs, tidy

#: Internal columns; columns of these names in the input are not allowed.
ROW, FROM, TO = "_row", "_from", "_to"
MARKS = "n_words long, longest long, hit_from array<long>, hit_to array<long>, item_ids array<long>"

#: ASCII bytes that are neither digits nor lower-case letters become spaces.
FOLD = bytes(32 if i < 0x30 or 0x39 < i < 0x61 or 0x7A < i < 0x80 else i for i in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over integer word codes."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, last: int, code: int) -> int:
        """State after ``code`` behind state ``last``; sequences start at state 0."""
        old = self.next[last].get(code)
        if old is not None:
            return old if self.length[old] == self.length[last] + 1 else self._clone(last, code, old)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][code]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._clone(at, code, old)
        return new

    def _state(self, follow: dict[int, int], length: int, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _clone(self, at: int, code: int, old: int) -> int:
        new = self._state(dict(self.next[old]), self.length[at] + 1, self.link[old])
        self.link[old] = new
        while at >= 0 and self.next[at].get(code) == old:
            self.next[at][code] = new
            at = self.link[at]
        return new


class Index:
    """Automaton of one block of items, with what the documents need to know of it."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.sam = sam = Automaton()
        coded = [(i, [self.codes.setdefault(w, len(self.codes) + 1) for w in ws]) for i, ws in items if ws]
        ends: list[tuple[int, int, list[int]]] = []
        for i, ws in coded:
            at = 0
            for c in ws:
                at = sam.add(at, c)
            ends.append((i, at, ws))
        self.least = min([window, *(len(ws) for _, ws in coded)])
        # items of each state: walk every item again, and up the links to what no prefix of it has reached yet
        self.items: list[set[int]] = [set() for _ in sam.link]
        self.short: dict[int, set[int]] = {}
        for i, _, ws in ends:
            at = 0
            for c in ws:
                at = sam.next[at][c]
                up = at
                while up > 0 and i not in self.items[up]:
                    self.items[up].add(i)
                    up = sam.link[up]
            if len(ws) < window:
                self.short.setdefault(at, set()).add(i)
        self.short_length = {at: min(len(ws) for i, s, ws in ends if s == at and i in own) for at, own in self.short.items()}
        pairs = {(a, b) for _, ws in coded for a, b in zip(ws, ws[1:])}
        self.width = len(self.codes) + 2
        self.pairs = np.sort(np.array([a * self.width + b for a, b in pairs], dtype=np.int64))

    def match(self, tokens: list[bytes]) -> tuple[np.ndarray, set[int], int]:
        """(hit flag per word, ids of items with occurring windows, longest match) of one document."""
        hit, found, longest = np.zeros(len(tokens), bool), set(), 0
        known = np.fromiter((self.codes.get(t, 0) for t in tokens), np.int64, len(tokens))
        if self.least == 1:
            stretch = known > 0
            joined = stretch
            lo, hi = runs(joined)
        else:
            key = known[:-1] * self.width + known[1:]
            at = np.searchsorted(self.pairs, key)
            joined = np.append(self.pairs, -1)[at] == key
            lo, hi = runs(joined)
            hi = hi + 1
            keep = hi - lo >= self.least
            lo, hi = lo[keep], hi[keep]
        sam = self.sam
        for a, b in zip(lo.tolist(), hi.tolist()):
            state = size = 0
            for p in range(a, b):
                c = int(known[p])
                while state and c not in sam.next[state]:
                    state = sam.link[state]
                    size = sam.length[state]
                if c in sam.next[state]:
                    state, size = sam.next[state][c], size + 1
                longest = max(longest, size)
                if size >= self.window:
                    hit[p - size + 1 : p + 1] = True
                    up = state
                    while sam.length[sam.link[up]] >= self.window:
                        up = sam.link[up]
                    found |= self.items[up]
                if self.short:
                    up = state
                    while up > 0:
                        if up in self.short and (up != state or size >= self.short_length[up]):
                            hit[p - self.short_length[up] + 1 : p + 1] = True
                            found |= self.short[up]
                        up = sam.link[up]
        return hit, found, longest


@dataclass(frozen=True)
class Found:
    n_words: int
    hit: np.ndarray
    items: set[int]
    longest: int


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of items in order of id, read one partition at a time; a single item may exceed the bound by itself."""
    own: list[tuple[int, bytes]] = []
    size = 0
    for r in items.toLocalIterator():
        own.append((r["item_id"], bytes(r["text"] or b"")))
        size += len(own[-1][1]) // 2 + 1
        if size >= block_words:
            yield own
            own, size = [], 0
    if own:
        yield own


def _split(items: DataFrame, block_words: int) -> tuple[list[tuple[int, bytes]], Iterator[list[tuple[int, bytes]]] | None]:
    """(the only block, None), or (no items, all blocks) if there are several."""
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.encode("text", "UTF-8").alias("text"))
    blocks = _blocks(plain, block_words)
    first, second = next(blocks, []), next(blocks, None)
    return (first, None) if second is None else ([], chain([first, second], blocks))


def _index(docs: DataFrame, block: list[tuple[int, bytes]], window: int) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(Index([(i, words(t)) for i, t in block], window))


def _marks(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """First column of ``rows`` (a long; the second is the text) with what one block hits in each row."""
    key = rows.columns[0]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: Index = shared.value
            n_words, longest, lo, hi, found = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                own = words(text.as_py())
                hit, ids, most = index.match(own)
                a, b = runs(hit)
                n_words.append(len(own))
                longest.append(most)
                lo.append(a.tolist())
                hi.append(b.tolist())
                found.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(longest, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (lo, hi, found)]],
                names=[key, "text", "n_words", "longest", "hit_from", "hit_to", "item_ids"],
            )

    return rows.mapInArrow(work, f"{key} long, text string, {MARKS}")


def _merged(rows: DataFrame, blocks: Iterator[list[tuple[int, bytes]]], window: int) -> DataFrame:
    """What all blocks together hit in each row of ``rows`` (``_row``, text), every block matched on the text as it came in."""
    parts = [_marks(rows, _index(rows, block, window)).drop("text") for block in blocks]
    several = reduce(DataFrame.unionAll, [parts[0], *(p.where("longest > 0") for p in parts[1:])])
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    spans = F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to"))).alias("_spans")
    merged = several.groupBy(ROW).agg(F.max("n_words").alias("n_words"), F.max("longest").alias("longest"), spans, flat("item_ids"))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = [], []
            for n, own in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                hit = np.zeros(n, bool)
                for s in own:
                    hit[s["hit_from"] : s["hit_to"]] = True
                a, b = runs(hit)
                lo.append(a.tolist())
                hi.append(b.tolist())
            arrays = [*batch.columns[:3], *[pa.array(x, pa.list_(pa.int64())) for x in (lo, hi)], batch.column(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=[ROW, "n_words", "longest", "hit_from", "hit_to", "item_ids"])

    united = merged.select(ROW, "n_words", "longest", "_spans", F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))
    return united.mapInArrow(work, f"{ROW} long, {MARKS}")


def hits(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 2_000_000, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_words, longest, hit_from, hit_to, item_ids): word spans and items, one row per document row.

    ``hit_from``/``hit_to`` are half-open word positions; ``item_ids`` are
    those with occurring windows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    only, blocks = _split(items, block_words)
    if blocks is None:
        return _marks(rows, _index(docs, only, window))
    rows = cut(rows.withColumn(ROW, F.monotonically_increasing_id()))
    return rows.join(_merged(rows.select(ROW, "text"), blocks, window), ROW).drop(ROW)


def clean(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", block_words: int = 2_000_000) -> DataFrame:
    """``docs`` without the spans that match ``window`` item words or more.

    A span runs from the first byte of its first word to the last byte of its
    last word.  A document of which more than ``max_coverage`` of all words
    are hit goes as a whole.  Columns stay as they are; null texts stay null.
    """
    names = docs.columns
    only, blocks = _split(items, block_words)
    if blocks is None:
        shared, rows = _index(docs, only, window), docs
    else:
        keyed = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
        marks = _merged(keyed.select(ROW, F.col(text_col).alias("text")), blocks, window).where(F.size("hit_from") > 0)
        shared, rows = None, keyed.join(marks.select(ROW, F.col("hit_from").alias(FROM), F.col("hit_to").alias(TO)), ROW, "left").select(*[keyed[c] for c in names], FROM, TO)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(text_col)
            spans = zip(*(batch.column(len(names) + k).to_pylist() for k in range(2))) if shared is None else repeat(None)
            keep, texts = [], []
            for i, (text, span) in enumerate(zip(batch.column(at).cast(pa.binary()).to_pylist(), spans)):
                own = words(text)
                if shared is None:
                    hit = np.zeros(len(own), bool)
                    for a, b in zip(span[0] or [], span[1] or []):
                        hit[a:b] = True
                else:
                    hit = shared.value.match(own)[0]
                if hit.any():
                    if hit.mean() > max_coverage:
                        continue
                    text = cut_words(text, hit)
                keep.append(i)
                texts.append(text)
            columns = [*batch.take(pa.array(keep, pa.int64())).columns][: len(names)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(work, docs.schema)


def cut_words(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its runs of hit words."""
    plain = np.frombuffer(text.lower().translate(FOLD), np.uint8)
    starts, ends = runs(~np.isin(plain, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)))
    out, at = [], 0
    for a, b in zip(*(x.tolist() for x in runs(hit))):
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join(out) + text[at:]
