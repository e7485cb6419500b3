"""Language-model scores by online logistic context mixing over bits of words.

A text is its words, lower-cased in A-Z, then one end.  Every word of the
training texts has a code of its own, of any number of words: the ``top`` most
frequent ones are symbols of a Huffman code, in which all others fall into
classes by bits of their hash; inside its class a word has a Huffman code of
that class, where one leaf stands for all unknown words (it weighs as much as
the words seen once).  A word is coded as the bits of its symbol, then those
inside its class, each at a node of a tree.  Every bit is predicted by several
models: node alone; node with what stands before, hashed into tables of fixed
size (symbol before, two symbols before and the three last frequent words;
inside classes the word before, the two words before and the three last
frequent words, in tables of their own); and node within this text so far.
Their log odds are combined with weights that a gate (how much the hashed
contexts have seen; inside classes also how often the text was at the node)
selects; weights adapt to the text block by block, and an adaptive map from
predicted to observed odds refines the result.  Only words that no learned
text has share a code; the text so far tells those of a class apart.  All this
is causal: a word's probability depends on what precedes it (adaptation: on
earlier blocks).

Gathering: each pack sends its distinct word keys and counts to the buckets of
their classes, which sum them, code the words of their class, and answer with
corpus counts and codes, so that no vocabulary is ever in one place.  The
frequent words (a fixed number), a total per class (a class for each bucket,
``classes`` at least) and the context tables (of fixed size, summed from every
training text) are broadcast.  A text of more than a slice of tokens is scored
on its own.

Word keys are 64-bit hashes.  Defined results: null text has the end alone;
with nothing to learn from all counts are 0; a null id is neither held out nor
learned from; equal texts get equal scores, whatever stands beside them;
repeated rows keep their row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOB, blobs, cut, fresh, hash_words, layout, mix64, ordered, pack_of, packed, planes, ranges, tidy, unplanes, words_at

#: Key of the end of a text; no word has it, as words are not empty.
END = np.uint64(0x5851F42D4C957F2D)
TABLE_BITS = 20
CONTEXTS = 3
#: Bits of one text between two updates of its weights: few at first.
FIRST, BLOCK = (48, 96, 192, 384), 512
INPUTS = CONTEXTS + 3  # node, hashed contexts, this text, bias
GATES = 16
#: First weights inside classes, by how often the text was at the node.
INNER_FIRST = ([0.2, 0.2, 0.2, 0.2, 0.2, 0], [0, 0.1, 0.1, 0.1, 0.7, 0], [0, 0.1, 0.1, 0.1, 0.7, 0], [0, 0.1, 0.1, 0.1, 0.7, 0])
#: What this text has seen is added to so many bits as the contexts foretell: of frequent words and classes, inside classes.
PRIOR, INNER_PRIOR = 6, 0.5
CHUNK = 1 << 16
#: Numbers hashed at a time: they stay in a core's cache.
PIECE = 1 << 13
SUMS = "chunk int, part int, sums binary"
#: Counts of a context: two for each slot, of frequent words and classes, then inside classes.
SLOTS = 4 << TABLE_BITS


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words and ends of all texts, tokens per text)."""
    data, start, end, counts = words_at([t.lower() for t in texts])
    return np.insert(hash_words(data, start, end), np.cumsum(counts), END), counts + 1


@dataclass
class Code:
    """Huffman code of the symbols: the frequent words, then the classes of all others (``Tails`` go on inside those)."""

    keys: np.ndarray  # of the frequent words, sorted
    length: np.ndarray
    node: np.ndarray  # (symbols, longest)
    bit: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> Code:
        """``rest``: tokens of the words of each class."""
        order = np.argsort(keys)
        keys, weights = keys[order], [*counts[order].tolist(), *(rest + 1).tolist()]
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        new = n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i], up[j] = (new, 0), (new, 1)
            heapq.heappush(heap, (a + b, new))
            new += 1
        paths = []
        for i in range(n):
            path = []
            while i in up:
                i, b = up[i]
                path.append((i - n, b))
            paths.append(path[::-1])
        most = max(map(len, paths))
        node, bit = np.zeros((n, most), np.int32), np.zeros((n, most), bool)
        for i, path in enumerate(paths):
            for j, (v, b) in enumerate(path):
                node[i, j], bit[i, j] = v, b
        return cls(keys, np.array([len(p) for p in paths], dtype=np.int64), node, bit)

    @property
    def classes(self) -> int:
        return len(self.length) - len(self.keys)

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        own = len(self.keys) + class_of(keys, self.classes)
        if not len(self.keys):
            return own
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, own)


def class_of(keys: np.ndarray, classes: int) -> np.ndarray:
    return (keys % np.uint64(classes)).astype(np.int64)


def climb(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman code of some leaves: (length, bits of each as a number, share of the side 1 at every node passed, leaf by leaf); shares in 256 steps from a half."""
    n = len(weights)
    order = np.argsort(weights, kind="stable")
    leaf, made, up, side = weights[order].tolist(), [], np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint64)
    i = j = 0
    light, heavy = [], []
    for _ in range(n - 1):  # the two lightest are at the heads of two ascending queues
        pair = []
        for _ in range(2):
            if j >= len(made) or i < n and leaf[i] <= made[j]:
                pair.append(i)
                i += 1
            else:
                pair.append(n + j)
                j += 1
        a, b = pair
        light.append(a)
        heavy.append(b)
        made.append((leaf[a] if a < n else made[a - n]) + (leaf[b] if b < n else made[b - n]))
    up[light], up[heavy], side[heavy] = np.arange(n, 2 * n - 1), np.arange(n, 2 * n - 1), 1
    weight = np.array(leaf + made, np.float64)
    share = np.zeros(2 * n - 1, np.uint8)
    share[n:] = np.minimum((weight[heavy] / weight[n:] - 0.5) * 512, 255)
    at, length, code = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    steps = []
    going = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    while len(going):
        code[going] |= side[at[going]] << length[going].astype(np.uint64)
        at[going] = up[at[going]]
        steps.append((going, at[going]))
        length[going] += 1
        going = going[at[going] < 2 * n - 2]
    ends = np.cumsum(length)
    passed = np.zeros(int(length.sum()), np.uint8)
    for k, (who, node) in enumerate(steps):
        passed[ends[who] - 1 - k] = share[node]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return length[back], code[back], passed[ranges((ends - length)[back], length[back])]


@dataclass
class Tails:
    """What codes some distinct words inside their classes, one after the other."""

    length: np.ndarray
    code: np.ndarray
    share: np.ndarray

    def pick(self, words: np.ndarray) -> Tails:
        start = np.cumsum(self.length) - self.length
        return Tails(self.length[words], self.code[words], self.share[ranges(start[words], self.length[words])])


def inner_codes(sums: np.ndarray, frequent: np.ndarray) -> tuple[Tails, np.ndarray]:
    """Huffman code of the words of a class by their counts, with one leaf for all unknown words: (its leaves, the leaf of each word).  Frequent words need none."""
    known = np.flatnonzero((sums > 0) & ~frequent)
    length, code, share = climb(np.concatenate([[max(1, int((sums[known] == 1).sum()))], sums[known]]))
    leaf = np.zeros(len(sums), np.int64)
    leaf[known] = np.arange(1, len(known) + 1)
    leaf[frequent] = len(length)
    return Tails(np.append(length, 0), np.append(code, np.uint64(0)), share), leaf


def by_class(distinct: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order of sorted keys by class, then key; (class, start, end) in it of the classes that have any)."""
    own = class_of(distinct, classes)
    order = by_number(own)
    own = own[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return order, list(zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)]))


@dataclass
class Paths:
    """The nodes inside classes that some distinct words pass, one word after the other."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    base: np.ndarray  # log odds of the node alone

    @classmethod
    def of(cls, symbols: np.ndarray, tails: Tails) -> Paths:
        start = np.cumsum(tails.length) - tails.length
        total = int(tails.length.sum())
        node, bit = np.empty(total, np.uint32), np.empty(total, bool)
        step = max(1, PIECE * len(symbols) // max(total, 1))  # words whose bits make about a piece
        for lo in range(0, len(symbols), step):
            length = tails.length[lo : lo + step]
            a, z = start[lo], start[lo] + length.sum()
            left = np.repeat((start[lo : lo + step] + length - a).astype(np.uint64), length)
            left -= np.arange(z - a, dtype=np.uint64)  # bits from this one on
            before = np.repeat(tails.code[lo : lo + step] | np.uint64(1) << length.astype(np.uint64), length)
            before >>= left
            node[a:z] = inner_node(np.repeat(symbols[lo : lo + step], length), before)
            left -= np.uint64(1)
            np.not_equal(np.repeat(tails.code[lo : lo + step], length) >> left & np.uint64(1), 0, out=bit[a:z])
        return cls(start, tails.length, node, bit, ODDS.take(tails.share))


def inner_node(symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Number of the node inside class ``symbol`` that the bits ``before``, after a leading 1, lead to."""
    return (mix64(symbol.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + before * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Bits:
    """Coded bits of some texts, token by token: bits per token, node, bit and slots of the hashed contexts."""

    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    base: np.ndarray | None = None  # inside classes: log odds of the node alone

    @classmethod
    def of(cls, code: Code, symbols: np.ndarray, tokens: np.ndarray) -> Bits:
        """Of the symbols."""
        length = code.length[symbols]
        at = ranges(symbols * code.node.shape[1], length)
        node = code.node.reshape(-1).take(at, mode="clip")
        return cls(length, node, code.bit.reshape(-1).take(at, mode="clip"), slots_of([*previous(symbols.astype(np.uint64), tokens), last_frequent(code, symbols, tokens)], length, node.astype(np.uint64)))

    @classmethod
    def inside(cls, code: Code, symbols: np.ndarray, tokens: np.ndarray, paths: Paths, words: np.ndarray, keys: np.ndarray) -> Bits:
        """Of the words inside their classes: ``words`` are their numbers in ``paths``."""
        length = paths.length[words]
        at = ranges(paths.start[words], length)
        node = paths.node.take(at, mode="clip")
        return cls(length, node, paths.bit.take(at, mode="clip"), slots_of([*previous(keys, tokens), last_frequent(code, symbols, tokens)], length, node.astype(np.uint64)), paths.base.take(at, mode="clip"))


def previous(number: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the number before, and of the two before, in the same text."""
    one = np.empty_like(number)
    one[1:] = number[:-1] + np.uint64(1)
    begin = np.cumsum(tokens) - tokens
    one[begin] = 0
    two = np.empty_like(number)
    two[1:] = one[:-1]
    two[begin] = 0
    one *= np.uint64(0x9FB21C651E98DF25)
    return one, one + two * np.uint64(0xE7037ED1A0B428DB)


def last_frequent(code: Code, symbols: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Hash of the last three frequent words of the same text."""
    own = symbols < len(code.keys)
    before = np.cumsum(own) - own  # frequent words before each token
    first = np.repeat(before[np.cumsum(tokens) - tokens], tokens)
    value = np.concatenate([np.zeros(3, np.uint64), symbols[own].astype(np.uint64) + np.uint64(1)])
    out = np.zeros(len(symbols), np.uint64)
    for back, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0xD6E8FEB86659FD93)):
        out += value[before + 3 - back] * (before - back >= first) * np.uint64(odd)
    return out


def slots_of(contexts: list[np.ndarray], length: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """Upper bits of ``mix64`` of each context and the node (its last step does not reach them)."""
    node *= np.uint64(0xA24BAED4963EE407)
    t, out = np.empty_like(node), []
    for c in contexts:
        x = np.repeat(c, length)
        x += node
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(x, np.uint64(shift), out=t)
            x ^= t
            x *= np.uint64(odd)
        x >>= np.uint64(64 - TABLE_BITS)
        out.append(x.view(np.int64))
    return out


@dataclass
class Model:
    code: Code
    known_tokens: int
    known_words: int
    mass: np.ndarray  # of the words of each class, and of one unknown word
    node_odds: np.ndarray
    seen: np.ndarray  # (contexts, slots): share of the slot's own odds to take, by what was seen, and those odds times it, as one number

    inner_seen: np.ndarray | None = None  # the same of nodes inside classes

    @classmethod
    def build(cls, code: Code, known_tokens: int, known_words: int, class_tokens: np.ndarray, class_words: np.ndarray, node_counts: np.ndarray, counts: np.ndarray, inner_counts: np.ndarray | None = None) -> Model:
        """``class_tokens``, ``class_words``: of the words without a code of their own."""
        share = (node_counts[:, 1] + 0.4) / (node_counts.sum(axis=1) + 0.8)
        return cls(code, known_tokens, known_words, class_tokens + 0.5 * class_words + 0.5, odds(share).astype(np.float32), cls.pairs(counts), None if inner_counts is None else cls.pairs(inner_counts))

    @staticmethod
    def pairs(counts: np.ndarray) -> np.ndarray:
        out = np.empty(counts.shape, np.float32)
        for c, o in zip(counts, out):
            total = c.sum(axis=1)
            o[:, 0] = total / (total + 6)
            o[:, 1] = o[:, 0] * odds((c[:, 1] + 0.4) / (total + 0.8))
        return out.view(np.float64)[:, :, 0]

    def first_weights(self) -> np.ndarray:
        """(gates, inputs): contexts that have seen more weigh more; inside classes, what this text has seen."""
        w = np.zeros((2, 4, 4, INPUTS), np.float32)
        for a in range(4):  # symbol before
            for b in range(4):  # two symbols before
                w[0, a, b] = [0.0, 0.22 + 0.04 * a, 0.04 * b, 0.38 - 0.02 * (a + b), 0.4, 0]
        for a in range(4):  # times that the text was at the node
            for b in range(4):  # word before
                w[1, a, b] = INNER_FIRST[a]
        return w.reshape(2 * GATES, INPUTS)


def odds(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


#: Log odds of the side 1, by its share in 256 steps from a half.
ODDS = odds(0.5 + (np.arange(256) + 0.5) / 512).astype(np.float32)


def by_number(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers under 2^32: numpy sorts 16 bits by radix."""
    most = int(x.max()) if len(x) else 0
    order = np.argsort(x.astype(np.uint16), kind="stable")
    return order if most < 1 << 16 else order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]


def before_counts(key: np.ndarray, size: np.ndarray, flag: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each event, how many earlier events of its text have its key (under 2^32), and how many of those the flag.  ``size``: events of each text, which follow each other."""
    events = len(key)
    both = key.astype(np.uint64)  # number, place (under 2^31), flag: each text is sorted alone, which stays in a core's cache
    both <<= np.uint64(32)
    low = np.arange(0, 2 * events, 2, dtype=np.uint64)
    if flag is not None:
        low |= flag.view(np.uint8)
    both |= low
    ends = np.cumsum(size)
    for lo, hi in zip((ends - size).tolist(), ends.tolist()):
        if hi - lo > 1:
            both[lo:hi].sort()
    new = np.ones(events + 1, bool)
    high, low = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
    np.not_equal(high[1:], high[:-1], out=new[1:-1])
    new[ends] = True
    start = np.flatnonzero(new[:-1]).astype(np.int32)
    many = np.diff(start, append=np.int32(events))
    order = (low >> np.uint32(1)).astype(np.int64)
    n = np.empty(events, np.int32)
    n[order] = np.arange(events, dtype=np.int32) - np.repeat(start, many)
    if flag is None:
        return n, n
    low &= np.uint32(1)
    ones = np.cumsum(low, dtype=np.int32)
    ones -= low.view(np.int32)
    ones -= np.repeat(ones[start], many)
    m = np.empty(events, np.int32)
    m[order] = ones
    return n, m


def blocks(place: np.ndarray) -> np.ndarray:
    """Block of each bit by its place in its text."""
    begun = np.cumsum(FIRST)
    return np.where(place < begun[-1], np.searchsorted(begun, place, side="right"), len(FIRST) + (place - begun[-1]) // BLOCK)


def inputs(model: Model, b: Bits, size: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Gates; fills ``x`` with the log odds of every bit by each model, a row each.  ``size``: bits of each text."""
    n, ones = before_counts(b.node, size, b.bit)
    inner = b.base is not None
    base, prior = (b.base, np.float32(INNER_PRIOR)) if inner else (model.node_odds[b.node], np.float32(PRIOR))
    x[0], levels = base, []
    for j, s in enumerate(b.slots):
        pair = (model.inner_seen if inner else model.seen)[j].take(s, mode="clip").view(np.float32)
        trust = np.ascontiguousarray(pair[::2])
        if j < 2:
            level = (trust > np.float32(2.5 / 8.5)).view(np.uint8)
            for least in (29.5, 299.5):
                level = level + (trust > np.float32(least / (least + 6))).view(np.uint8)
            levels.append(level)
        trust *= base
        last = np.subtract(base, trust, out=x[j + 1])
        last += pair[1::2]
    against = np.exp(-last)
    some = prior / (1 + against)  # odds of the bit in this text so far
    against *= some
    against += n - ones
    some += ones
    some /= against
    np.log(some, out=x[CONTEXTS + 1])
    if inner:
        return np.minimum(n, 3).astype(np.uint8) * np.uint8(4) + levels[0] + np.uint8(GATES)
    return levels[0] * np.uint8(4) + levels[1]


def mix(model: Model, parts: list[Bits], tokens: np.ndarray, rate: float = 0.002) -> np.ndarray:
    """Natural log of the probability of the bits of every text; those of a token come part by part."""
    n_docs, begin = len(tokens), np.cumsum(tokens) - tokens
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), tokens)
    token_end = np.cumsum(sum(b.length for b in parts))
    text_end = token_end[np.cumsum(tokens) - 1]
    many = np.diff(text_end, prepend=0)
    number = blocks(np.arange(int(many.max()))).astype(np.int32)
    n_blocks = np.where(many > 0, number[np.maximum(many - 1, 0)] + 1, 0)
    first_cell = np.cumsum(n_blocks) - n_blocks
    cell_doc = np.repeat(np.arange(n_docs), n_blocks)
    cell_block = np.arange(len(cell_doc)) - first_cell[cell_doc]
    turn = np.argsort(cell_block, kind="stable")  # cells in the order of their blocks
    rank = np.empty(len(turn), np.int32)
    rank[turn] = np.arange(len(turn)) * (2 * GATES)
    place = token_end - sum(b.length for b in parts) - np.repeat(text_end - many, tokens)  # of the first bit of each token in its text
    size = int(token_end[-1])
    key, x, lo = np.empty(size, np.int32), np.empty((INPUTS - 1, size), np.float32), 0
    for b in parts:
        hi = lo + len(b.bit)
        own = np.repeat((place - np.cumsum(b.length) + b.length).astype(np.int32), b.length)
        own += np.arange(len(own), dtype=np.int32)
        own = number.take(own, mode="clip")
        own += np.repeat(first_cell[doc].astype(np.int32), b.length)
        np.add(rank.take(own, mode="clip"), inputs(model, b, np.add.reduceat(b.length, begin), x[:, lo:hi]), out=key[lo:hi])
        place = place + b.length
        lo = hi
    by = by_number(key)
    key = key.take(by)
    hit = np.concatenate([b.bit for b in parts]).take(by)
    y_, hit = hit.astype(np.float32), hit.astype(np.intp)
    x_ = np.empty((INPUTS, size), np.float32)
    for row, own in zip(x, x_):
        row.take(by, out=own, mode="clip")
    x_[CONTEXTS + 2] = 0.3
    del x
    new = np.ones(size, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    run_cell, run_gate = np.divmod(key[first], 2 * GATES)
    run_doc = cell_doc[turn][run_cell]
    run_key = run_doc * (2 * GATES) + run_gate  # weights of each run
    run_block = cell_block[turn][run_cell]
    run_more = run_block < n_blocks[run_doc] - 1  # another block of the text follows
    run_size = np.diff(np.append(first, size))
    weights = np.tile(model.first_weights(), (n_docs, 1))
    grid = 1 / (1 + np.exp(-np.linspace(-8, 8, 17)))
    refine = np.tile(grid.astype(np.float32), n_docs)
    run_edges = np.searchsorted(run_block, np.arange(int(cell_block.max()) + 2))
    edges, ends = run_edges.tolist(), np.append(first, size)[run_edges].tolist()
    all_more, any_more = (f.reduceat(run_more, run_edges[:-1]).tolist() for f in (np.logical_and, np.logical_or))
    out = np.empty(size, np.float32)
    for a, z, lo, hi, every, some in zip(edges, edges[1:], ends, ends[1:], all_more, any_more):
        own, weight, length = x_[:, lo:hi], run_key[a:z], run_size[a:z]
        t = np.repeat(weights.take(weight, axis=0).T, length, axis=1)
        t *= own
        t = np.add.reduce(t, axis=0)
        np.maximum(t, -12, out=t)
        np.minimum(t, 12, out=t)
        spot = np.maximum(t + 8, 0)
        np.minimum(spot, 15.999, out=spot)
        p = np.negative(t, out=t)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        low = np.floor(spot)
        spot -= low
        cell = low.astype(np.intp)
        shift = int(run_doc[a]) * 17  # runs of a block come text by text
        cell += np.repeat(run_doc[a:z] * 17 - shift, length)
        near = refine[shift : (int(run_doc[z - 1]) + 1) * 17]
        low = near.take(cell, out=low, mode="clip")
        high = near[1:].take(cell, mode="clip")
        high -= low
        high *= spot
        low += high
        low *= 0.4
        np.multiply(p, 0.6, out=high)
        np.add(low, high, out=out[lo:hi])
        if not some:
            continue
        np.subtract(y_[lo:hi], p, out=p)
        sums = np.add.reduceat(p * own, first[a:z] - lo, axis=1).T
        sums *= rate
        cell += spot > 0.5
        cell += cell
        cell += hit[lo:hi]
        if every:
            weights[weight] += sums
        else:
            more = run_more[a:z]
            weights[weight[more]] += sums[more]
            cell = cell[np.repeat(more, length)]
        count = np.bincount(cell, minlength=2 * len(near)).astype(np.float32).reshape(-1, 2)
        ones = count[:, 1]
        count = count[:, 0] + ones
        near += (ones - count * near) / (count + 12)
    np.maximum(out, 1e-6, out=out)
    np.minimum(out, 1 - 1e-6, out=out)
    y_ -= 1
    out += y_
    np.log(np.abs(out, out=out), out=out)
    return np.bincount(run_doc, np.add.reduceat(out, first, dtype=np.float64), n_docs)


def score_texts(model: Model, keys: np.ndarray, tokens: np.ndarray, counts: np.ndarray, paths: Paths | None = None, words: np.ndarray | None = None, symbols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, base score, known tokens) per text; ``counts`` are the corpus counts of the tokens, ``words`` their numbers in ``paths``."""
    begin = np.cumsum(tokens) - tokens
    base = np.log10((counts + 0.5) / (model.known_tokens + 0.5 * (model.known_words + 1)))
    symbols = model.code.symbols(keys) if symbols is None else symbols
    doc = np.repeat(np.arange(len(tokens), dtype=np.int32), tokens)
    parts = [Bits.of(model.code, symbols, tokens)]
    if paths is not None:
        parts.append(Bits.inside(model.code, symbols, tokens, paths, words, keys))
    log = mix(model, parts, tokens) if any(len(b.bit) for b in parts) else np.zeros(len(tokens))
    own = symbols - len(model.code.keys)
    rare = np.flatnonzero(own >= 0 if paths is None else (own >= 0) & (counts == 0))  # without a code of their own
    if len(rare):
        d, c = doc[rare], own[rare]
        _, word = np.unique(keys[rare], return_inverse=True)
        some = np.bincount(d, minlength=len(tokens))
        same, _ = before_counts(word, some)
        seen, again = before_counts(c, some, same > 0)
        turn = (again + 0.2) / (seen + 4.0) * (seen > 0)
        share = (counts[rare] + 0.5) / model.mass[c]
        log += np.bincount(d, np.log(turn * same / np.maximum(seen, 1) + (1 - turn) * share), len(tokens))
    return log / np.log(10), np.add.reduceat(base, begin), np.add.reduceat((counts > 0).astype(np.int64), begin)


def sparse(sums: np.ndarray) -> bytes:
    """A chunk of a table: where it is not zero, and the counts there; all counts if those are no more."""
    held = np.flatnonzero(sums)
    if 6 * len(held) < 4 * len(sums):
        return held.astype(np.uint16).tobytes() + planes(sums[held])
    return planes(sums)


def add_sparse(sums: np.ndarray, data: bytes) -> None:
    if len(data) == 4 * len(sums):
        sums += unplanes(data, np.int32)
    else:
        n = len(data) // 6
        sums[np.frombuffer(data, np.uint16, n)] += unplanes(data[2 * n :], np.int32)


def slices(tokens: np.ndarray, limit: int = 24_000) -> list[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` tokens each; a larger text stands alone."""
    out, lo, held = [], 0, 0
    for k, n in enumerate(tokens.tolist()):
        if k > lo and held + n > limit:
            out.append((lo, k))
            lo, held = k, 0
        held += n
    return [*out, (lo, len(tokens))] if len(tokens) else out


def score(docs: DataFrame, learn_from: Column, top: int = 255, classes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte``."""
    from pyspark.sql import types as T

    names = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType(), "bits_per_byte": T.DoubleType()}
    own = [f for f in docs.schema.fields if f.name not in names]
    learn, pack_col = fresh(docs, "learn"), fresh(docs, "pack")
    schema = T.StructType([*own, *[T.StructField(k, v) for k, v in names.items()]])
    rows = docs.select(*[docs[f.name] for f in own], F.coalesce(learn_from, F.lit(False)).alias(learn))
    at = layout(rows, text_col)
    dealt = packed(rows, at, pack_col, id_col, text_col)
    classes = max(classes, at.buckets)  # the bucket of a class holds its words and their code

    def count(table: pa.Table) -> pa.Table:
        _, texts, table = ordered(table, id_col, text_col)
        keys, tokens = stream(texts)
        used = np.repeat(table[learn].to_numpy(), tokens)
        distinct, inverse = np.unique(keys, return_inverse=True)
        n = np.bincount(inverse, used, len(distinct)).astype(np.int64)
        order, parts = by_class(distinct, classes)
        distinct, n = distinct[order], n[order]
        pack = table[pack_col][0].as_py()
        return blobs([(c, pack, distinct[lo:hi].tobytes(), planes(n[lo:hi]), None) for c, lo, hi in parts])

    def total(table: pa.Table) -> pa.Table:
        """Facts of a class (as pack -1), its words (-2), then which of them each pack has."""
        packs, bucket = table["pack"].to_pylist(), table["bucket"][0].as_py()
        parts = [np.frombuffer(x, np.uint64) for x in table["x"].to_pylist()]
        keys, n = np.concatenate(parts), np.concatenate([unplanes(y, np.int64) for y in table["y"].to_pylist()])
        distinct, inverse = np.unique(keys, return_inverse=True)
        sums = np.bincount(inverse, n, len(distinct)).astype(np.int64)
        answer = np.split(inverse.astype(np.int32), np.cumsum([len(p) for p in parts])[:-1])
        first = np.lexsort((distinct, -sums))[:top]
        first = first[sums[first] > 0]
        facts = np.array([sums.sum(), (sums > 0).sum(), (sums == 1).sum()], np.int64)
        return blobs([(bucket, -1, facts.tobytes(), distinct[first].tobytes(), sums[first].tobytes()), (bucket, -2, distinct.tobytes(), planes(sums), None), *[(bucket, p, planes(a), None, None) for p, a in zip(packs, answer)]])

    counted = cut(dealt.groupBy(pack_col).applyInArrow(count, BLOB).groupBy("bucket").applyInArrow(total, BLOB))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, np.int64)) for v in (x, y)], names=["key", "n"])

    stats = counted.where("pack = -1")
    facts = np.zeros((classes, 3), np.int64)
    for r in stats.select("bucket", "x").collect():  # a row per class
        facts[r["bucket"]] = np.frombuffer(r["x"], np.int64)
    known_tokens, known_words = int(facts[:, 0].sum()), int(facts[:, 1].sum())
    frequent = stats.select("y", "z").mapInArrow(unfold, "key long, n long").orderBy(F.desc("n"), "key").limit(top).collect()
    keys, n = np.array([r["key"] for r in frequent], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in frequent], dtype=np.int64)
    of = class_of(keys, classes)
    # of all other words; those seen once stand for the unknown ones
    held = facts[:, 0] + facts[:, 2] - np.bincount(of, n + (n == 1), classes).astype(np.int64)
    code = Code.build(keys, n, held)
    sc = docs.sparkSession.sparkContext
    shared_code = sc.broadcast(code)
    n_nodes = len(code.length) - 1

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each class get codes; every pack gets those of its words."""
        own_class, sums, tails, leaf = -1, None, None, None
        for batch in batches:
            out = []
            for bucket, pack, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if pack == -2:
                    own_class, words, sums = bucket, np.frombuffer(x, np.uint64), unplanes(y, np.int64)
                    tails, leaf = inner_codes(sums, np.isin(words, shared_code.value.keys))
                    continue
                if bucket != own_class:
                    raise ValueError("the words of a class must precede its packs")
                rank = unplanes(x, np.int32)
                t = tails.pick(leaf[rank])
                out.append((bucket, pack, planes(sums[rank]), t.length.astype(np.uint8).tobytes() + planes(t.code), t.share.tobytes()))
            if out:
                yield from blobs(out).to_batches()

    asked = cut(counted.where("pack != -1").mapInArrow(encode, BLOB)).withColumnRenamed("pack", pack_col)

    def read(texts: list[bytes], found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Tails]:
        """(keys, tokens per text, distinct keys, which of them each token is, their corpus counts, their codes) from the answers to a pack."""
        keys, tokens = stream(texts)
        distinct, inverse = np.unique(keys, return_inverse=True)
        order, _ = by_class(distinct, classes)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        _, x, y, z = zip(*sorted(found))
        n = np.concatenate([unplanes(v, np.int64) for v in x])
        if len(n) != len(distinct):
            raise ValueError("a pack and its answers must meet whole")
        n = n[back]
        length = np.concatenate([np.frombuffer(v, np.uint8, len(v) // 9) for v in y]).astype(np.int64)
        codes = np.concatenate([unplanes(v[len(v) // 9 :], np.uint64) for v in y])
        return keys, tokens, distinct, inverse, n, Tails(length, codes, np.frombuffer(b"".join(z), np.uint8)).pick(back)

    @tidy
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of all contexts over the learned texts of a partition; rows come pack by pack."""
        c: Code = shared_code.value
        sums = np.zeros((CONTEXTS, 2, SLOTS // 2), np.int32)
        nodes = np.zeros(2 * n_nodes, np.int64)

        def learned(texts: list[bytes], used: np.ndarray, found: list[tuple]) -> None:
            if not used.any():
                return
            _, tokens, distinct, words, _, tails = read(texts, found)
            words, tokens = words[np.repeat(used, tokens)], tokens[used]
            symbols = c.symbols(distinct)
            paths = Paths.of(symbols, tails)
            ends = np.concatenate([[0], np.cumsum(tokens)])
            for lo, hi in slices(tokens):
                w = words[ends[lo] : ends[hi]]
                outer, inner = Bits.of(c, symbols[w], tokens[lo:hi]), Bits.inside(c, symbols[w], tokens[lo:hi], paths, w, distinct[w])
                nodes[:] += np.bincount(outer.node * 2 + outer.bit, minlength=2 * n_nodes)
                for j in range(CONTEXTS):
                    for table, part in ((sums[j, 0], outer), (sums[j, 1], inner)):
                        at = part.slots[j]
                        at <<= 1
                        at |= part.bit
                        np.add.at(table, at, np.int32(1))

        now, texts, used, found = None, [], [], []
        for batch in batches:
            columns = [batch.column(k).cast(pa.binary()) if k == 2 else batch.column(k) for k in range(batch.num_columns)]
            for pack, bucket, text, learns, *answer in zip(*(v.to_pylist() for v in columns)):
                if pack != now:
                    learned(texts, np.array(used, bool), found)
                    now, texts, used, found = pack, [], [], []
                if bucket < 0:
                    texts.append(text or b"")
                    used.append(learns)
                else:
                    found.append((bucket, *answer))
        learned(texts, np.array(used, bool), found)
        yield chunks([-1], [planes(nodes)])
        for j, own_sums in enumerate(sums.reshape(CONTEXTS, -1)):
            held = [(i, part) for i, part in enumerate(own_sums.reshape(-1, CHUNK), j * (SLOTS // CHUNK)) if part.any()]
            yield chunks([i for i, _ in held], [sparse(part) for _, part in held])

    def chunks(numbers: list[int], values: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.binary())], names=["chunk", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = key[0].as_py()
        sums = np.zeros(2 * n_nodes if chunk < 0 else CHUNK, np.int64)
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("sums")).to_pylist():
                if chunk < 0:
                    sums += unplanes(x, np.int64)
                else:
                    add_sparse(sums, x)
        # of a slot seen two thousand million times the share stays
        own_sums = planes(sums) if chunk < 0 else sparse(np.minimum(sums, np.iinfo(np.int32).max).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([0], pa.int32()), pa.array([own_sums], pa.binary())], names=["chunk", "part", "sums"])

    answer = ["x", "y", "z"]
    asking = rows.select(pack_of(at, id_col, text_col).alias("pack"), F.lit(-1).alias("bucket"), F.col(text_col).alias("text"), F.col(learn).alias("learn"), *[F.lit(None).cast("binary").alias(c) for c in answer])
    answered = asked.select(F.col(pack_col).alias("pack"), "bucket", F.lit(None).cast("string").alias("text"), F.lit(False).alias("learn"), *answer)
    few = max(sc.defaultParallelism, -(-at.total_bytes // (48 << 20)))  # every partition sends a whole table
    by_pack = asking.union(answered).repartition(few, "pack").sortWithinPartitions("pack", "bucket")
    partial = by_pack.mapInArrow(tables, "chunk int, sums binary")
    salted = partial.select("chunk", F.pmod(F.spark_partition_id(), F.lit(max(1, few // 32))).alias("part"), "sums")
    summed = cut(salted.groupBy("chunk", "part").applyInArrow(add, SUMS).groupBy("chunk").applyInArrow(add, SUMS).select("chunk", "sums")).collect()  # of fixed size
    node_counts, counts = np.zeros(2 * n_nodes, np.int64), np.zeros((CONTEXTS * SLOTS // CHUNK, CHUNK), np.float32)
    for r in summed:
        if r["chunk"] < 0:
            node_counts = unplanes(bytes(r["sums"]), np.int64)
        else:
            add_sparse(counts[r["chunk"]], bytes(r["sums"]))
    del summed
    none = np.zeros(classes, np.int64)  # every learned word has a code of its own
    model = Model.build(code, known_tokens, known_words, none, none, node_counts.reshape(-1, 2), *counts.reshape(CONTEXTS, 2, -1, 2).swapaxes(0, 1))
    shared = sc.broadcast(model)

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        if not len(table):
            return arrow.empty_table()
        m: Model = shared.value
        _, texts, table = ordered(table, id_col, text_col)
        by_size = np.argsort([len(t) for t in texts], kind="stable")  # texts of a slice then go through as many blocks
        texts, table = [texts[k] for k in by_size.tolist()], table.take(by_size)
        keys, tokens, distinct, words, n, tails = read(texts, list(zip(*(found[c].to_pylist() for c in ("bucket", "x", "y", "z")))))
        symbols = m.code.symbols(distinct)
        paths = Paths.of(symbols, tails)
        ends = np.concatenate([[0], np.cumsum(tokens)])
        parts = []
        for a, b in slices(tokens):
            w = words[ends[a] : ends[b]]
            parts.append(score_texts(m, keys[ends[a] : ends[b]], tokens[a:b], n[w], paths, w, symbols[w]))
        own_score, base, known = (np.concatenate(x) for x in zip(*parts))
        size = np.array([len(t) + 1 for t in texts])
        columns = [table[f.name].combine_chunks() for f in own]
        columns += [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(texts), m.known_tokens), pa.int64()), pa.array(base), pa.array(own_score), pa.array(-own_score * np.log2(10) / size)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=arrow.names)

    return dealt.groupBy(pack_col).cogroup(asked.groupBy(pack_col)).applyInArrow(finish, schema)
