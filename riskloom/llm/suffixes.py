"""Suffix-array dedup: maximal byte repeats from a common-prefix interval tree.

The corpus is cut by content, so that suffixes which can share ``window`` bytes
meet in one task.  Of every ``window`` bytes, the 26-byte string (for windows
of 50) with the least hash is the anchor; equal windows have equal anchors at
equal places.  A fragment is the text of all neighbouring windows with one
anchor, 50 to 74 bytes.

0. A text that equals one of a smaller id needs no comparison: all its windows
   start there.  Hashes of whole texts find these copies first; they take no
   further part (texts under a window lose nothing anyway).
1. Distinct anchors per pack are compared corpus-wide (``mark_shared``).
2. Fragments of shared anchors, distinct per pack, with their smallest
   document id, go to the bucket of their anchor.
3. A bucket sorts the suffixes of its distinct fragments (by their first
   ``window`` bytes, then by the rest), takes common-prefix lengths of
   neighbours, and scans them with a stack.  Every interval of the tree with
   ``window`` common bytes or more is a repeat with all its occurrences; it is
   a maximal one if its occurrences extend to the left by different bytes or
   start a fragment.  A fragment that several documents hold is a repeat of
   its full length.  Each group reports its length, its place in each fragment
   and its smallest document.
4. Packs map the groups back to every occurrence; an occurrence in a document
   other than the group's smallest marks its bytes.  Runs of marked bytes are
   the repeats at document level.

Anchors whose fragments are all equal need no sorting.  Every exchange sends a
key once per pack, so copies and common lines do not pile up in a task.

Defined results: null text is empty; texts shorter than a window lose nothing;
matches never cross documents; documents of equal id do not remove each other;
a null id ranks after all others; repeated rows keep their row; other columns
pass through.  Comparison of whole fragments and windows is by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOB, Hasher, Layout, answers, blobs, cut, fresh, layout, mark_shared, mix64, offer, ordered, pack_of, packed, pieces, planes, ranges, runs, spread, trim, unplanes
from .substring import differ, least_of

NONE = np.iinfo(np.int64).max
#: Left symbol of an interval whose suffixes extend to the left by different bytes.
DIVERSE = -1
#: Suffixes and fragments that one scan takes at a time, more only where one window or anchor has more.
SUFFIXES, FRAGMENTS = 100_000, 20_000
#: Bytes of text that are cut into fragments at a time.
SLICE = 1 << 18


def cut_fragments(data: np.ndarray, start: np.ndarray, length: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, anchor, key) of the fragments of the texts at ``start`` in ``data``, each of ``window`` bytes or more."""
    hasher = Hasher(data)
    grams = hasher.all(gram)
    bits = max(24, int(len(grams)).bit_length())  # the same for all slices, so that all cut alike
    low = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    span, have = window - gram + 1, 1
    while have * 2 <= span:  # least key of growing stretches
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    at = ranges(start, length - window + 1)  # windows inside documents
    chosen = (low & np.uint64((1 << bits) - 1)).astype(np.int64)[at]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]))
    lo, hi = at[new], at[np.append(new[1:], len(at)) - 1] + window
    return lo, hi, grams[chosen[new]], hasher(lo, hi) ^ mix64((hi - lo).astype(np.uint64))


class Pack:
    """Bytes of one pack, its fragments and their anchors."""

    def __init__(self, table: pa.Table, copies: set[tuple[int, int]], window: int, gram: int, id_col: str, text_col: str):
        trim()
        self.ids, self.texts, self.table = ordered(table, id_col, text_col)
        length = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.end = np.cumsum(length)
        self.start = self.end - length
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.window = window
        self.copy = np.zeros(len(length), bool)
        if copies:
            self.copy[:] = [(i, xxhash.xxh64_intdigest(t, 42)) in copies for i, t in zip(self.ids.tolist(), self.texts)]
        keep = np.flatnonzero((length >= window) & ~self.copy)
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
        part = np.cumsum(length[keep]) // SLICE
        for own in np.split(keep, np.flatnonzero(np.diff(part)) + 1) if len(keep) else []:
            base = self.start[own[0]]  # texts between are short or copies: skipped by their starts
            lo, hi, anchors, keys = cut_fragments(self.data[base : self.end[own[-1]]], self.start[own] - base, length[own], window, gram)
            found.append((lo + base, hi + base, np.searchsorted(self.end, lo + base, side="right"), anchors, keys))
        self.lo, self.hi, self.doc, self.anchors, self.keys = (np.concatenate(x) for x in zip(*found))

    def shared(self, found: pa.Table, buckets: int) -> None:
        """Keep the fragments of shared anchors only."""
        keys, inverse = np.unique(self.anchors, return_inverse=True)
        keep = answers(found, keys, buckets)[inverse]
        self.lo, self.hi, self.anchors, self.doc, self.keys = (x[keep] for x in (self.lo, self.hi, self.anchors, self.doc, self.keys))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first of each distinct fragment, inverse); in order of anchor, then of fragment hash."""
        if not len(self.lo):
            return self.lo, self.lo
        keys = self.keys
        order = np.lexsort((keys, self.anchors))
        new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (self.anchors[order][1:] != self.anchors[order][:-1])])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        first = np.full(int(new.sum()), len(order), np.int64)
        np.minimum.at(first, inverse, np.arange(len(order)))
        return first, inverse


def interval_groups(suffix_at: list[int], common: list[int], left: list[int], least: list[int], window: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats (first, last, length, smallest document) over sorted suffixes.

    ``common[i]`` is the common-prefix length of suffixes i-1 and i; lengths
    under ``window`` end every interval.  ``left`` is the byte before a suffix,
    DIVERSE where it starts a fragment.  One scan with a stack of open
    intervals (length, first, left symbol, smallest document).
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[list[int]] = []
    n = len(suffix_at)
    for i in range(1, n + 1):
        size = common[i] if i < n else 0
        if size < window:
            size = 0
        first, symbol, doc = i - 1, left[i - 1], least[i - 1]
        while stack and stack[-1][0] > size:
            length, first, own, low = stack.pop()
            symbol = own if own == symbol else DIVERSE
            doc = low if low < doc else doc
            if symbol == DIVERSE:
                out.append((first, i - 1, length, doc))
        if not size:
            continue
        if stack and stack[-1][0] == size:
            top = stack[-1]
            if top[2] != symbol:
                top[2] = DIVERSE
            if doc < top[3]:
                top[3] = doc
        else:
            stack.append([size, first, symbol, doc])
    return out


def repeat_groups(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(fragment, start in it, length, smallest document) of every occurrence of every maximal repeat among distinct fragments."""
    count = hi - lo - window + 1
    owner = np.repeat(np.arange(len(lo)), count)
    at = ranges(lo, count)
    head = Hasher(data)(at, at + window)
    order = np.argsort(head, kind="stable")
    key = head[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    many = same | np.append(same[1:], False)
    order, same = order[many], same[many]
    found = [np.zeros((4, 0), np.int64)]
    begin = np.append(np.flatnonzero(~same), len(order))
    edge = [0, *begin[np.flatnonzero(np.diff(begin[:-1] // SUFFIXES)) + 1].tolist(), len(order)] if len(order) else [0]
    for i, j in zip(edge, edge[1:]):
        found.append(_scan(data, at[order[i:j]], owner[order[i:j]], ~same[i:j], lo, hi, least, window))
    return tuple(np.concatenate(found, axis=1))


def _scan(data: np.ndarray, at: np.ndarray, owner: np.ndarray, new: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """``repeat_groups`` of suffixes grouped by their first ``window`` bytes; ``new`` starts a group."""
    # the bytes after the window, as big-endian words, zero-filled, with the length as last key
    a, b = at + window, hi[owner]
    room = -(-max(int((b - a).max()), 1) // 8) * 8
    place = a[:, None] + np.arange(room)
    tail = np.where(place < b[:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)
    words = tail.view(">u8").astype(np.uint64)
    left_over, group = b - a, np.cumsum(new)
    inner = np.lexsort((left_over, *[words[:, j] for j in range(words.shape[1] - 1, -1, -1)], group))
    tail, left_over, group, place, frag = tail[inner], left_over[inner], group[inner], at[inner], owner[inner]
    unequal = tail[1:] != tail[:-1]
    prefix = np.where(unequal.any(axis=1), unequal.argmax(axis=1), room)
    common = np.zeros(len(inner), np.int64)
    common[1:] = np.where(group[1:] == group[:-1], window + np.minimum(prefix, np.minimum(left_over[1:], left_over[:-1])), 0)
    before = np.where(place > lo[frag], data[np.maximum(place - 1, 0)].astype(np.int64), DIVERSE)
    found = interval_groups(place.tolist(), common.tolist(), before.tolist(), least[frag].tolist(), window)
    if not found:
        return np.zeros((4, 0), np.int64)
    first, last, length, doc = np.array(found, dtype=np.int64).T
    size = last - first + 1
    who = ranges(first, size)
    return np.stack([frag[who], place[who] - lo[frag[who]], np.repeat(length, size), np.repeat(doc, size)])


def copy_rows(docs: DataFrame, at: Layout, window: int, id_col: str, text_col: str) -> DataFrame:
    """Rows whose text equals that of a smaller id: (pack, id, text hash).  Only hashes are grouped and joined."""
    text = F.col(text_col)
    rows = docs.where(F.octet_length(text) >= window).select(
        pack_of(at, id_col, text_col).alias("pack"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NONE))).alias("id"),
        F.xxhash64(text).alias("h"), F.xxhash64(F.lit("twice"), text).alias("h2"),
    )
    least = rows.groupBy("h", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    return rows.join(cut(least), ["h", "h2"]).where("id > least").select("pack", "id", "h")


def repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``cut_from``, ``cut_to`` (half-open byte spans) and ``kept`` (binary, the bytes left)."""
    gram = window // 2 + 1
    added = [T.StructField("n_bytes", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("cut_from", "cut_to")], T.StructField("kept", T.BinaryType())]
    own_fields = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType([*own_fields, *added])
    docs = docs.select(*[docs[f.name] for f in own_fields])
    at, pack_col = layout(docs, text_col, pack_mb=2, bucket_mb=8), fresh(docs, "pack")
    n_buckets = at.buckets
    dealt = packed(docs, at, pack_col, id_col, text_col)

    def pack(table: pa.Table, answers_: pa.Table) -> tuple[Pack, list[pa.Table]]:
        """The pack, and its answers by kind: shared anchors, groups."""
        of = [answers_.filter(pc.equal(answers_["kind"], k)) if len(answers_) else answers_ for k in range(3)]
        copies = {(i, h % (1 << 64)) for i, h in zip(of[2]["id"].to_pylist(), of[2]["h"].to_pylist())}
        return Pack(table, copies, window, gram, id_col, text_col), of[:2]

    def probe(table: pa.Table, known: pa.Table) -> pa.Table:
        if not len(table):
            return blobs([])
        p, _ = pack(table, known)
        keys, inverse = np.unique(p.anchors, return_inverse=True)
        return offer(table[pack_col][0].as_py(), keys, differ(inverse, len(keys), p.ids[p.doc]), None, n_buckets)

    def extend(table: pa.Table, known: pa.Table) -> pa.Table:
        if not len(table) or not len(known):
            return blobs([])
        p, (found, _) = pack(table, known)
        p.shared(found, n_buckets)
        first, inverse = p.distinct()
        ids = p.ids[p.doc]
        least, several = least_of(inverse, len(first), ids), differ(inverse, len(first), ids)
        lo, size, anchors = p.lo[first], p.hi[first] - p.lo[first], p.anchors[first]
        low = spread(anchors, n_buckets)
        number, out = table[pack_col][0].as_py(), []
        for b, i, j in pieces(anchors, n_buckets):
            head = np.concatenate([np.packbits(several[i:j]), size[i:j].astype(np.uint16).view(np.uint8), low[i:j].view(np.uint8)])
            out.append((b, number, np.int64(j - i).tobytes() + head.tobytes(), planes(least[i:j]), p.data[ranges(lo[i:j], size[i:j])].tobytes()))
        return blobs(out)

    def tree(table: pa.Table) -> pa.Table:
        trim()
        bucket, packs = table["bucket"][0].as_py(), table["pack"].to_pylist()
        several, size, anchor, least, data, counts, keys = [], [], [], [], [], [], []
        for x, y, z in zip(table["x"].to_pylist(), table["y"].to_pylist(), table["z"].to_pylist()):
            n = int(np.frombuffer(x, np.int64, 1)[0])
            bits = -(-n // 8)
            several.append(np.unpackbits(np.frombuffer(x, np.uint8, bits, 8), count=n).view(bool))
            size.append(np.frombuffer(x, np.uint16, n, 8 + bits).astype(np.int64))
            anchor.append(np.frombuffer(x, np.uint32, n, 8 + bits + 2 * n))
            least.append(unplanes(y, np.int64))
            data.append(np.frombuffer(z, np.uint8))
            counts.append(n)
            ends = np.cumsum(size[-1])
            keys.append(Hasher(data[-1])(ends - size[-1], ends) ^ mix64(size[-1].astype(np.uint64)))
        several, size, anchor, least, data, keys = map(np.concatenate, (several, size, anchor, least, data, keys))
        hi = np.cumsum(size)
        lo = hi - size
        # one of each distinct fragment, over all packs
        order = np.lexsort((keys, anchor))
        new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])])
        begin = np.flatnonzero(new)
        held = np.diff(np.append(begin, len(order)))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        u_least = np.minimum.reduceat(least[order], begin)
        u_many = (held > 1) | np.logical_or.reduceat(several[order], begin)
        u_lo, u_hi, u_anchor = lo[order[begin]], hi[order[begin]], anchor[order[begin]]
        # anchors with several fragments go to the tree
        twin = np.concatenate([[False], u_anchor[1:] == u_anchor[:-1]])
        pick = np.flatnonzero(twin | np.append(twin[1:], False))
        frag = np.flatnonzero(u_many)
        start, length, doc = np.zeros(len(frag), np.int64), (u_hi - u_lo)[frag], u_least[frag]
        groups = [(frag, start, length, doc)]
        begin_of = np.append(np.flatnonzero(~twin[pick]), len(pick))
        edge = [0, *begin_of[np.flatnonzero(np.diff(begin_of[:-1] // FRAGMENTS)) + 1].tolist(), len(pick)] if len(pick) else [0]
        for i, j in zip(edge, edge[1:]):
            own = pick[i:j]
            n = u_hi[own] - u_lo[own]
            ends = np.cumsum(n)
            g = repeat_groups(data[ranges(u_lo[own], n)], ends - n, ends, u_least[own], window)
            groups.append((own[g[0]], *g[1:]))
        frag, start, length, doc = (np.concatenate(x) for x in zip(*groups))
        by = np.argsort(frag, kind="stable")
        frag, start, length, doc = frag[by], start[by], length[by], doc[by]
        n_of = np.bincount(frag, minlength=len(begin))
        from_ = np.cumsum(n_of) - n_of
        out, i = [], 0
        for pack, n in zip(packs, counts):
            own = which[i : i + n]
            rows = ranges(from_[own], n_of[own])
            out.append((bucket, pack, n_of[own].astype(np.uint16).tobytes(), start[rows].astype(np.uint16).tobytes() + length[rows].astype(np.uint16).tobytes(), planes(doc[rows])))
            i += n
        return blobs(out)

    def finish(table: pa.Table, known: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        if not len(table):
            return arrow.empty_table()
        p, (found, groups) = pack(table, known)
        gone = np.zeros(len(p.data), bool)
        if len(groups):
            p.shared(found, n_buckets)
            first, inverse = p.distinct()
            where = {b: (i, j) for b, i, j in pieces(p.anchors[first], n_buckets)}
            rows = groups.sort_by("bucket")
            n_of = np.zeros(len(first), np.int64)
            start, length, doc = [], [], []
            for b, x, y, z in zip(*(rows[c].to_pylist() for c in ("bucket", "x", "y", "z"))):
                n_of[slice(*where[b])] = np.frombuffer(x, np.uint16)
                both = np.frombuffer(y, np.uint16).astype(np.int64)
                start.append(both[: len(both) // 2])
                length.append(both[len(both) // 2 :])
                doc.append(unplanes(z, np.int64))
            start, length, doc = map(np.concatenate, (start, length, doc))
            from_ = np.cumsum(n_of) - n_of
            which = ranges(from_[inverse], n_of[inverse])
            owner = np.repeat(np.arange(len(inverse)), n_of[inverse])
            hit = doc[which] < p.ids[p.doc[owner]]
            a = (p.lo[owner] + start[which])[hit]
            change = np.bincount(a, minlength=len(gone) + 1) - np.bincount(a + length[which][hit], minlength=len(gone) + 1)
            gone = np.cumsum(change)[:-1] > 0
        lo, hi, kept = [], [], []
        for t, a, b, copy in zip(p.texts, p.start.tolist(), p.end.tolist(), p.copy.tolist()):
            mask = gone[a:b]
            if copy:
                mask[:] = True
            if mask.any():
                x, y = runs(mask)
                kept.append(p.data[a:b][~mask].tobytes())
                lo.append(x.tolist())
                hi.append(y.tolist())
            else:
                kept.append(t)
                lo.append([])
                hi.append([])
        columns = [p.table[f.name].combine_chunks() for f in own_fields]
        columns += [pa.array([len(t) for t in p.texts], pa.int64()), pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=arrow.names)

    kinds = f"bucket int, {pack_col} int, x binary, y binary, z binary, kind int, id long, h long"
    copies = copy_rows(docs, at, window, id_col, text_col).selectExpr("-1 AS bucket", f"pack AS {pack_col}", "NULL AS x", "NULL AS y", "NULL AS z", "2 AS kind", "id", "h").to(_schema(kinds))
    answer = lambda df, kind: df.withColumnRenamed("pack", pack_col).selectExpr("*", f"{kind} AS kind", "NULL AS id", "NULL AS h").to(_schema(kinds))
    by_pack = dealt.groupBy(pack_col)
    asked = by_pack.cogroup(copies.groupBy(pack_col)).applyInArrow(probe, BLOB)
    found = answer(asked.groupBy("bucket").applyInArrow(mark_shared(n_buckets), BLOB), 0)
    fragments = by_pack.cogroup(found.unionAll(copies).groupBy(pack_col)).applyInArrow(extend, BLOB)
    groups = answer(fragments.groupBy("bucket").applyInArrow(tree, BLOB), 1)
    return by_pack.cogroup(found.unionAll(groups).unionAll(copies).groupBy(pack_col)).applyInArrow(finish, schema)


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
