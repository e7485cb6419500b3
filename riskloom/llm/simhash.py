"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are 64-bit majority votes of the XXH64 hashes of word shingles.
Equal fingerprints form one class.  To find classes that differ in at most
``distance`` (even) bits, every class emits all variants of its fingerprint
within half that radius; two fingerprints within the distance share a variant,
and two that share one are within it.  A variant has at most as many owners as
a ball of that radius has points (65 for distance 2), however many documents
there are; neighbours in a variant's sorted list are linked, verified by
counting differing bits, and links are deduplicated before components.

``dedup`` joins texts by the similarity of their shingle sets.  Fingerprints
alone cannot find all of those (see ``similar``), so its candidates also come
from keys of least shingles, and every candidate is verified.

Defined results: null text has no words; no words give fingerprint zero, which
links like any other; fewer words than a shingle form one shingle; repeated
rows and null ids keep their row; ``component_id`` is the smallest id that is
not null.  Very long texts are hashed in slices of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, cut, give_back, hash_words, mix64, tidy, words_at
from .graph import components
from .substring import stretch_keys

SLICE = 1 << 15


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a text, lower-cased in A-Z, repeats included."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(gaps) < words:
        return np.array([xxhash.xxh64_intdigest(norm, seed)], dtype=np.uint64)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(norm)][words - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(norm[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(ends))


def vote(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[lo : lo + SLICE].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """Add ``out_col`` (long) to every row; an existing column of that name is replaced."""
    rest = [f for f in docs.schema.fields if f.name != out_col]
    schema = T.StructType([*rest, T.StructField(out_col, T.LongType(), False)])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            own = [vote(shingle_hashes(t.as_py() or b"", words, seed)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=schema.names)

    return docs.select(*[docs[f.name] for f in rest]).mapInArrow(work, schema)


def masks(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, signed."""
    found = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Distinct pairs (a, b) of distinct ``fp`` within ``distance`` bits that connect whatever is within it."""
    if distance % 2 or not 0 <= distance <= 4:
        raise ValueError("distance must be 0, 2 or 4")
    balls = fps.select("fp").distinct().select("fp", F.explode(F.array(*[F.lit(m) for m in masks(distance // 2)])).alias("mask"))
    owners = balls.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    pairs = owners.select("fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("b")).where("b IS NOT NULL")
    return pairs.select(F.col("fp").alias("a"), "b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fps = cut(fingerprints(rows, words, seed).select("doc_id", "fp"))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes, distance))
    rooted = cut(classes.join(roots.toDF("fp", "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# --- near duplicates by similarity: balls of fingerprints, then keys of least shingles, verified on shingle sets ---

#: Keys per text, and least shingles that each is made of.  Two texts of similarity s share none of the keys with
#: probability (1 - s ** LEAST) ** KEYS: 6e-7 at 0.8, 4e-9 at 0.85, whatever the number of texts.
KEYS, LEAST = 20, 3
#: 64-bit words of the parity map of a shingle set.
MAP = 16


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit keys of the word shingles of a text, lower-cased in A-Z."""
    data, start, end, _ = words_at([text.lower()])
    keys = hash_words(data, start, end)
    if len(keys) > words:
        keys = stretch_keys(keys, words)
    elif len(keys):
        keys = stretch_keys(keys, len(keys))
    return np.unique(keys)


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """An odd factor for each order of the shingles."""
    return (mix64(np.arange(1, KEYS * LEAST + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def least_keys(shingles: np.ndarray) -> np.ndarray:
    """KEYS 64-bit keys of a set, each of its least shingles under LEAST orders."""
    least = np.full(KEYS * LEAST, 2**32 - 1, np.uint32)
    for lo in range(0, len(shingles), 2048):
        own = (shingles[lo : lo + 2048] >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, (own * _orders()).min(axis=1), out=least)
    out = np.arange(KEYS, dtype=np.uint64)
    for part in least.reshape(KEYS, LEAST).T.astype(np.uint64):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether each of 64 * MAP cells holds an odd number of shingles: two maps differ in no more bits than their sets in shingles."""
    cells = (mix64(shingles) % np.uint64(64 * MAP)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=64 * MAP) & 1).view(np.int64)


def words_key(text: bytes) -> bytes:
    """128-bit key of the words of a text: copies that differ in A-Z case or ASCII white space count as equal."""
    return hashlib.md5(b" ".join(text.lower().split()), usedforsecurity=False).digest()


def _draw(rows: DataFrame, words: int) -> DataFrame:
    """(key, rank, n, fp, least, map) of every distinct text; ``rank`` is the least (id, row, copy) of its rows."""

    @tidy
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(3).cast(pa.binary())]
            sets = [shingle_set(t, words) for t in texts]
            columns = [
                *batch.columns[:3],
                pa.array([words_key(t) for t in texts], pa.binary()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([vote(x) for x in sets], pa.int64()),
                pa.array([least_keys(x).view(np.int64) for x in sets], pa.list_(pa.int64())),
                pa.array([parity(x) for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "copy", "key", "n", "fp", "least", "map"])

    drawn = rows.select("id", "row", "copy", "text").mapInArrow(draw, "id long, row long, copy long, key binary, n long, fp long, least array<long>, map array<long>")
    first = drawn.groupBy("key").agg(F.min(F.struct("id", "row", "copy")).alias("rank"), F.first(F.struct("n", "fp", "least", "map")).alias("own"))
    return first.select("key", "rank", "own.*")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar."""

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = 0
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(verify, "a long, b long")


def _sets(rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of ``classes``; a partition makes the set of a text once, however many copies it holds."""

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = [k for k, c in enumerate(batch.column(0).to_pylist()) if not (c in seen or seen.add(c))]
            texts = [t.as_py() or b"" for t in batch.column(1).take(pa.array(new, pa.int64())).cast(pa.binary())]
            columns = [pa.array([words_key(t) for t in texts], pa.binary()), pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "shingles"])

    made = rows.join(classes.select("copy"), "copy", "left_semi").select("copy", "text").mapInArrow(sets, "key binary, shingles binary")
    return classes.join(made.groupBy("key").agg(F.first("shingles").alias("shingles")), "key").select("node", "shingles")


def _ball_pairs(classes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) that connect texts of equal fingerprints and fingerprints that share a variant."""
    heads = classes.groupBy("fp").agg(F.min("node").alias("head"))
    equal = classes.select("node", "fp").join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = links(heads, distance).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b")
    return equal.unionAll(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _leader_pairs(live: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, mixed): the first ``width`` owners of each key outside its commonest root, each with all owners of another root.

    ``live`` has the owners of every key with their roots, sizes and maps.
    Pairs that cannot reach the similarity, by the sizes of their sets or the
    bits in which their maps differ, are left out by the join itself.
    ``mixed`` has the keys with more than one root, and how many owners are
    outside the commonest.  Owners stand in one hashed order in every key, so
    that a group led by one text meets the same leader in all of them.
    """
    own = live.groupBy("token", "root").agg(F.count("*").alias("n"))
    most = own.groupBy("token").agg(F.max(F.struct("n", F.xxhash64("root").alias("h"), "root")).alias("m"), F.sum("n").alias("owners"))
    mixed = most.select("token", F.col("m.root").alias("main"), (F.col("owners") - F.col("m.n")).alias("outside")).where("outside > 0")
    order = Window.partitionBy("token").orderBy(F.xxhash64("node"), "node")
    outside = live.join(mixed, "token").where("root <> main").withColumn("place", F.row_number().over(order)).where(F.col("place") <= width)
    leaders = outside.select(*[F.col(c).alias(c if c == "token" else f"l_{c}") for c in live.columns])
    few = F.least("n", "l_n") >= similarity * F.greatest("n", "l_n") - 1e-6
    differ = sum((F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"l_m{i}"))) for i in range(MAP)), F.lit(0))
    met = live.join(leaders, (live["token"] == leaders["token"]) & (F.col("root") != F.col("l_root")) & few & (differ <= (F.col("n") + F.col("l_n")) * ((1 - similarity) / (1 + similarity)) + 1e-6))
    return met.select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).distinct(), mixed


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rank, root) of every distinct text: texts linked by Jaccard similarity of ``words``-word shingles share a root; ``rank`` names a row of the text.

    Candidates are verified on their whole shingle sets.  Texts whose 64-bit
    fingerprints of shingles lie within ``distance`` meet by ball hashing; but
    fingerprints of texts that are 0.8 similar differ in some ten bits, so
    these are the closest only.  All others meet by the keys of ``least_keys``.
    In each round the first owners of a key that stand outside its commonest
    group lead: they are compared with every owner of another group.  The
    first round has one leader per key, each later one 32 times as many, until
    no key has owners of two groups that have not been compared.  So copies
    cost a few pairs per text, no group is ever in one task, and no pair that
    shares a key is left out.
    """
    rows = docs.select(_row_id(id_col).alias("id"), _row_hash(docs).alias("row"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    classes = cut(_draw(rows, words).select(F.monotonically_increasing_id().alias("node"), "*"))
    owners = classes.where("n > 0").select("node", F.explode("least").alias("token"))
    several = owners.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    facts = classes.select("node", "n", *[F.col("map")[i].alias(f"m{i}") for i in range(MAP)])
    shared = cut(owners.join(several, "token", "left_semi").join(facts, "node"))
    roots, sets, tested, width = None, None, None, 1
    while True:
        give_back(docs.sparkSession)
        live = shared.withColumn("root", F.col("node")) if roots is None else shared.join(roots, "node")
        pairs, mixed = _leader_pairs(live, similarity, width)
        pairs = pairs.unionAll(_ball_pairs(classes.where("n > 0"), distance)).distinct() if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if sets is None:
            ends = shared.select("node").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct()
            sets = cut(_sets(rows, classes.join(ends, "node", "left_semi").select("node", "key", F.col("rank.copy").alias("copy")), words))
        give_back(docs.sparkSession)
        found = cut(_verified(pairs, sets, similarity))
        tested = pairs if tested is None else tested.unionAll(pairs)
        roots = joined(roots, found) if roots is not None else joined(classes.select("node", F.col("node").alias("root")), found)
        if not mixed.where(F.col("outside") > width).limit(1).count():
            give_back(docs.sparkSession)
            return classes.join(roots, "node").select("rank", "root")
        width *= 32


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) after the ends of ``edges`` (a, b) have come together."""
    ends = edges.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b")
    higher = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("root", "higher")
    return cut(roots.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))


def _row_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID)))


def _row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"])


def dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id (nulls last); null and empty texts are one group."""
    roots = similar(docs, words, similarity, id_col=id_col, text_col=text_col)
    kept = roots.groupBy("root").agg(F.min("rank").alias("rank")).select("rank.id", "rank.row")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    chosen = docs.select(_row_id(id_col).alias("id"), _row_hash(docs).alias("row"), own).join(kept, ["id", "row"], "left_semi")
    return chosen.groupBy("id", "row").agg(F.first("own").alias("own")).select("own.*")
