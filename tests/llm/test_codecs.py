"""BPE, PNG and WARC against independent readers and brute force."""

import base64
import hashlib
import math
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from riskloom.llm import bpe, media, warc

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_equals_the_library_and_round_trips(spark, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert list(r["ids"]) == own.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["pack"] == "p"


def test_bpe_matrix_equals_heap():
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 40, 200):
        rows = rng.choice(np.frombuffer(b"aethn \n", np.uint8), (30, n))
        for row, ids in zip(rows, c._merge_matrix(c.single[rows])):
            assert ids.tolist() == c._merge_long(row.tobytes()).tolist()


def test_png_round_trip_and_filters(spark, odd):
    out = {(r["doc_id"], r["text"]): r for r in media.read_back(media.store(odd)).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        assert bytes(out[i, t]["payload"]) == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert len(out[i, t]["feature"]) == 8
    assert out[4, "word"]["media"] == out[5, "word"]["media"]
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (7, 5), dtype=np.uint8)
    for kind in range(5):  # a plain encoder for each row filter
        lines = b""
        for y in range(7):
            line = bytearray([kind])
            for x in range(5):
                a = int(image[y, x - 1]) if x else 0
                b = int(image[y - 1, x]) if y else 0
                c = int(image[y - 1, x - 1]) if x and y else 0
                paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line.append((int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
            lines += line
        data = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(lines)) + media._chunk(b"IEND", b"")
        assert (media.read_png(data) == image).all()
    broken = bytearray(data)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(broken))


def test_cosine_hash_by_definition():
    """Area means, transform and median with plain loops."""
    rng = np.random.default_rng(2)
    for height in (1, 5, 32, 33, 200):
        image = rng.integers(0, 256, (height, 64), dtype=np.uint8)
        small = []
        for i in range(32):
            lo, hi = i * height // 32, max((i + 1) * height // 32, i * height // 32 + 1)
            small.append([sum(int(image[y, x]) for y in range(lo, hi) for x in (2 * j, 2 * j + 1)) / (2 * (hi - lo)) for j in range(32)])
        wave = [[math.cos(math.pi * k * (2 * n + 1) / 64) for n in range(32)] for k in range(8)]
        half = [[sum(wave[k][i] * small[i][j] for i in range(32)) for j in range(32)] for k in range(8)]
        low = [round(sum(half[u][j] * wave[v][j] for j in range(32)), 6) for u in range(8) for v in range(8)]
        middle = sorted(low[1:])[31]
        want = sum((x > middle) << (63 - k) for k, x in enumerate(low)).to_bytes(8, "big")
        assert media.cosine_hash(image) == want


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 9000
    rows = [(1, "u", big), (2, "u\r\nx", big), (3, None, big[:-1]), (4, "v", None), (5, "v", ""), (6, "w", "s" * 999), (7, "w", "s" * 999), (8, "w", "t" * 1000), (None, "w", "t" * 1000), (9, "z", "t" * 1000), (9, "z", "t" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write(warc.decide(pages), segment_bytes=5000, chunk_bytes=777, archive_mb=0.01)
    out = warc.read(archives).collect()
    assert len(out) == len(rows)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in out)
    size = lambda t: len((t or "").encode())
    expect = []
    for i, _, t in rows:
        twins = [j for j, _, o in rows if (o or "") == (t or "") and j is not None]
        to = max(twins) if size(t) >= 1000 and twins and max(twins) != i else None
        expect.append((i or 0, "revisit" if to else "response", to, size(t), hashlib.sha1((t or "").encode()).hexdigest()))
    assert got == sorted(expect)
    assert {bytes(r["payload"]) for r in out if r["record_type"] == "response"} == {(t or "").encode() for i, _, t in rows}
    assert warc.read(warc.write(warc.decide(pages.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n")


def test_empty_table(spark, odd):
    none = odd.limit(0)
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0
    assert media.read_back(media.store(none)).count() == 0


def test_revisits_name_the_record_they_refer_to(spark):
    same, other = "x" * 1500, "y" * 2000
    pages = spark.createDataFrame([(1, "u", same), (2, "u", same), (5, "u", same), (3, "v", other), (4, "v", other), (4, "v", other), (7, "w", "z" * 3000), (None, "n", same)], "page_id long, url string, html string")
    records = [f for r in warc.write(warc.decide(pages)).collect() for f, _ in warc.parse(bytes(r["content"]))]
    by_page = {f["x-page-id"]: f for f in records}
    assert len({f["warc-record-id"] for f in records}) == len(records) == 8
    assert all(by_page[k]["warc-refers-to"] == by_page["5"]["warc-record-id"] and by_page[k]["warc-type"] == "revisit" for k in ("1", "2", ""))
    assert "warc-refers-to" not in by_page["3"] and by_page["3"]["x-refers-to-page"] == "4"
