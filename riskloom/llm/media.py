"""Media columns: texts stored as PNG images in binary columns, read back and hashed.

``store`` appends zero bytes up to a positive multiple of 64 and writes the
payload as an 8-bit greyscale PNG, 64 samples a row: zlib-compressed IDAT
chunks with CRCs, each row filtered by the least sum of absolute differences.
``read_back`` parses the chunks, tests signature, order, CRCs and sizes,
undoes the row filters with numpy, and hashes the image: the 8 x 8
low-frequency block of a two-dimensional cosine transform of its 32 x 32 area
means, one bit a coefficient, set above their median.

Defined results: null text is an empty text, which is one row of zeros; equal
texts give equal files and hashes; other columns pass through; a damaged file
raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices, tidy

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Compressed bytes of one IDAT chunk at most.
IDAT = 1 << 16
SIDE, LOW = 32, 8


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    return data + bytes(-len(data) % unit or (0 if data else unit))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(payload: bytes, level: int = 1) -> bytes:
    """Greyscale PNG of a payload whose length is a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    kinds = np.empty((3, *rows.shape), np.uint8)
    kinds[0] = rows
    kinds[1, :, 0], kinds[1, :, 1:] = rows[:, 0], rows[:, 1:] - rows[:, :-1]
    kinds[2, 0], kinds[2, 1:] = rows[0], rows[1:] - rows[:-1]
    best = np.abs(kinds.view(np.int8)).view(np.uint8).sum(axis=2, dtype=np.int32).argmin(axis=0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = best, kinds[best, np.arange(len(rows))]
    packed = zlib.compress(lines.tobytes(), level)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))
    return SIGNATURE + head + b"".join(_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the five row filters of one-byte samples; runs of rows with equal filters are done at once where rows allow it."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    across = np.flatnonzero(kinds == 1)
    rows[across] = np.cumsum(rows[across], axis=1, dtype=np.uint8)
    change = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(kinds)]):
        kind = kinds[lo]
        if kind == 2:
            first = max(lo - 1, 0)
            rows[first:hi] = np.cumsum(rows[first:hi], axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(lo, hi):
                up = rows[y - 1].astype(int).tolist() if y else [0] * rows.shape[1]
                line, left, corner = rows[y].tolist(), 0, 0
                for x, u in enumerate(up):
                    if kind == 3:
                        guess = (left + u) // 2
                    else:
                        p = left + u - corner
                        a, b, c = abs(p - left), abs(p - u), abs(p - corner)
                        guess = left if a <= b and a <= c else u if b <= c else corner
                    left, corner = (line[x] + guess) & 255, u
                    line[x] = left
                rows[y] = line
    return rows


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale, non-interlaced PNG as a (height, width) array."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, size, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"bad checksum or length of chunk {kind!r}")
        at += 12 + n
        if (size is None) != (kind == b"IHDR"):
            raise ValueError("IHDR is not the first chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
            if size[2:] != (8, 0, 0, 0, 0):
                raise ValueError("not an 8-bit greyscale image")
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
    if not ended or size is None:
        raise ValueError("no IEND")
    width, height = size[:2]
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != height * (width + 1):
        raise ValueError("image data of another size")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


@lru_cache(maxsize=4096)
def _cells(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, last index and rows of SIDE area cells over n lines; with fewer lines than cells, lines repeat."""
    lo = np.arange(SIDE) * n // SIDE
    hi = np.maximum((np.arange(SIDE) + 1) * n // SIDE, lo + 1)
    return lo, hi, (hi - lo).astype(float)


def cosine_hash(image: np.ndarray) -> bytes:
    """Eight bytes from the low frequencies of an image."""
    height, width = image.shape
    if width % SIDE == 0:
        wide = image.reshape(height, SIDE, -1).sum(axis=2, dtype=np.int64) / (width // SIDE)
    else:
        lo, hi, n = _cells(width)
        sums = np.concatenate([np.zeros((height, 1)), np.cumsum(image, axis=1, dtype=np.int64)], axis=1)
        wide = (sums[:, hi] - sums[:, lo]) / n
    lo, hi, n = _cells(height)
    sums = np.concatenate([np.zeros((1, SIDE)), np.cumsum(wide, axis=0)])
    small = (sums[hi] - sums[lo]) / n[:, None]
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _rest(df: DataFrame, added: dict[str, T.DataType]) -> tuple[DataFrame, T.StructType]:
    own = [f for f in df.schema.fields if f.name not in added]
    return df.select(*[df[f.name] for f in own]), T.StructType([*own, *[T.StructField(k, v, False) for k, v in added.items()]])


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Add ``n_bytes`` and the PNG of each text."""
    df, schema = _rest(docs, {"n_bytes": T.LongType(), media_col: T.BinaryType()})

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                texts = [x or b"" for x in part.column(part.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
                files = pa.array([write_png(pad(x)) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x) for x in texts], pa.int64()), files], names=schema.names)

    return df.mapInArrow(work, schema)


def read_back(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Add ``payload`` and ``feature`` (binary, 8 bytes), both from the stored file alone."""
    df, schema = _rest(df, {"payload": T.BinaryType(), "feature": T.BinaryType()})

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, media_col):
                images = [read_png(x) for x in part.column(part.schema.get_field_index(media_col)).to_pylist()]
                columns = [pa.array([x.tobytes() for x in images], pa.binary()), pa.array([cosine_hash(x) for x in images], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return df.mapInArrow(work, schema)
