"""WARC archives with segmented records: writer, reader and segment reassembly.

``write`` turns rows into WARC/1.1 records.  The payload sits in an HTTP
message with chunked transfer framing; a block over ``segment_bytes`` is cut
into a first record (segment number 1) and continuation records that name its
id as origin; the last carries the total length.  Every record is its own gzip
member; archives are bytes of such members, and segments of one record may lie
in different archives.  ``read`` parses the members, groups segments by origin
id, orders them by number, verifies numbers and total length, and decodes the
chunked framing.  ``response`` records hold the payload; ``revisit`` records
hold headers only and name the record they refer to, by page and by record id.

Defined results: null payload is empty; repeated rows give separate records
with the same contents (ids carry an ordinal; revisits of a page that has
several rows name the page alone); columns other than id, url and payload do
not travel; a broken archive raises.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MB, tidy

CRLF = b"\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = b"2024-01-01T00:00:00Z"


def chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(framed: bytes) -> bytes:
    """Body of a chunked HTTP message; extensions and trailers are allowed, anything else raises."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        size = framed[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("bad chunk size")
        n = int(size, 16)
        at = end + 2
        if not n:
            break
        if framed[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk of another length")
        out.append(framed[at : at + n])
        at += n + 2
    while (end := framed.find(CRLF, at)) != at:  # trailer fields
        if end < 0:
            raise ValueError("no end of the chunked message")
        at = end + 2
    return b"".join(out)


def record(kind: str, rid: str, block: bytes, fields: dict[str, str], level: int = 1) -> bytes:
    """One gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{rid}>", **fields}
    lines = [b"WARC/1.1", b"WARC-Date: " + DATE, *[f"{k}: {v}".encode() for k, v in head.items()], b"Content-Length: %d" % len(block)]
    return gzip.compress(CRLF.join(lines) + CRLF * 2 + block + CRLF * 2, compresslevel=level, mtime=0)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an archive of gzip members."""
    view = memoryview(archive)
    while view:
        d = zlib.decompressobj(31)
        data = d.decompress(view)
        if not d.eof:
            raise ValueError("truncated gzip member")
        view, at = view[len(view) - len(d.unused_data) :], 0
        while at < len(data):
            end = data.find(CRLF * 2, at)
            if end < 0 or not data.startswith(b"WARC/1.", at):
                raise ValueError("no WARC header")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:])}
            n = int(fields["content-length"])
            block = data[end + 4 : end + 4 + n]
            at = end + 8 + n
            if len(block) != n or data[end + 4 + n : at] != CRLF * 2:
                raise ValueError("record block of another length")
            yield fields, block


def page_records(page_id: int | None, ordinal: str, url: str | None, payload: bytes, refers_to: int | None, kept: str | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations.

    ``kept`` names the one response of a payload that others revisit: its id
    follows from that name alone, so that they can tell it, in any archive.
    """
    shared = kept and str(uuid.uuid5(SPACE, f"kept/{kept}"))
    rid = shared if shared and refers_to is None else str(uuid.uuid5(SPACE, f"{page_id}/{ordinal}"))
    digest = hashlib.sha1(payload).hexdigest()
    fields = {"WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload))}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield record("revisit", rid, head, fields | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Date": DATE.decode(), "X-Refers-To-Page": str(refers_to)} | ({"WARC-Refers-To": f"<urn:uuid:{shared}>"} if shared else {}))
        return
    block = head + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record("response", rid, block, fields)
        return
    n = -(-len(block) // segment_bytes)
    for i in range(n):
        part = block[i * segment_bytes : (i + 1) * segment_bytes]
        if i == 0:
            yield record("response", rid, part, fields | {"WARC-Segment-Number": "1"})
        else:
            more = {"WARC-Segment-Origin-ID": f"<urn:uuid:{rid}>", "WARC-Segment-Number": str(i + 1)}
            yield record("continuation", str(uuid.uuid5(SPACE, f"{rid}/{i + 1}")), part, more | ({"WARC-Segment-Total-Length": str(len(block))} if i == n - 1 else {}))


def decide(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(page_id, url, deflated, refers_to, kept): of equal payloads of ``min_bytes`` or more, the largest id is kept, the others refer to it.

    ``kept`` names the kept page and its payload, on its row and on those that
    refer to it, unless it has several rows.

    Only digests are grouped; payloads travel to the join once, deflated.
    Rows of one id and payload (repeats) beyond it count as records of their
    own; a null id never is the largest and refers to one that is not null.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    per = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n", "page_id").agg(F.count("*").alias("own"))
    last = per.groupBy("digest", "n").agg(F.max(F.struct("page_id", "own")).alias("last"), F.sum("own").alias("copies")).where("copies > 1").select("digest", "n", F.col("last.page_id").alias("keeper"), F.col("last.own").alias("own"))

    @tidy
    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([zlib.compress(x.as_py(), 1) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, *batch.columns[3:]], names=["page_id", "url", "deflated", "digest", "n"])

    out = rows.mapInArrow(deflate, "page_id long, url string, deflated binary, digest string, n int").join(last, ["digest", "n"], "left")
    refers_to = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return out.select("page_id", "url", "deflated", refers_to.alias("refers_to"), F.when(F.col("own") == 1, F.concat_ws("/", F.col("keeper").cast("string"), "digest")).alias("kept"))


def write(rows: DataFrame, segment_bytes: int = 16384, chunk_bytes: int = 4096, archive_mb: float = 1) -> DataFrame:
    """(archive, content) from the rows of ``decide``: one row per archive of about ``archive_mb``.

    Segments of a page go to the archives in turn (four open at a time), so that a reader must reassemble them.
    """

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no, made, turn, count = _partition(), 0, 0, 0
        open_: list[list[bytes]] = [[] for _ in range(4)]
        sizes = [0] * 4

        def close(k: int) -> pa.RecordBatch:
            nonlocal made
            out = pa.RecordBatch.from_arrays([pa.array([f"part-{part_no:06d}-{made:06d}.warc.gz"]), pa.array([b"".join(open_[k])], pa.binary())], names=["archive", "content"])
            made, open_[k], sizes[k] = made + 1, [], 0
            return out

        for batch in batches:
            for row in batch.to_pylist():
                count += 1
                for member in page_records(row["page_id"], f"{part_no}-{count}", row["url"], zlib.decompress(row["deflated"]), row["refers_to"], row["kept"], segment_bytes, chunk_bytes):
                    open_[turn].append(member)
                    sizes[turn] += len(member)
                    if sizes[turn] >= archive_mb * MB:
                        yield close(turn)
                    turn = (turn + 1) % 4
        for k in range(4):
            if open_[k]:
                yield close(k)

    return rows.mapInArrow(work, "archive string, content binary")


def _partition() -> int:
    from pyspark import TaskContext

    own = TaskContext.get()
    return own.partitionId() if own else 0


SEGMENT = "origin string, segment int, kind string, page_id long, refers_to long, digest string, payload_length long, total long, block binary"


def segments(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per WARC record, its block deflated; ``archives`` may come from ``write`` or from ``spark.read.format('binaryFile')``."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_length", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
        number = lambda x: int(x) if x else None
        for batch in batches:
            for content in batch.column(batch.schema.get_field_index(content_col)).to_pylist():
                rows = [
                    (
                        f.get("warc-segment-origin-id", f["warc-record-id"]), int(f.get("warc-segment-number", 1)), f["warc-type"], number(f.get("x-page-id")), number(f.get("x-refers-to-page")),
                        f.get("warc-payload-digest", "").removeprefix("sha1:"), number(f.get("x-payload-length")), number(f.get("warc-segment-total-length")), zlib.compress(block, 1),
                    )
                    for f, block in parse(content)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return archives.select(content_col).mapInArrow(work, SEGMENT)


def reassemble(parts: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, payload): one row per origin.

    A group is one record's own segments, as large as the record and no more.
    Payloads come from responses; a revisit's digest and length are those of
    the full payload, as its header states them, and its payload is null.
    """
    first = lambda c: F.max(F.when(F.col("kind") != "continuation", F.col(c)))
    whole = parts.groupBy("origin").agg(
        *[first(c).alias(c) for c in ("kind", "page_id", "refers_to", "digest", "payload_length")],
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    schema = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    names = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                out = []
                for r in batch.slice(lo, 64).to_pylist():
                    own = r["parts"]
                    if [x["segment"] for x in own] != list(range(1, len(own) + 1)):
                        raise ValueError(f"segments of {r['origin']} are missing or doubled")
                    block = b"".join(zlib.decompress(x["block"]) for x in own)
                    if len(own) > 1 and r["total"] != len(block):
                        raise ValueError(f"{r['origin']} has {len(block)} bytes, not {r['total']}")
                    if r["kind"] == "revisit":
                        out.append((r["page_id"], "revisit", r["refers_to"], r["digest"], r["payload_length"], None))
                        continue
                    head, _, body = block.partition(CRLF * 2)
                    payload = unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body
                    digest = hashlib.sha1(payload).hexdigest()
                    if digest != r["digest"] or len(payload) != r["payload_length"]:
                        raise ValueError(f"{r['origin']} has another payload than its header states")
                    out.append((r["page_id"], r["kind"], None, digest, len(payload), payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()])], names=names)

    return whole.select("origin", "kind", "page_id", "refers_to", "digest", "payload_length", "total", "parts").mapInArrow(work, schema)


def read(archives: DataFrame, content_col: str = "content") -> DataFrame:
    return reassemble(segments(archives, content_col))
