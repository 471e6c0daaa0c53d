"""WARC archives as seekable Zstandard bundles (operator 2).

A bundle is a run of independent Zstandard frames, each holding whole WARC 1.1 records, and a footer: a
skippable frame with the seek table of the public seekable format (compressed and plain size of each
frame). The index (Parquet) maps a record to bundle, frame, and its offset and length in the plain
frame, so that one record is read by decompressing one frame.

Payloads that repeat are written once. Of the records with equal payloads (SHA-1 and length) the one
with the largest id is a ``response``; the others are ``revisit`` records of the identical-payload-digest
profile, which carry the HTTP headers with the full length, the digest and the response they refer to.
The choice is an aggregate by digest with partial sums on the map side; only digests that do repeat are
joined back, and Spark may split a digest's rows over tasks. Bundles are read back in as many tasks as there are.

A response is named by its id and its payload's digest, a revisit by its id and its place, so record ids
are unique unless a row is repeated as a whole.

Defined cases: a null payload is empty; a null url gives no WARC-Target-URI; a null id is written
without a number and, as the only id of a payload, is not referred to; rows that share the largest id
of a payload are all responses, and such rows with one id are one record written twice; payloads below
``min_revisit`` bytes are all responses; control characters in a url are percent-encoded; a payload longer
than a frame has a frame of its own, and is the most that a task holds; an empty table gives no bundles;
further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import pieces, utf8
from corpuslab.llm.files import create, make_dir, open_file
from corpuslab.session import work_dir

#: Fixed values of the public formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Plain bytes of a frame, unless one record has more, and compressed bytes after which a new bundle starts.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 512 << 20
INDEX = "record_id bigint, bundle string, frame int, frame_offset bigint, record_length bigint"


def _urn(record_id: int | None, kind: str, rest: str) -> str:
    return f"<urn:corpuslab:{kind}:{'' if record_id is None else record_id}:{rest}>"


def _id_of(urn: bytes) -> int | None:
    return int(x) if (x := urn.split(b":")[3]) else None


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(record_id: int | None, url: bytes | None, payload: bytes, refers_to: int | None, date: str, place: str = "") -> bytes:
    """One WARC record: a revisit if it refers to another, else a response; place names a revisit among those of its id."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind, urn = ("response", _urn(record_id, "response", digest)) if refers_to is None else ("revisit", _urn(record_id, "revisit", place))
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + urn.encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + _urn(refers_to, "response", digest).encode(), b"WARC-Profile: " + REVISIT_PROFILE.encode()]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(plain: bytes, at: int = 0) -> tuple[dict[bytes, bytes], bytes, int]:
    """(headers, block, place behind) of the record at a place of a plain frame."""
    body = plain.index(b"\r\n\r\n", at) + 4
    first, *lines = plain[at : body - 4].split(b"\r\n")
    if first != b"WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(b": ", 1) for line in lines)
    end = body + int(headers[b"Content-Length"])
    return headers, plain[body:end], end + 4


class BundleWriter:
    """Frames of whole records, then the seek table."""

    def __init__(self, stream, level: int = 3):
        self._stream, self._zstd = stream, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._frames: list[tuple[int, int]] = []
        self._held: list[bytes] = []
        self._size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self._held and self._size + len(data) > FRAME_BYTES:
            self._flush()
        at = len(self._frames), self._size
        self._held.append(data)
        self._size += len(data)
        return at

    def _flush(self) -> None:
        frame = self._zstd.compress(b"".join(self._held))
        self._stream.write(frame)
        self._frames.append((len(frame), self._size))
        self.written += len(frame)
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._held:
            self._flush()
        table = b"".join(struct.pack("<2I", *x) for x in self._frames) + struct.pack("<IBI", len(self._frames), 0, SEEKABLE_MAGIC)
        self._stream.write(struct.pack("<2I", SKIPPABLE_MAGIC, len(table)) + table)


class BundleReader:
    """Any frame of a bundle by its number; nothing but the footer and the frame asked for is read."""

    def __init__(self, file):
        self._file, size = file, file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        sizes = struct.unpack(f"<{2 * n}I", self._at(size - 9 - 8 * n, 8 * n))
        self._sizes = list(zip(sizes[::2], sizes[1::2], strict=True))
        self._starts = [0]
        for packed, _ in self._sizes:
            self._starts.append(self._starts[-1] + packed)

    def _at(self, place: int, n: int) -> bytes:
        self._file.seek(place)
        return self._file.read(n)

    def __len__(self) -> int:
        return len(self._sizes)

    def frame(self, i: int) -> bytes:
        packed, plain = self._sizes[i]
        return zstandard.ZstdDecompressor().decompress(self._at(self._starts[i], packed), max_output_size=plain)


def with_references(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(record_id, url, payload) and refers_to, the id of the response that a revisit refers to."""
    keyed = pages.withColumn("digest", F.sha1(F.coalesce(F.col("payload"), F.lit(b"")))).withColumn("payload_bytes", F.coalesce(F.octet_length("payload"), F.lit(0)))
    repeated = (
        keyed.filter(F.col("payload_bytes") >= min_revisit)
        .groupBy("digest", "payload_bytes")
        .agg(F.count(F.lit(1)).alias("n"), F.max("record_id").alias("largest"))
        .filter("n > 1")
        .drop("n")
    )
    return keyed.join(repeated, ["digest", "payload_bytes"], "left").select(
        "record_id", "url", "payload", F.when(~F.col("record_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", min_revisit: int = 0) -> DataFrame:
    """Write (record_id, url, payload) as bundles below ``folder``; returns the index, stored there too."""
    spark = pages.sparkSession
    make_dir(spark, f"{folder}/bundles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = TaskContext.get().partitionId(), pieces(batches)
        batch, at = next(rows, None), 0
        while batch is not None:
            placed = []
            with create(f"{folder}/bundles", f"part-{task:06d}", ".warc.zst") as (name, stream):
                bundle = BundleWriter(stream)
                while batch is not None and bundle.written < BUNDLE_BYTES:
                    ids, refers = batch.column(0).to_pylist(), batch.column(3).to_pylist()
                    for record_id, url, payload, refers_to in zip(ids, utf8(batch.column(1)), utf8(batch.column(2)), refers, strict=True):
                        data = record(record_id, url, payload or b"", refers_to, date, f"{name}:{len(placed)}")
                        placed.append((record_id, name, *bundle.add(data), len(data)))
                    batch = next(rows, None)
                bundle.close()
            names = ["record_id", "bundle", "frame", "frame_offset", "record_length"]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*placed, strict=True), types, strict=True)], names)

    rows = with_references(pages, min_revisit)
    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


RECORDS = "record_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _row(headers: dict[bytes, bytes], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers[b"WARC-Type"].decode(), headers[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "response" and sha1_base32(payload) != digest:
        raise ValueError(f"the payload of {headers[b'WARC-Record-ID']!r} doesn't have its digest")
    n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    refers = headers.get(b"WARC-Refers-To")
    url = headers.get(b"WARC-Target-URI")
    return {
        "record_id": _id_of(headers[b"WARC-Record-ID"]), "url": None if url is None else url.decode("utf-8", "replace"), "record_type": kind, "payload_bytes": n,
        "payload_digest": digest, "refers_to": None if refers is None else _id_of(refers), "payload": payload if kind == "response" else None,
    }


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of all bundles of the index; digests of responses are computed again and compared."""
    schema = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_file(f"{folder}/bundles", name) as file:
                    bundle = BundleReader(file)
                    for i in range(len(bundle)):
                        plain, at, rows = bundle.frame(i), 0, []
                        while at < len(plain):
                            headers, block, at = parse(plain, at)
                            row = _row(headers, block)
                            rows.append(row if payloads else row | {"payload": None})
                        yield pa.RecordBatch.from_pylist(rows, schema)

    # every bundle begins with one record; a number that is given isn't merged by adaptive execution, as these rows are tiny
    bundles = spark.read.parquet(f"{folder}/index").filter("frame = 0 AND frame_offset = 0").select("bundle")
    return bundles.repartitionByRange(max(1, bundles.count()), "bundle").mapInArrow(run, RECORDS)


def fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """The records of the ids in ``wanted`` (record_id), by index look-up. Places are sorted: a frame that
    holds any of them is decompressed once, and a bundle's footer is read once in each task."""
    spark = wanted.sparkSession
    schema = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, bundle, plain = (None, -1), None, None, b""
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["bundle"] != now[0]:
                        if file:
                            file.close()
                        file = open_file(f"{folder}/bundles", row["bundle"])
                        bundle = BundleReader(file)
                    if (row["bundle"], row["frame"]) != now:
                        now, plain = (row["bundle"], row["frame"]), bundle.frame(row["frame"])
                    headers, block, _ = parse(plain, row["frame_offset"])
                    found = _row(headers, block)
                    yield pa.RecordBatch.from_pylist([{k: found[k] for k in schema.names}], schema)
        finally:
            if file:
                file.close()

    index = spark.read.parquet(f"{folder}/index").join(wanted.select("record_id").distinct(), "record_id")
    places = index.repartitionByRange("bundle", "frame").sortWithinPartitions("bundle", "frame", "frame_offset")
    return places.mapInArrow(run, "record_id bigint, record_type string, payload_digest string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write the archives of (record_id, url, payload) and read them back."""
    folder = work_dir(pages.sparkSession, "warc")
    write(pages, folder, min_revisit=min_revisit)
    return read(pages.sparkSession, folder, payloads=False)


#: The digest's hex to RFC 4648 base32 in DuckDB: five bits at a time.
ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (
  SELECT hex, payload_bytes, max(page_id) AS largest FROM p GROUP BY hex, payload_bytes),
bits AS (
  SELECT hex, string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(hex, i::INT, 1))::INT - 3, 4), '' ORDER BY i) AS b
  FROM g, range(1, 41) t(i) GROUP BY hex),
b32 AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(b, (5 * j + 1)::INT, 1)::INT + 8 * substr(b, (5 * j + 2)::INT, 1)::INT + 4 * substr(b, (5 * j + 3)::INT, 1)::INT + 2 * substr(b, (5 * j + 4)::INT, 1)::INT + substr(b, (5 * j + 5)::INT, 1)::INT, 1), '' ORDER BY j) AS payload_digest
  FROM bits, range(0, 32) t(j) GROUP BY hex)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, b32.payload_digest,
       CASE WHEN p.page_id IS DISTINCT FROM g.largest AND g.largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM g.largest THEN g.largest END AS refers_to
FROM p JOIN g ON p.hex = g.hex AND p.payload_bytes = g.payload_bytes JOIN b32 ON p.hex = b32.hex
"""
