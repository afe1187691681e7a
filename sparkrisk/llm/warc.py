"""WARC records in seekable Zstandard bundles (operator 5).

A bundle is a run of independent Zstandard frames, each with whole records, followed by two skippable frames:
the record index (identifiers mapped to frame and offset inside the frame) and, last, the seek table of the
published seekable format (compressed and decompressed size of every frame). A reader finds the table from
the end, and decompresses only the frame that holds a wanted record.

Bundles are written as rows of a table in shared storage, so any store that Spark writes to will do.
Payloads that occur again become revisit records of the first one.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, small_side

#: Raw bytes after which a frame, and a bundle, is closed (one record may be larger).
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
LEVEL = 3
#: Payloads of fewer bytes are always stored in full.
LEAST_BYTES = 100
#: Fixed values of the seekable format: skippable frame of the seek table, its footer, and of our index.
SEEK_FRAME, SEEK_FOOTER, INDEX_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50

BUNDLE = "bundle string, data binary, records bigint"


def record(record_id: str, kind: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no block but names the digest and size of the full payload."""
    block = payload if kind == "response" else b""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, level: int = LEVEL):
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.known: set[str] = set()
        self.open: list[bytes] = []
        self.open_bytes = self.raw_bytes = 0

    def add(self, record_id: str, data: bytes) -> None:
        self.known.add(record_id)
        self.index.append((record_id, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)
        self.raw_bytes += len(data)
        if self.open_bytes >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append(self.compress(b"".join(self.open)))
            self.sizes.append(self.open_bytes)
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        """The bundle: frames, index, seek table."""
        self._close_frame()
        rows = "\n".join(f"{frame} {offset} {size} {key}" for key, frame, offset, size in self.index)
        index = self.compress(rows.encode())
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes))
        table += struct.pack("<IBI", len(self.frames), 0, SEEK_FOOTER)
        return b"".join([*self.frames, struct.pack("<II", INDEX_FRAME, len(index)), index,
                         struct.pack("<II", SEEK_FRAME, len(table)), table])


class Bundle:
    """Reader of one bundle: single records by identifier, or all in order."""

    def __init__(self, data: bytes):
        self.data = data
        n, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEK_FOOTER:
            raise ValueError("no seek table at the end")
        sizes = list(struct.iter_unpack("<II", data[len(data) - 9 - 8 * n:-9]))
        self.starts, self.raw, at = [], [], 0
        for packed, raw in sizes:
            self.starts.append((at, at + packed))
            self.raw.append(raw)
            at += packed
        magic, length = struct.unpack("<II", data[at:at + 8])
        if magic != INDEX_FRAME:
            raise ValueError("no record index after the frames")
        self._plain = zstandard.ZstdDecompressor().decompress
        self.places: dict[str, tuple[int, int, int]] = {}
        for line in self._plain(data[at + 8:at + 8 + length]).decode().split("\n"):
            if line:
                frame, offset, size, key = line.split(" ", 3)
                self.places[key] = int(frame), int(offset), int(size)
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self._last[0] != number:
            start, end = self.starts[number]
            self._last = number, self._plain(self.data[start:end], max_output_size=self.raw[number])
        return self._last[1]

    def read(self, record_id: str) -> tuple[dict[str, str], bytes]:
        """The record of an identifier, from the one frame that holds it."""
        frame, offset, size = self.places[record_id]
        return parse_record(self.frame(frame)[offset:offset + size])


def first_copies(pages: DataFrame, page_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(digest, first) of payloads of at least LEAST_BYTES that occur more than once: the smallest page id.

    Only digests move, summed in each task first, so a payload that a third of all pages share is one row a task.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    return (pages.select(F.col(page_col).alias("p"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n"))
            .where(F.col("n") >= LEAST_BYTES).groupBy("digest")
            .agg(F.min("p").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"))


def bundles(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (bundle, data, records): archives of all pages, one record per row.

    Record identifiers are "urn:page:<page id>"; where a bundle has that already, a number follows. NULL html is the empty
    payload, NULL urls are empty; other columns are not read; an empty table gives no bundle. The first copies
    are broadcast if a count proves them few, else joined by a shuffle whose large partitions Spark splits.
    """
    firsts = small_side(first_copies(pages, page_col, html_col))
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(page_col).cast("bigint").alias("p"), F.coalesce(F.col(url_col), F.lit("")).alias("u"),
                        payload.alias("h"), F.sha2(F.encode(payload, "utf-8"), 256).alias("d"))
    rows = rows.join(firsts, rows["d"] == firsts["digest"], "left").select(
        "p", "u", "h", "d", F.when(F.col("first").isNotNull() & ~F.col("p").eqNullSafe(F.col("first")),
                                   F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()
        for batch in batches:
            for p, u, h, d, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
                data = h.encode()
                kind = "response" if first is None else "revisit"
                key = f"urn:page:{'' if p is None else p}"
                if key in writer.known:
                    key += f":{len(writer.index)}"
                writer.add(key, record(key, kind, u, data, d, len(data), f"urn:page:{first}"))
                if writer.raw_bytes >= BUNDLE_BYTES:
                    yield _bundle_row(writer)
                    writer = BundleWriter()
        if writer.index:
            yield _bundle_row(writer)

    return rows.mapInArrow(write, BUNDLE)


def _bundle_row(writer: BundleWriter) -> pa.RecordBatch:
    data = writer.finish()
    name = hashlib.sha256(data).hexdigest()[:32] + ".warc.zst"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([len(writer.index)], pa.int64())],
                                      ["bundle", "data", "records"])


RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record of the bundles, read through their indexes: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A response's payload is hashed anew and must agree with its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                bundle, rows = Bundle(data), []
                for key in bundle.places:
                    headers, block = bundle.read(key)
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    size, refers_to = int(headers["X-Payload-Length"]), None
                    if kind == "response":
                        if hashlib.sha256(block).hexdigest() != digest or len(block) != size:
                            raise ValueError(f"{key}: the payload does not agree with its header")
                    else:
                        refers_to = int(headers["WARC-Refers-To"].strip("<>").split(":")[2])
                    page = key.split(":")[2]
                    rows.append((int(page) if page else None, size, digest, kind, refers_to))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("data").mapInArrow(read, RECORD)


def archive(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The bundles of ``pages``, written to the shared folder and reread (bundle, data, records)."""
    return Steps(pages.sparkSession, "warc").keep(bundles(pages, page_col, url_col, html_col))
