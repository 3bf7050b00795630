"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

A file holds one compressed member per record. Of equal payloads the one with the largest page_id
is written in full, the others are revisits that name it. The reader checks each member (gzip
trailer, version line, lengths, block digest); where a check fails it searches for the next member
or version line that passes, goes on from there and logs the byte gap it left. It reads in steps and
holds one member unpacked, up to ``Salvage.limit`` bytes; a larger record is logged as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import new_folder, written
from runnel.llm.op4_token_stream import open_folder

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
STEP = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id, url: str, payload: bytes | None, digest: str, size: int, refers_to) -> bytes:
    """One record, uncompressed; payload None makes a revisit."""
    block = payload if payload is not None else b""
    head = {
        "WARC-Type": "response" if payload is not None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": _DATE,
        # a header is one line
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "WARC-Payload-Length": str(size),
    }
    if payload is None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    at: int


@dataclass
class Salvage:
    """Iterates the valid records of a stream; ``gaps`` has (first byte, end) of what was skipped.

    A record of more than ``limit`` bytes, unpacked, counts as damaged and is a gap too: a false or
    hostile member is given up there. A reader of larger records raises it.
    """

    source: object
    limit: int = 1 << 30
    gaps: list[tuple[int, int]] = field(default_factory=list)
    _data: bytearray = field(default_factory=bytearray)
    _at: int = 0  # place in the file of the buffer's first byte
    _end: bool = False

    def _more(self) -> bool:
        if not self._end:
            got = self.source.read(STEP)
            self._end = not got
            self._data += got
        return not self._end

    def _drop(self, n: int) -> None:
        del self._data[:n]
        self._at += n

    def _member(self) -> tuple[bytes, int] | None:
        """The member at the buffer's start, unpacked, and its packed length; None if it is damaged."""
        z, out, fed, size = zlib.decompressobj(31), [], 0, 0
        try:
            while not z.eof:
                if fed == len(self._data) and not self._more():
                    return None
                part = bytes(self._data[fed : fed + STEP])
                out.append(z.decompress(part))
                fed += len(part)
                size += len(out[-1])
                if size > self.limit:
                    return None
        except zlib.error:
            return None
        return b"".join(out), fed - len(z.unused_data)

    @staticmethod
    def _parsed(data: bytes, at: int) -> tuple[Record, int] | None:
        """The record at the start of ``data`` and its length, if every check passes."""
        m = re.match(rb"WARC/1\.[0-9]\r\n((?:[^\r\n]+\r\n)*)\r\n", data)
        if not m:
            return None
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in m[1].decode("utf-8", "replace").split("\r\n") if x)}
        if not (n := headers.get("content-length", "")).isdigit():
            return None
        end = m.end() + int(n)
        block = data[m.end() : end]
        if len(block) < int(n) or data[end : end + 4] != b"\r\n\r\n":
            return None
        told = headers.get("warc-block-digest", "")
        if told.startswith("sha1:") and told[5:] != sha1_base32(block):
            return None
        return Record(headers, block, at), end + 4

    def _plain(self) -> tuple[Record, int] | None:
        """An uncompressed record at the buffer's start."""
        while b"\r\n\r\n" not in self._data[: 1 << 16] and len(self._data) < 1 << 16 and self._more():
            pass
        m = re.search(rb"(?i)\r\ncontent-length: *([0-9]{1,12})\r\n", self._data[: 1 << 16])
        head = self._data.find(b"\r\n\r\n")
        if not m or head < 0 or m.start() > head or int(m[1]) > self.limit:
            return None
        while len(self._data) < head + 8 + int(m[1]) and self._more():
            pass
        return self._parsed(bytes(self._data[: head + 8 + int(m[1])]), self._at)

    def __iter__(self) -> Iterator[Record]:
        lost = None
        while True:
            while len(self._data) < 16 and self._more():
                pass
            if not self._data:
                break
            got = None
            if self._data.startswith(MAGIC):
                if (member := self._member()) and (found := self._parsed(member[0], self._at)) and found[1] == len(member[0]):
                    got = found[0], member[1]
            elif self._data.startswith(VERSION):
                got = self._plain()
            if got:
                if lost is not None:
                    self.gaps.append((lost, self._at))
                    lost = None
                record, n = got
                self._drop(n)
                yield record
                continue
            lost = self._at if lost is None else lost
            self._drop(1)
            while True:  # to the next place where a record may start
                places = [p for p in (self._data.find(MAGIC), self._data.find(VERSION)) if p >= 0]
                if places:
                    self._drop(min(places))
                    break
                self._drop(max(0, len(self._data) - 8))
                if not self._more():
                    self._drop(len(self._data))
                    break
        if lost is not None:
            self.gaps.append((lost, self._at))


def kinds(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` with html (null: empty), payload_bytes, sha1 and target: the page that is written
    in full, or null for that page itself and for payloads under ``least`` bytes."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1("html"))
    full = rows.where(F.col("payload_bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").select("sha1", "target")
    # rows without a twin meet nothing; of rows that share the largest id each is a response
    found = rows.join(full, "sha1", "left")
    return found.withColumn("target", F.when(F.col("page_id") < F.col("target"), F.col("target")).when(F.col("page_id").isNull(), F.col("target")))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the records of ``pages`` (page_id, url, html); returns the manifest: file, records.

    Each task writes one file under a name of its own and only files of successful tasks are in
    the manifest. A null html is an empty payload, a null url an empty one. A page without an id
    is written as ``<urn:page:None>``; it revisits an equal page that has an id. Other columns are
    ignored; an empty table writes no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_folder(folder)
        name, sink, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page_id, url, html, size, sha1, target in zip(*(c.to_pylist() for c in batch.columns)):
                sink = sink or system.open_output_stream(f"{place}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                sink.write(z.compress(record_bytes(page_id, url, html if target is None else None, digest, size, target)) + z.flush())
                n += 1
        if sink:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n]})

    rows = kinds(pages, least).select("page_id", "url", "html", "payload_bytes", "sha1", "target")
    return written(rows.mapInArrow(write, "file string, records long"), "archives")


def read_archives(files: DataFrame) -> DataFrame:
    """One row per record of the archives in ``file``, and one per skipped gap.

    page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, file, at; a gap
    has record_type ``gap``, its first byte in ``at`` and its length in payload_bytes.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("at", pa.int64())])

    def page(text: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", text or "")
        return int(m[1]) if m else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, place = open_folder(file)
                with system.open_input_stream(place, compression=None) as source:
                    reader, rows, size = Salvage(source), [], 0
                    for r in reader:
                        h = r.headers
                        rows.append((page(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), int(h.get("warc-payload-length", len(r.block))), h.get("warc-payload-digest", "").removeprefix("sha1:"), page(h.get("warc-refers-to")), r.block, file, r.at))
                        size += len(r.block)
                        if len(rows) >= 500 or size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, size = [], 0
                    rows += [(None, None, "gap", b - a, None, None, None, file, a) for a, b in reader.gaps]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    ddl = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, at long"
    return files.select("file").repartitionByRange(max(1, files.count()), "file").mapInArrow(read, ddl)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the archives and back; one row per page."""
    folder = new_folder(spark, "warc")
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(files).where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - k % 4 * 5)) & 31) + 1)::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM h
"""
