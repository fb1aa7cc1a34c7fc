"""WARC records in ZIP-packaged archives: writing, and reading by ranges without extraction.

An archive is a ZIP file with two stored (not deflated) members:
`archive/data.warc.gz`, every record a gzip member of its own, and
`indexes/data.idx`, one line of fixed width per record with its offset and
length. A reader parses the ZIP's end record, the ZIP64 records where there
are any and the central directory, and then reads only the index lines and
record ranges that it was asked for.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.storage import materialize, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/data.idx"
ARCHIVE_BYTES, SLICE = 64 << 20, 500
LINE = 32
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:x-page:"


@dataclass
class Record:
    page_id: int | None
    kind: str
    digest: str
    refers_to: int | None
    payload: bytes
    payload_bytes: int


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header, with the length, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page_id(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix(_ID)
    return None if number == "null" else int(number)


def unpack_record(raw: bytes) -> Record:
    """The record of a gzip member; a payload that differs from its digest is an error."""
    plain = zlib.decompress(raw, 31)
    at = plain.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in plain[:at].decode().split("\r\n")[1:])
    block = plain[at + 4 : at + 4 + int(fields["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:])
    payload, digest, kind = block[cut + 4 :], fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (digest_of(payload) != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload and digest differ")
    return Record(_page_id(fields["WARC-Record-ID"]), kind, digest, _page_id(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload, int(http["Content-Length"]))


class ArchiveWriter:
    """Streams records into one archive."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, record: bytes) -> None:
        self.data.write(record)
        self.lines.append(b"%020d %010d\n" % (self.size, len(record)))
        self.size += len(record)

    def close(self) -> int:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), b"".join(self.lines))
        self.zip.close()
        return len(self.lines)


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class ArchiveReader:
    """Reads members of a ZIP file in place. source needs read(n), seek(at) and size."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        got = self.source.read(n)
        if len(got) != n:
            raise ValueError("the archive ends early")
        return got

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - (1 << 16) - 22 - 20)
        tail = self._read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack("<HLL", tail[end + 10 : end + 20])
        if tail[max(0, end - 20) : end][:4] == b"PK\x06\x07":
            big = self._read(struct.unpack("<Q", tail[end - 12 : end - 4])[0], 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory where its locator points")
            count, length, at = struct.unpack("<QQQ", big[32:56])
        raw, spot = self._read(at, length), 0
        for _ in range(count):
            if raw[spot : spot + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory entry")
            method = struct.unpack("<H", raw[spot + 10 : spot + 12])[0]
            packed, size = struct.unpack("<LL", raw[spot + 20 : spot + 28])
            n_name, n_extra, n_note = struct.unpack("<HHH", raw[spot + 28 : spot + 34])
            header = struct.unpack("<L", raw[spot + 42 : spot + 46])[0]
            name = raw[spot + 46 : spot + 46 + n_name].decode()
            extra, x = raw[spot + 46 + n_name : spot + 46 + n_name + n_extra], 0
            while x + 4 <= len(extra):
                tag, width = struct.unpack("<HH", extra[x : x + 4])
                if tag == 1:  # the fields that are full in the entry follow here, in this order
                    wide = list(struct.unpack(f"<{width // 8}Q", extra[x + 4 : x + 4 + width // 8 * 8]))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                x += 4 + width
            yield Member(name, method, size, header)
            spot += 46 + n_name + n_extra + n_note

    def read(self, name: str, at: int, n: int) -> bytes:
        """n bytes of a stored member from at on."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        if at + n > member.size:
            raise ValueError(f"{name} has {member.size} bytes")
        if name not in self._starts:
            local = self._read(member.header, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("bad local header")
            self._starts[name] = member.header + 30 + sum(struct.unpack("<HH", local[26:30]))
        return self._read(self._starts[name] + at, n)

    def records(self, first: int, count: int) -> Iterator[Record]:
        """The records first to first + count - 1, as far as there are any."""
        count = min(count, self.members[INDEX].size // LINE - first)
        if count > 0:
            lines = self.read(INDEX, first * LINE, count * LINE)
            for i in range(count):
                offset, length = map(int, lines[i * LINE : (i + 1) * LINE].split())
                yield unpack_record(self.read(DATA, offset, length))


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        writer = out = name = None
        for batch in batches:
            for page_id, url, payload, top in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "top")), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.zip"  # a lost attempt's archive is in no manifest
                    out = store.open_output_stream(f"{base}/{name}")
                    writer = ArchiveWriter(out)
                writer.add(pack_record(page_id, url, payload, top, top is not None and page_id != top))
                if writer.size >= ARCHIVE_BYTES:
                    done.append((f"{folder}/{name}", writer.close()))
                    out.close()
                    writer = None
        if writer is not None:
            done.append((f"{folder}/{name}", writer.close()))
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64()))], names=["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, at_least: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) into archives under folder; returns the manifest (path, records).

    Of records with equal payloads of at least at_least bytes the one with
    the largest page_id is a response and the others revisit it; rows that
    repeat this page_id are responses too. A null html has an empty payload,
    a null url no target. Of equal payloads whose page_ids are all null each
    is a response; beside others a null page_id revisits. Other columns are
    ignored; an empty table gives an empty manifest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    shared = F.when(F.length("payload") >= at_least, F.sha1("payload"))
    groups = rows.select("page_id", shared.alias("sha")).where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("sha", "top")
    marked = rows.withColumn("sha", shared).join(materialize(groups, "payloads"), "sha", "left").select("page_id", "url", "payload", "top")
    return materialize(marked.mapInArrow(_write(folder), "path string, records long"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist(), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as source:
                rows = [(r.page_id, r.payload_bytes, r.digest, r.kind, r.refers_to, r.payload) for r in ArchiveReader(source, source.size()).records(first, SLICE)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives of a manifest, by slices of SLICE records: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    slices = manifest.where("records > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(SLICE).cast("long"))).alias("first"))
    return slices.repartition(F.xxhash64("path", "first")).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """What reading back gives for every page."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, at_least)).drop("payload")
