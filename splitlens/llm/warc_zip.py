"""WARC records in ZIP packages: writer with revisit records, and a reader by byte ranges.

An archive is a ZIP file with two stored (uncompressed) members: ``data.warc.gz``, one gzip member
per WARC record, and ``index.cdxj``, one line per record with its offset and length.  The reader
parses the end-of-central-directory record, its ZIP64 form and the central directory, finds the
stored members, and reads records by range: nothing is extracted, and one archive can be read by
many tasks.

Archives are written by Spark tasks into the cluster's shared folder under names of their own; a
manifest table that Spark commits lists those that count, so the files of a lost or repeated task
attempt are never read.  The shared folder is opened through ``pyarrow.fs`` (file, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlens.llm.common import materialise
from splitlens.session import shared_dir

MIN_REVISIT_BYTES = 0
ARCHIVE_BYTES = 256 << 20   # an archive is closed at this size
RANGE_BYTES = 4 << 20       # records read by one row of the second reading step
WARC_DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "data.warc.gz", "index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- records

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """Header values stay on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = WARC_DATE) -> bytes:
    """One WARC response, or a revisit of page ``refers_to`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(raw: bytes) -> dict:
    """Fields of one record; a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    body = rest[:int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].partition(":")[2]
    page = lambda v: None if v is None or v == "<urn:page:none>" else int(v[len("<urn:page:"):-1])
    out = {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_digest": digest,
           "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to"))}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(_headers(http)["content-length"]), "payload": None}
    if payload_digest(payload) != digest:
        raise ValueError(f"payload of page {out['page_id']} does not match its digest")
    return out | {"payload_bytes": len(payload), "payload": payload}


# ---------------------------------------------------------------- ZIP directory

class ZipMember:
    def __init__(self, name: str, method: int, flags: int, size: int, header: int):
        self.name, self.method, self.flags, self.size, self.header = name, method, flags, size, header


def zip_members(read: Callable[[int, int], bytes], length: int) -> dict[str, ZipMember]:
    """Members by name, from the central directory.  ``read(offset, n)`` returns a byte range."""
    tail_at = max(0, length - (22 + 65535 + 20 + 56))
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        end64 = read(where, 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where its locator points")
        count, size, start = struct.unpack_from("<QQQ", end64, 32)
    directory, pos, out = read(start, size), 0, {}
    for _ in range(count):
        if directory[pos:pos + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, pos + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, pos + 20)
        header = struct.unpack_from("<I", directory, pos + 42)[0]
        name = directory[pos + 46:pos + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[pos + 46 + n_name:pos + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # ZIP64: only the fields that overflowed, in this order
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                if plain == 0xFFFFFFFF:
                    plain = values.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = values.pop(0)
                if header == 0xFFFFFFFF:
                    header = values.pop(0)
            e += 4 + n
        out[name] = ZipMember(name, method, flags, packed, header)
        pos += 46 + n_name + n_extra + n_comment
    return out


def stored_offset(read: Callable[[int, int], bytes], member: ZipMember) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0 or member.flags & 1:
        raise ValueError(f"{member.name} is compressed or encrypted; only stored members can be read by range")
    header = read(member.header, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra


# ---------------------------------------------------------------- writing

class _Archive:
    def __init__(self, folder: str):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.zip"
        self.out = files.open_output_stream(f"{path.rstrip('/')}/{self.name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.index = 0, io.StringIO()

    def add(self, url: str | None, kind: str, raw: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        blob = pack.compress(raw) + pack.flush()
        self.data.write(blob)
        line = {"mime": "text/html", "type": kind, "offset": self.at, "length": len(blob), "filename": DATA}
        self.index.write(f"{_clean(url or '-').replace(' ', '%20')} {WARC_DATE} {json.dumps(line)}\n")
        self.at += len(blob)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, self.index.getvalue().encode("utf-8", "surrogatepass"))
        self.zip.close()
        self.out.close()
        return self.name, self.at


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                page, url, payload, first = page.as_py(), url.as_py(), (html.as_py() or "").encode(), first.as_py()
                archive = archive or _Archive(folder)
                archive.add(url, "response" if first is None else "revisit", record(page, url, payload, first))
                if archive.at >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done]), pa.array([s for _, s in done], pa.int64())], names=["name", "bytes"])
    return run


def first_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier page (smaller id) has too."""
    keyed = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
                         F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).filter(F.col("size") >= min_bytes)
    keyed = materialise(keyed.filter("page_id IS NOT NULL").select("page_id", "digest"), "warc-digests")
    first = materialise(keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
                        .filter("refers_to <> last").select("digest", "refers_to"), "warc-first")
    return keyed.join(first, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html; others ignored) into ZIP archives
    below ``folder``; returns the committed manifest (name, bytes).

    A null html is an empty payload, a null url leaves the header out.  Of rows that repeat the
    smallest page_id of a payload all are responses.  Rows of a null page_id are responses and
    nothing refers to them.  No rows: no archives."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    again = first_pages(pages, min_bytes)
    rows = (pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
            .join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to"))
    return materialise(rows.mapInArrow(_write(folder, archive_bytes), "name string, bytes long"), "warc-manifest")


# ---------------------------------------------------------------- reading

def _open(folder: str, name: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    return files.open_input_file(f"{path.rstrip('/')}/{name}")


def _locate(folder: str, range_bytes: int):
    """For each archive: byte ranges of whole records, from the directory and the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with _open(folder, name) as f:
                    read = lambda at, n, f=f: f.read_at(n, at)
                    members = zip_members(read, f.size())
                    data = stored_offset(read, members[DATA])
                    index = read(stored_offset(read, members[INDEX]), members[INDEX].size).decode("utf-8", "surrogatepass")
                start, lengths, rows = None, [], []
                for line in index.split("\n")[:-1]:
                    at = json.loads(line.split(" ", 2)[2])
                    if lengths and sum(lengths) + at["length"] > range_bytes:
                        rows.append((name, start, lengths))
                        start, lengths = None, []
                    start = data + at["offset"] if start is None else start
                    lengths.append(at["length"])
                if lengths:
                    rows.append((name, start, lengths))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.int64())))],
                                                     names=["name", "start", "lengths"])
    return run


_FIELDS = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()))


def _fetch(folder: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(_FIELDS)
        for batch in batches:
            for name, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("name", "start", "lengths"))):
                with _open(folder, name) as f:
                    block = f.read_at(sum(lengths), start)
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse_record(zlib.decompress(block[at:at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in columns], names=columns)
    return run


def read_archives(manifest: DataFrame, folder: str, columns: tuple[str, ...] = tuple(c for c, _ in _FIELDS),
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives of a manifest, one row each; ``columns`` picks from page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    spark: SparkSession = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string",
             "record_type": "string", "refers_to": "long", "payload": "binary"}
    ranges = manifest.repartition(n, "name").mapInArrow(_locate(folder, range_bytes), "name string, start long, lengths array<long>")
    return (ranges.repartition(n, "name", "start")
            .mapInArrow(_fetch(folder, list(columns)), ", ".join(f"{c} {kinds[c]}" for c in columns)))


def pages_through_archives(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read all records back."""
    folder = shared_dir(pages.sparkSession, "warc-archives")
    manifest = write_archives(pages, folder, min_bytes)
    return read_archives(manifest, folder, ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"))
