"""WARC archives: write, normalise to one gzip member per record, read back.

An archive that was compressed as one stream cannot be entered in the middle.
The normaliser inflates each such file once, front to back, writes every
record as a gzip member of its own into a new file, and a sidecar index with a
line per record: offset, length, type, record id. Readers then go straight to
any record. Memory holds one record and one read buffer at a time.

Files are listed in tables written to the shared folder; a task that runs
again writes files under new names, and only those of the task that finished
are listed.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage
from docloom.session import shared_dir

FILE_BYTES = 256 << 20  # payload of one archive
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the profile of revisit records.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PAGES = "page_id long, url string, payload binary, kind string, refers_to long"
_FILES = "path string, records long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    number = record_id[len("<urn:page:") : -1] if record_id else ""
    return int(number) if number else None


def record(page_id, url, payload: bytes, kind: str, refers_to) -> bytes:
    """One WARC record. A revisit has the HTTP head only, with the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[3:3] = [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches, folder):
    """Monolithic archives of a task's pages."""
    system, base = _place(folder)
    system.create_dir(base, recursive=True)
    out = squeeze = name = None
    records = size = 0
    for batch in batches:
        for page in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "kind", "refers_to"))):
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                out, squeeze, records, size = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
            raw = record(*page)
            out.write(squeeze.compress(raw))
            records, size = records + 1, size + len(raw)
            if size >= FILE_BYTES:
                out.write(squeeze.flush())
                out.close()
                yield _table([f"{folder}/{name}"], [records])
                out = None
    if out is not None:
        out.write(squeeze.flush())
        out.close()
        yield _table([f"{folder}/{name}"], [records])


def _table(paths, records):
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64())], ["path", "records"])


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, a buffer at a time."""
    member = zlib.decompressobj(31)
    begun = False
    while data := stream.read(READ_BYTES):
        while data:
            begun = True
            while True:
                piece = member.decompress(data, READ_BYTES)
                if piece:
                    yield piece
                data = member.unconsumed_tail
                if member.eof or not data:
                    break
            if member.eof:
                data, member, begun = member.unused_data, zlib.decompressobj(31), False
    if begun and not member.eof:
        raise ValueError("the gzip stream ends early")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, head to closing blank lines, from a stream of bytes."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                lines = bytes(held[:end]).split(b"\r\n")
                lengths = [int(x.split(b":", 1)[1]) for x in lines if x.lower().startswith(b"content-length:")]
                if not lines[0].startswith(b"WARC/") or len(lengths) != 1:
                    raise ValueError("not a WARC record")
                need = end + 4 + lengths[0] + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the last record ends early")


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record head, HTTP head and payload of one record."""
    head, _, block = raw[:-4].partition(b"\r\n\r\n")
    http, _, payload = block.partition(b"\r\n\r\n")

    def fields(lines):
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}

    return fields(head), fields(http), payload


def _normalise(batches, folder):
    """Each listed archive with a member per record, and its index."""
    system, base = _place(folder)
    system.create_dir(base, recursive=True)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            source, inner = _place(path)
            name, records, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
            _, target = _place(name)
            with source.open_input_stream(inner, compression=None) as stream, system.open_output_stream(target, compression=None) as out, system.open_output_stream(f"{target}.idx") as index:
                for raw in split_records(inflate(stream)):
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = squeeze.compress(raw) + squeeze.flush()
                    head = parse(raw)[0]
                    out.write(member)
                    index.write(f"{at}\t{len(member)}\t{head['warc-type']}\t{head['warc-record-id']}\n".encode())
                    at, records = at + len(member), records + 1
            yield _table([name], [records])


def _read(batches):
    """The records of normalised archives, each entered by its index line."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, inner = _place(path)
            with system.open_input_stream(f"{inner}.idx") as stream:
                lines = io.TextIOWrapper(io.BufferedReader(stream), "utf-8").read().splitlines()
            with system.open_input_file(inner) as archive:
                for start in range(0, len(lines), 1024):
                    yield _rows(archive, [line.split("\t") for line in lines[start : start + 1024]])


def _rows(archive, entries):
    out = [[] for _ in range(6)]
    for offset, length, kind, record_id in entries:
        archive.seek(int(offset))
        head, http, payload = parse(zlib.decompress(archive.read(int(length)), 31))
        if head["warc-record-id"] != record_id or head["warc-type"] != kind:
            raise ValueError("the index does not fit the archive")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        size = int(http["content-length"])
        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
            raise ValueError("the payload does not fit its digest")
        for k, x in enumerate((_page_of(record_id), size, digest, kind, _page_of(head.get("warc-refers-to")), head["warc-target-uri"])):
            out[k].append(x)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], [x.split()[0] for x in _RECORDS.split(", ")])


def revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as records: of equal payloads with ``least`` bytes or more the one
    with the smallest id is the response, others revisit it."""
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    first = rows.groupBy("sha", "size").agg(F.min("page_id").alias("first"))
    again = (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, ["sha", "size"]).select(
        "page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to")
    )


def write_archives(records: DataFrame) -> DataFrame:
    """``(path, records)`` of monolithic archives in a new shared folder."""
    folder = shared_dir(records.sparkSession, "warc")
    return stage(records.mapInArrow(partial(_write, folder=folder), _FILES), "warc-list")


def _dealt(files: DataFrame) -> DataFrame:
    """A file per task."""
    return files.repartition(max(1, files.count()))


def normalise(files: DataFrame) -> DataFrame:
    """``(path, records)`` of the normalised copies of ``files(path)``; a
    copy's index is beside it, with ``.idx`` added to its name. Raises for a
    stream that is cut off or holds anything else than WARC records."""
    folder = shared_dir(files.sparkSession, "warc-members")
    return stage(_dealt(files).mapInArrow(partial(_normalise, folder=folder), _FILES), "members-list")


def read_archives(files: DataFrame) -> DataFrame:
    """A row per record of normalised archives: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url."""
    return _dealt(files).mapInArrow(_read, _RECORDS)


def archive_pages(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Pages written as archives, normalised, and read back: a row per page.

    A null html is an empty payload, a null url an empty one (it comes back
    null), a null id stays null and names no response unless all ids of equal
    payloads are null. Rows that share the smallest id are all responses. Line
    ends in urls are dropped. Other columns are ignored.
    """
    read = read_archives(normalise(write_archives(revisits(pages, least, **columns))))
    return read.withColumn("url", F.when(F.col("url") != "", F.col("url")))
