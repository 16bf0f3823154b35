"""WARC archives: a writer, a normaliser for files that are one gzip stream, and a reader by offset index.

An archive whose records share one gzip stream can only be read from its start. ``normalise`` inflates such a stream
once, in pieces, and writes every record as a gzip member of its own, with a sidecar file ``<archive>.idx`` of one line
per record: offset, length, type and record id. ``read_records`` then seeks to single members.

Files are written by the tasks through the file system that the folder's address names, under names no other attempt
uses, and count only if they are in the manifest, a table that Spark commits. A lost or repeated task leaves files that
no manifest names. Memory is bounded by the longest record, not by the archive.

Defined cases: a null payload is empty. Ids may be null (written as ``null``) and may repeat; of equal payloads all rows
with the smallest id are responses, the rest revisits; null ids count as largest. Line ends in an address are escaped.
Empty tables give empty manifests. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import scratch, stored

#: Bytes of records after which a writer starts another archive.
ROLL_BYTES = 64 << 20
_PIECE = 1 << 20
_MANIFEST = "archive STRING, records LONG, bytes LONG"
RECORDS = (
    "archive STRING, offset LONG, length LONG, page_id LONG, url STRING, payload_bytes LONG, payload_digest STRING, "
    "record_type STRING, refers_to LONG, intact BOOLEAN"
)


def _open(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address else address.replace("file:", "", 1))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page is None else str(page).encode())


def _page(name: bytes) -> int | None:
    found = name.removeprefix(b"<urn:page:").removesuffix(b">")
    return None if found == b"null" else int(found)


def record(page, url: str | None, payload: bytes, kind: str, refers_to=None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, which tells the payload's length, and drops the payload."""
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: " + _name(page),
        b"WARC-Target-URI: " + target,
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + digest(payload).encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if kind == "revisit":
        head[3:3] = [
            b"WARC-Refers-To: " + _name(refers_to),
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields and all bytes of each record of an inflated stream."""
    held = bytearray()
    pieces = iter(pieces)

    def fill(done) -> bool:
        while not done():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(lambda: b"\r\n\r\n" in held):
        cut = held.index(b"\r\n\r\n") + 4
        fields = _fields(bytes(held[:cut]))
        end = cut + int(fields[b"content-length"]) + 4
        if not fill(lambda: len(held) >= end):
            raise ValueError("an archive ends inside a record")
        yield fields, bytes(held[:end])
        del held[:end]
    if held.strip():
        raise ValueError("an archive ends inside a header")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, be it one member or many."""
    inflate = zlib.decompressobj(31)
    while piece := stream.read(_PIECE):
        while piece:
            yield inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def _typed(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, url, html, kind, refers_to``: which rows repeat a payload, decided on digests only."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    revisit = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "sha").select(
        "page_id", "url", "html",
        F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archives of one gzip stream each, as some crawlers leave them; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        out = squeeze = None
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, url, html, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, n, size = system.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                raw = record(page, url, html.encode(), kind, refers)
                out.write(squeeze.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= ROLL_BYTES:
                    out.write(squeeze.flush())
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            done.append((name, n, size))
        yield _rows(done, ["archive", "records", "bytes"])

    return stored(_typed(pages, min_bytes).mapInArrow(run, _MANIFEST), folder, "manifest")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names=names)


def normalise(manifest: DataFrame, source: str, folder: str) -> DataFrame:
    """Every archive of the manifest with one member per record and its sidecar index; returns the new manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, path), (target, to) = _open(source), _open(folder)
        target.create_dir(to, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                at = n = 0
                with (
                    system.open_input_stream(f"{path}/{name}", compression=None) as stream,
                    target.open_output_stream(f"{to}/{new}", compression=None) as out,
                    target.open_output_stream(f"{to}/{new}.idx", compression=None) as index,
                ):
                    for fields, raw in records_of(inflated(stream)):
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        out.write(member)
                        index.write(
                            b"%d %d %s %s\n" % (at, len(member), fields[b"warc-type"], fields[b"warc-record-id"])
                        )
                        at, n = at + len(member), n + 1
                yield _rows([(new, n, at)], ["archive", "records", "bytes"])

    files = max(1, manifest.count())
    return stored(manifest.repartition(files).mapInArrow(run, _MANIFEST), folder, "manifest")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record, each read by its own offset.

    Length and digest of a response are those of the payload read; ``intact`` tells whether its headers say the same.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{path}/{name}.idx", compression=None) as stream:
                    lines = stream.read().splitlines()
                with system.open_input_file(f"{path}/{name}") as archive:
                    for k in range(0, len(lines), 1000):
                        rows = [_read(archive, name, *map(int, x.split()[:2])) for x in lines[k : k + 1000]]
                        yield pa.RecordBatch.from_pylist(
                            [dict(zip(names, r)) for r in rows],
                            schema=pa.schema(
                                [(n, {"LONG": pa.int64(), "STRING": pa.string(), "BOOLEAN": pa.bool_()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))]
                            ),
                        )

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, RECORDS)


def _read(archive, name: str, offset: int, length: int) -> tuple:
    archive.seek(offset)
    raw = zlib.decompress(archive.read(length), 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields[b"content-length"])].partition(b"\r\n\r\n")
    kind, refers = fields[b"warc-type"].decode(), fields.get(b"warc-refers-to")
    told, size = fields[b"warc-payload-digest"].decode().removeprefix("sha1:"), int(_fields(http)[b"content-length"])
    # A revisit holds no payload: its length and digest are those of the record it refers to, as its headers tell.
    found = (len(payload), digest(payload)) if kind == "response" else (size, told)
    return (
        name, offset, length, _page(fields[b"warc-record-id"]), fields[b"warc-target-uri"].decode(),
        *found, kind, None if refers is None else _page(refers), found == (size, told),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0, root: str | None = None) -> DataFrame:
    """Pages written to archives of one stream, normalised, and read back record by record; a damaged one is an error."""
    root = root or scratch(pages.sparkSession, "warc")
    raw = write_archives(pages, f"{root}/raw", min_bytes)
    read = read_records(normalise(raw, f"{root}/raw", f"{root}/members"), f"{root}/members")
    damaged = F.raise_error(F.concat(F.lit("damaged payload in "), "archive", F.lit(" at byte "), "offset")).cast("boolean")
    return read.where(F.when(F.col("intact"), True).otherwise(damaged))
