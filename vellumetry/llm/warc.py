"""WARC: pages written as records of whole-file gzip streams, normalised to one member a record.

``write_streams`` writes each task's pages as WARC/1.1 records into gzip files of a single stream each,
which can only be read from the start. ``normalise`` inflates such a stream once, from front to back in
small pieces, and rewrites every record as a gzip member of its own, with a sidecar index of offset,
length and record id. ``read_records`` then fetches records by offset, in any order.

Of records whose payloads are equal (by SHA-1 and length) and have at least ``least`` bytes, the one
with the largest page_id is the response and the others revisit it. A revisit record carries headers
only: its digest, the length of the payload, and the record it refers to.

Defined results: null html is the empty payload; a null page_id is written without an id and read as
null, and such a page is never the response of others; repeated rows with the largest page_id are all
responses; an empty table gives an empty result. Control characters in a URL are percent-encoded. Of
several rows with the largest page_id all are responses, and what revisits them names the page. A very long
html is one record, inflated whole, other records beside it are not. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archives import Files, make_folder, opened, put, writing
from .common import broadcast_if_small, shared_folder, written

LEAST = 1000
#: Inflated bytes of one stream, and of one piece while it is normalised.
STREAM_BYTES, PIECE = 64 << 20, 1 << 16
_END = b"\r\n\r\n"


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html and, for revisits, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    groups = sized.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = written(groups.where("n > 1 and first is not null").drop("n"))
    out = sized.join(broadcast_if_small(shared), ["digest", "size"], "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return out.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None) -> bytes:
    payload = (html or "").encode()
    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Target-URI: {safe}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + _END + body + _END


def write_streams(planned: DataFrame, folder: str) -> DataFrame:
    """(archive, records) of the monolithic gzip files."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, k, n, size, parts, z = TaskContext.get().partitionId(), 0, 0, 0, [], zlib.compressobj(1, zlib.DEFLATED, 31)

        def flush() -> pa.RecordBatch:
            name = f"{folder}/whole-{number:06d}-{k:04d}.warc.gz"
            put(name, [*parts, z.flush()])
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(*row)
                parts.append(z.compress(data))
                n, size = n + 1, size + len(data)
                if size >= STREAM_BYTES:
                    yield flush()
                    k, n, size, parts, z = k + 1, 0, 0, [], zlib.compressobj(1, zlib.DEFLATED, 31)
        if n:
            yield flush()

    make_folder(folder)
    return written(planned.mapInArrow(pack, "archive string, records long"))


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream that comes in pieces of any size."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(_END)
                if end < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("not at the start of a record")
                need = end + 4 + int(headers_of(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"{len(held)} bytes after the last record")


def headers_of(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _inflated(uri: str) -> Iterator[bytes]:
    store, path = opened(uri)
    z = zlib.decompressobj(31)
    with store.open_input_stream(path, compression=None) as f:
        while block := f.read(PIECE):
            yield z.decompress(block)
            while z.eof and z.unused_data:  # streams may follow one another
                rest, z = z.unused_data, zlib.decompressobj(31)
                yield z.decompress(rest)
    if not z.eof:
        raise ValueError(f"{uri} ends inside a gzip stream")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive named in ``archive``; returns (archive, records) of the new files.

    Records go out as they come in: a task holds one record and the index of one archive."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = f"{folder}/{name.rpartition('/')[2].replace('whole-', 'split-')}"
                at, index = 0, []
                with writing(new) as out:
                    for data in records_of(_inflated(name)):
                        z = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        index.append(f"{at} {len(member)} {headers_of(data[: data.index(_END)])['warc-record-id']}\n".encode())
                        out.write(member)
                        at += len(member)
                put(new[:-8] + ".cdx", index)
                yield pa.record_batch([pa.array([new]), pa.array([len(index)], pa.int64())], names=["archive", "records"])

    make_folder(folder)
    n = max(1, min(archives.count(), 4 * archives.sparkSession.sparkContext.defaultParallelism))
    return written(archives.select("archive").repartition(n).mapInArrow(rewrite, "archive string, records long"))


def read_index(archives: DataFrame) -> DataFrame:
    """(archive, offset, length, id) of every record, from the sidecar of each archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = [line.split(" ") for line in files.read(name[:-8] + ".cdx").decode().splitlines()]
                offset, length, record_id = zip(*rows) if rows else ((), (), ())
                columns = [pa.array([name] * len(rows), pa.string()), *(pa.array(map(int, c), pa.int64()) for c in (offset, length)), pa.array(record_id, pa.string())]
                yield pa.record_batch(columns, names=["archive", "offset", "length", "id"])
        files.close()

    return archives.select("archive").mapInArrow(read, "archive string, offset long, length long, id string")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def read_records(index: DataFrame) -> DataFrame:
    """One row a record, fetched by its offset and inflated alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = zlib.decompress(files.read(name, offset, length), 31)
                cut = data.index(_END)
                h = headers_of(data[:cut])
                body = data[cut + 4 : cut + 4 + int(h["content-length"])]
                payload = body[body.index(_END) + 4 :]
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                response = h["warc-type"] == "response"
                found = hashlib.sha1(payload).hexdigest() if response else digest
                size = len(payload) if response else int(h["x-payload-length"])
                page, to = h.get("x-page-id"), h.get("x-refers-to-page")
                rows.append((page and int(page), size, found, h["warc-type"], to and int(to), found == digest))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])
        files.close()

    return index.select("archive", "offset", "length").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    whole = write_streams(plan(pages), shared_folder(spark))
    return read_records(read_index(normalise(whole, shared_folder(spark))))
