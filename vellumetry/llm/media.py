"""Media columns: payloads stored as images in archives, read by a Spark data source.

Writing: each task packs its rows into uncompressed tar archives in the shared folder. A payload is an
8-bit greyscale PNG, 192 samples wide, one byte a sample, so it is stored losslessly; the length before
padding is in a text chunk. Beside each archive lies a sidecar of member offsets.

Reading: the data source ``media_archive`` lists the folder and plans partitions as byte ranges over
the archives. A range owns the members whose header starts in it. Payloads come in Arrow batches of a
few MB. Each member is read by its own offset and tried again by itself; one that stays unreadable
becomes a row with ``error`` and no payload, and the rest of its range is read all the same.

Archives have names that follow from the partition, and appear by a move, so a task that runs twice
leaves one copy.

Defined results: null text is the empty text, which is one row of 192 spaces; a null doc_id stays null;
repeated rows are members of their own; an empty table makes an empty folder and an empty result.
"""

from __future__ import annotations

import hashlib

import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import Files, make_folder, opened, put
from .common import shared_folder, written

WIDTH = 192
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
#: Byte ranges that a read is planned in at most, beside one more an archive.
RANGES = 50_000
BATCH_BYTES = 4 << 20
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b" " * (-len(data) % WIDTH if data else WIDTH), len(data)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, length: int) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # filter type 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % length) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + _chunk(b"IEND", b"")


def decode_image(data: bytes) -> tuple[bytes, int]:
    """(payload, length before padding) of an image made by encode_image; checks every CRC."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, parts, length, rows = 8, [], -1, 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad CRC in {kind!r}")
        if kind == b"IHDR":
            rows = struct.unpack(">I", body[4:8])[0]
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(rows, WIDTH + 1)
    return raw[:, 1:].tobytes(), length


def feature_of(payload: bytes) -> str:
    """A 64-cell average hash of the samples, and their mean and spread in tenths."""
    x = np.frombuffer(payload, dtype=np.uint8)
    edges = np.arange(64) * len(x) // 64
    cells = np.add.reduceat(x.astype(np.int64), edges) * 64
    bits = cells > x.sum(dtype=np.int64)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}-{int(x.mean() * 10)}-{int(x.std() * 10)}"


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Pack doc_id and text of every row; returns (archive, members, bytes), already written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, k, parts, index, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/media-{number:06d}-{k:04d}.tar"
            put(name, [*parts, b"\0" * 1024])
            put(name[:-4] + ".idx", [np.array(index, dtype="<i8").tobytes()])
            return pa.record_batch([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([size], pa.int64())], names=["archive", "members", "bytes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = encode_image(*padded(text))
                info = tarfile.TarInfo("null.png" if doc_id is None else f"{doc_id}.png")
                info.size = len(image)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                index.append((size, size + len(head), len(image), zlib.crc32(image)))
                parts += [head, image, b"\0" * (-len(image) % 512)]
                size += len(head) + len(image) + (-len(image) % 512)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    k, parts, index, size = k + 1, [], [], 0
        if index:
            yield flush()

    make_folder(folder)
    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "archive string, members long, bytes long"))


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaArchives(DataSource):
    """Options: path (a folder of archives), manifest (a stored table of the archives' names and sizes: only
    these are read; without it all in the folder), range_bytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, payload binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.manifest = options["path"], options.get("manifest")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        store, path = opened(self.manifest or self.path)
        if self.manifest:
            table = dataset(path, filesystem=store, format="parquet").to_table(columns=["archive", "bytes"])
            known = zip(table["archive"].to_pylist(), table["bytes"].to_pylist())
        else:
            known = ((f"{self.path}/{i.base_name}", i.size) for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.endswith(".tar"))
        known = list(known)
        # Ranges grow with the total, so that the driver plans RANGES of them and one more an archive at most.
        step = max(self.range_bytes, -(-sum(size for _, size in known) // RANGES))
        return [ByteRange(name, at, min(at + step, size)) for name, size in known for at in range(0, size, step)]

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without archives
            return
        files, rows, held = Files(self.tries), [], 0
        index = np.frombuffer(files.read(part.archive[:-4] + ".idx"), dtype="<i8").reshape(-1, 4)
        mine = index[(index[:, 0] >= part.start) & (index[:, 0] < part.end)]
        for header, start, size, crc in mine.tolist():
            lead = start - header
            try:
                # A member is read again by its offset, alone, if it does not come whole or its checksum is wrong.
                data = files.read(part.archive, header, lead + size, lambda d: zlib.crc32(d[lead:]) == crc)
                rows.append((part.archive, header, tarfile.TarInfo.frombuf(data[:512], "utf-8", "strict").name, data[lead:], None))
            except (OSError, tarfile.HeaderError) as e:
                rows.append((part.archive, header, None, None, str(e)))
            held += size
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        files.close()
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "offset", "name", "payload", "error"])


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").options(path=folder, **options).load()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(members: DataFrame) -> DataFrame:
    """What the stored members hold: lengths, digests and a perceptual feature of each."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data, error in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_id = None if name in (None, "null.png") else int(name[:-4])
                if data is None:
                    rows.append((doc_id, *[None] * 7, error))
                    continue
                try:
                    payload, length = decode_image(data)
                except (ValueError, zlib.error) as e:
                    rows.append((doc_id, *[None] * 7, str(e)))
                    continue
                rows.append((doc_id, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload), None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return members.select("name", "payload", "error").mapInArrow(measure, FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = shared_folder(spark)
    manifest = write_archives(docs, folder)
    return features(read_archives(spark, folder, manifest=manifest._written))
