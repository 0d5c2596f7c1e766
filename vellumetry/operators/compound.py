"""Names and sizes of the streams of compound files, from their bytes.

A compound file is a table of sector chains; its directory is one of these chains, whose entries form
a tree by numbers. Only the header, the allocation table and the directory are read. Chains and trees that come back
to where they were end there, so a crafted file costs no more than its own length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the format: its first bytes, the end of ordinary sector numbers, kinds of entries.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_SECTOR, NONE = 0xFFFFFFFA, 0xFFFFFFFF
STORAGE, STREAM, ROOT = 1, 2, 5


class _Sectors:
    """The sectors of a file and the chains they make."""

    def __init__(self, data: bytes):
        self.data = data
        self.major, self.shift = struct.unpack_from("<H", data, 26)[0], struct.unpack_from("<H", data, 30)[0]
        if not 7 <= self.shift <= 20:
            raise ValueError("no compound file")
        self.size = 1 << self.shift
        # The table's own sectors: 109 in the header, the others in a chain of lists.
        table = list(struct.unpack_from("<109I", data, 76))
        at, seen = struct.unpack_from("<I", data, 68)[0], set()
        while at < LAST_SECTOR and at not in seen:
            seen.add(at)
            row = np.frombuffer(self.sector(at), dtype="<u4")
            table += row[:-1].tolist()
            at = int(row[-1]) if len(row) else NONE
        parts = [np.frombuffer(self.sector(s), dtype="<u4") for s in table if s < LAST_SECTOR]
        self.next = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")

    def sector(self, n: int) -> bytes:
        piece = self.data[(n + 1) << self.shift : (n + 2) << self.shift]
        return piece[: len(piece) // 4 * 4]

    def chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < LAST_SECTOR and at not in seen:
            seen.add(at)
            out.append(self.sector(at))
            at = int(self.next[at]) if at < len(self.next) else NONE
        return b"".join(out)


def streams_of(data: bytes) -> list[tuple[str, int]]:
    """(path, size) of every stream; none for what is no compound file or cannot be read."""
    if data[:8] != MAGIC or len(data) < 512:
        return []
    try:
        file = _Sectors(data)
        directory = file.chain(struct.unpack_from("<I", data, 48)[0])
    except (struct.error, ValueError):
        return []
    entries = []
    for at in range(0, len(directory) // 128 * 128, 128):
        name, length, kind = directory[at : at + 64], *struct.unpack_from("<HB", directory, at + 64)
        left, right, child = struct.unpack_from("<III", directory, at + 68)
        size = struct.unpack_from("<Q", directory, at + 120)[0]
        # The high half of a size means nothing where sectors are of 512 bytes.
        entries.append((name[: max(min(length, 64) - 2, 0)].decode("utf-16-le", "replace"), kind, left, right, child, size & 0xFFFFFFFF if file.major < 4 else size))
    if not entries or entries[0][1] != ROOT:
        return []
    out, seen, todo = [], {0}, [(entries[0][4], "")]
    while todo:
        n, folder = todo.pop()
        if n >= len(entries) or n in seen:
            continue
        seen.add(n)
        name, kind, left, right, child, size = entries[n]
        todo += [(right, folder), (left, folder)]
        if kind == STREAM:
            out.append((folder + name, size))
        elif kind == STORAGE:
            todo.append((child, folder + name + "/"))
    return out


def compound_streams(files: DataFrame) -> DataFrame:
    """(doc_id, streams): names (with ``/`` between storages) and sizes of each file's streams; empty for other files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [[{"name": n, "size": s} for n, s in streams_of(bytes(c) if c is not None else b"")] for c in pdf["content"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "streams": pd.Series(rows, index=pdf.index)})

    return files.select("doc_id", "content").mapInPandas(read, "doc_id long, streams array<struct<name:string,size:long>>")
