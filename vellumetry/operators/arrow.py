"""Rows in and out of Arrow batches, one at a time, so that a task holds a bounded number of bytes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows and bytes of text or data after which a batch is sent.
ROWS, BYTES = 2000, 4 << 20
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows as Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def packed(made: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of the rows made, by a schema as Spark writes it; a map is a list of pairs."""
    fields = re.findall(r"(\w+) ([\w<>]+(?:,\w+>)?)", schema)
    kinds = pa.schema([(name, _KINDS[kind]) for name, kind in fields])
    sized = [i for i, (_, kind) in enumerate(fields) if kind in ("string", "binary")]

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(column, f.type) for column, f in zip(zip(*held), kinds)], schema=kinds)

    held, size = [], 0
    for r in made:
        held.append(r)
        size += sum(len(r[i]) for i in sized if r[i] is not None)
        if len(held) >= ROWS or size >= BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
