"""Word shingles as 64-bit hashes, computed over whole Arrow batches with numpy.

A text is lower-cased over A-Z only and cut into words ``[^\\x20\\x09-\\x0D]+``; both are done on the
UTF-8 bytes. A document's set holds the hashes of its distinct ``width``-word shingles; a text with
fewer words has one shingle, the whole sequence; a text without words has the empty set.

A word's hash is a polynomial over its bytes modulo 2**64, read off prefix sums, so the cost does not
depend on how many different words there are and nothing is cached between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_RATIO = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RATIO, -1, 2**64)
_STEP = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Bytes hashed at a time; a document longer than this makes a chunk of its own.
CHUNK_BYTES = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += _U(32)
_COEFFICIENT = mix(_FOLDED * _U(0xD6E8FEB86659FD93) + _U(1))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES, n)
    if size not in _POWERS:
        ups, downs = (np.full(size, x, dtype=_U) for x in (_RATIO, _INVERSE))
        ups[0] = downs[0] = 1
        made = np.cumprod(ups, dtype=_U), np.cumprod(downs, dtype=_U)
        if size > CHUNK_BYTES:
            return made
        _POWERS[size] = made
    return _POWERS[size]


def words_in(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its start, its end, first word of each document and the end of the last)."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=_U), none, none, np.zeros(len(offsets), dtype=np.int64)
    blank = gap[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    left, right = edge[:-1].copy(), edge[1:].copy()
    left[1:] |= blank[:-1]
    right[:-1] |= blank[1:]
    starts = np.flatnonzero(left & ~blank)
    ends = np.flatnonzero(right & ~blank) + 1
    ups, downs = _powers(n)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_COEFFICIENT[data] * ups[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(_U))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def combine(w: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes, in order of position."""
    n = max(0, len(w) - width + 1)
    h = np.zeros(n, dtype=_U)
    for i in range(width):
        h = (h ^ w[i : i + n]) * _STEP[i % len(_STEP)]
        h ^= h >> _U(29)
    return mix(h + _U(width))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of at most CHUNK_BYTES."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a string column; null counts as empty."""
    for first, last, data, offsets in chunks(column):
        words, _, _, at = words_in(data, offsets)
        runs = combine(words, width)
        for i in range(last - first):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                s = np.sort(runs[a : b - width + 1])
                keep = np.ones(len(s), dtype=bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            else:
                yield combine(words[a:b], int(b - a)) if b > a else words[:0]
