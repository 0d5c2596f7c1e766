"""Page pictures: crops and perceptual signatures, in one pass over Arrow batches.

A raster column is a struct (height, width, data) with data the RGB bytes row by row; ``from_image``
turns Spark's image source, whose bytes are grey, BGR or BGRA, into it. ``page_facts`` opens a picture
once for everything that is asked of it and holds one picture at a time.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PIXELS, SIDE = 100_000_000, 1024
#: Lobes of the kernel that pictures are resampled with.
LOBES = 3
#: Pictures whose facts a task remembers, by their digests.
KNOWN = 4096
#: Weights that a matrix may have; a picture's signature takes no more than 32 * SIDE.
DENSE = 1 << 15
TRIM = T.StructType().add("crop_height", T.IntegerType()).add("removed_percent", T.DoubleType()).add("background", T.StringType())
FOCUS = T.StructType().add("crop_box", T.ArrayType(T.IntegerType())).add("removed_percent", T.DoubleType())
HASHES = T.StructType().add("phash", T.StringType()).add("colorhash", T.StringType())


def pixels(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3)


def from_image(image: Column) -> Column:
    """Spark's image struct as a raster: one, three or four channels become red, green and blue."""
    return F.struct(image["height"].alias("height"), image["width"].alias("width"), to_rgb(image["data"], image["nChannels"]).alias("data"))


@F.pandas_udf(T.BinaryType())
def to_rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
    def one(b: bytes | None, n: int) -> bytes | None:
        if b is None:
            return None
        a = np.frombuffer(b, dtype=np.uint8).reshape(-1, int(n))
        return np.repeat(a, 3, axis=1).tobytes() if n == 1 else a[:, 2::-1].tobytes()

    return pd.Series([one(b, n) for b, n in zip(data, channels)])


class Bands:
    """A picture as its bands: of equal rows that follow each other one (``rows``), and how many there are (``heights``).

    Most of a page's rows are like the row before, so that what goes row by row is done once for each band."""

    def __init__(self, a: np.ndarray):
        flat = a.reshape(len(a), -1)
        first = np.concatenate(([0], np.flatnonzero((flat[1:] != flat[:-1]).any(axis=1)) + 1))
        self.shape, self.corner, self.rows, self.heights = a.shape, a[-1, -1], a[first], np.diff(first, append=len(a))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(colours, pixels) of the runs of equal pixels in each band."""
        high, wide = self.rows.shape[:2]
        x = self.rows.reshape(-1, 3)
        code = x[:, 0].astype(np.int32)
        for i in (1, 2):
            code <<= 8
            code |= x[:, i]
        new = np.ones(len(x), dtype=bool)
        np.not_equal(code[1:], code[:-1], out=new[1:])
        new[::wide] = True
        first = np.flatnonzero(new)
        return x[first], np.diff(first, append=high * wide) * self.heights[first // wide]


def deviation(a: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Largest difference from the background over the channels, for each pixel."""
    far = np.abs(a.astype(np.int16) - background.astype(np.int16))
    return np.maximum(np.maximum(far[..., 0], far[..., 1]), far[..., 2])


def sampled_hot(a: np.ndarray, background: np.ndarray, tolerance: int, axis: int) -> np.ndarray:
    """Whether a row (axis 0) or column (axis 1) differs, looking at about 64 places of it."""
    other = 1 - axis
    step = max(1, a.shape[other] // 64)
    some = a[:, ::step] if axis == 0 else a[::step]
    return deviation(some, background).max(axis=other) > tolerance


def trim_bottom(a: np.ndarray, tolerance: int = 10, least: float = 0.05, bands: Bands | None = None) -> dict | None:
    """Cut the plain part at the bottom, keeping a margin; None if that is not worth it."""
    h, w = a.shape[:2]
    if w * h > MAX_PIXELS:
        return None
    background = a[-1, -1]
    bands = bands or Bands(a)
    hot = np.flatnonzero(np.repeat(sampled_hot(bands.rows, background, tolerance, 0), bands.heights))
    if not len(hot):
        return None
    last = int(hot[-1])
    crop = min(h, last + 1 + max(20, int((last + 1) * 0.05)))
    removed = 1 - crop / h
    if removed < 0.1 or crop < least * h:
        return None
    return {"crop_height": crop, "removed_percent": round(removed * 100, 1), "background": "#" + background.tobytes().hex()}


def focus(a: np.ndarray, tolerance: int = 10, least: float = 0.08, bands: Bands | None = None) -> dict | None:
    """The box that holds the content on a plain background; None if little would go or it is a sliver."""
    h, w = a.shape[:2]
    if w * h > MAX_PIXELS:
        return None
    bands = bands or Bands(a)
    far = deviation(bands.rows, bands.corner) > tolerance
    if not far.any():
        return None
    full = np.flatnonzero(np.count_nonzero(far, axis=1) >= max(10, int(0.01 * w)))
    if len(full):
        cols = np.flatnonzero(far[full[0] : full[-1] + 1].any(axis=0))
        last = np.cumsum(bands.heights)
        rows = (last[full[0]] - bands.heights[full[0]], last[full[-1]] - 1)
    else:
        rows, cols = (np.flatnonzero(sampled_hot(a, a[-1, -1], tolerance, x)) for x in (0, 1))
    if not len(rows) or not len(cols):
        return None
    top, bottom, left, right = int(rows[0]), int(rows[-1]) + 1, int(cols[0]), int(cols[-1]) + 1
    my, mx = max(12, int((bottom - top) * 0.03)), max(12, int((right - left) * 0.03))
    top, bottom, left, right = max(0, top - my), min(h, bottom + my), max(0, left - mx), min(w, right + mx)
    bw, bh = right - left, bottom - top
    removed = 1 - bw * bh / (w * h)
    original, aspect = max(w / h, h / w), max(bw / bh, bh / bw)
    if removed < least or (bw, bh) == (w, h) or min(bw, bh) < 64 or aspect > max(8.0, original * 2.5):
        return None
    return {"crop_box": [left, top, right, bottom], "removed_percent": round(removed * 100, 1)}


@lru_cache(64)
def windowed_sinc(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, weights): where each of the new samples begins in the old ones, and its weights of these (LOBES lobes
    of a sinc under the first lobe of a wider one). Going down, the kernel is as wide as the step."""
    step = old / new
    wide = max(step, 1.0)
    centre = (np.arange(new) + 0.5) * step
    first = np.maximum((centre - LOBES * wide + 0.5).astype(int), 0)
    last = np.minimum((centre + LOBES * wide + 0.5).astype(int), old)
    taps = np.arange((last - first).max())
    x = (first[:, None] + taps + 0.5 - centre[:, None]) / wide
    weights = np.where((np.abs(x) < LOBES) & (first[:, None] + taps < last[:, None]), np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return first, weights / weights.sum(axis=1, keepdims=True)


@lru_cache(64)
def sinc_matrix(old: int, new: int) -> np.ndarray:
    """The weights of ``windowed_sinc`` as a matrix from the old samples to the new ones."""
    first, weights = windowed_sinc(old, new)
    out = np.zeros((new, old))
    np.add.at(out, (np.arange(new)[:, None], np.minimum(first[:, None] + np.arange(weights.shape[1]), old - 1)), weights)
    return out


def resampled(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """A picture of bytes at another size: across, then down, each rounded to bytes; a side that stays is not touched.

    Small steps are one product with a matrix; large ones go weight by weight, as their matrix is mostly empty."""
    for axis, new in ((1, width), (0, height)):
        if a.shape[axis] == new:
            continue
        rows = np.moveaxis(a, axis, 0)
        if new * len(rows) <= DENSE:
            out = sinc_matrix(len(rows), new) @ rows.reshape(len(rows), -1).astype(np.float64)
            a = np.moveaxis(np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8).reshape(new, *rows.shape[1:]), 0, axis)
            continue
        first, weights = windowed_sinc(len(rows), new)
        out = np.zeros((new, *rows.shape[1:]))
        shape = (new, *[1] * (a.ndim - 1))
        for k in range(weights.shape[1]):
            out += weights[:, k].reshape(shape) * rows[np.minimum(first + k, len(rows) - 1)]
        a = np.moveaxis(np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8), 0, axis)
    return a


def _light(a: np.ndarray) -> np.ndarray:
    """Luminance times 1000."""
    return a[..., 0] * np.int32(299) + a[..., 1] * np.int32(587) + a[..., 2] * np.int32(114)


@lru_cache(1)
def _cosines() -> np.ndarray:
    n = np.arange(32)
    return np.cos(np.pi * (2 * n[None, :] + 1) * n[:8, None] / 64)


def phash(a: np.ndarray, bands: Bands | None = None) -> str:
    """64 bits of the low cosine coefficients above their median, most significant first.

    Coefficients are rounded, so that a flat picture has its one coefficient and no noise."""
    bands = bands or Bands(a)
    light = np.rint(_light(bands.rows) / 1000).astype(np.uint8)
    small = resampled(np.repeat(resampled(light, len(light), 32), bands.heights, axis=0), 32, 32).astype(np.float64)
    cosine = _cosines()
    low = np.round(cosine @ small @ cosine.T, 6).ravel()
    bits = low > np.median(low)
    if not bits.any() and low[0] == 0:  # black: the same signature as any flat picture
        bits[0] = False
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def colorhash(a: np.ndarray, bands: Bands | None = None) -> str:
    """14 hex digits: black, grey, six faint and six bright hues.

    Black and grey are shares of all pixels, hues are shares of the coloured ones of their kind. Each run of
    equal pixels is looked at once and counts for all its pixels."""
    x, n = (bands or Bands(a)).runs()
    top, low = (f(f(x[:, 0], x[:, 1]), x[:, 2]).astype(np.int32) for f in (np.maximum, np.minimum))
    span = top - low
    black = _light(x) < 32_000
    grey = ~black & (3 * span < top)
    rest = ~black & ~grey
    c, top, span, much = x[rest].astype(np.float64), top[rest], span[rest], n[rest]
    r, g, b = ((top - c[:, i]) / np.maximum(span, 1) for i in range(3))
    hue = np.where(top == c[:, 0], b - g, np.where(top == c[:, 1], 2 + r - b, 4 + g - r))
    bin_of = (hue % 6).astype(int) % 6
    bright = 3 * span > 2 * top
    faint = ~bright
    every, coloured = n.sum(), max(1, int(much.sum()))
    shares = [n[black].sum() / every, n[grey].sum() / every]
    for part in (faint, bright):
        shares += list(np.bincount(bin_of[part], weights=much[part], minlength=6) / coloured)
    return "".join(f"{min(15, int(s * 16)):x}" for s in shares)


def downscaled(a: np.ndarray) -> np.ndarray:
    h, w = a.shape[:2]
    if max(h, w) <= SIDE:
        return a
    ratio = min(SIDE / h, SIDE / w)
    return resampled(a, max(1, int(h * ratio)), max(1, int(w * ratio)))


def facts(a: np.ndarray) -> dict:
    """Everything that is known of one picture; crops that are not worth it are None."""
    bands, small = Bands(a), downscaled(a)
    some = bands if small is a else Bands(small)
    return {"trimmed": trim_bottom(a, bands=bands), "focused": focus(a, bands=bands), "phash": phash(small, some), "colorhash": colorhash(small, some)}


def page_facts(pages: DataFrame, keys: list[str], raster: str = "raster", opened: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """keys, trimmed, focused, phash and colorhash of each row; all null where there is no picture.

    One pass: a picture goes to Python once and only its facts come back. ``opened``, if given, makes batches of keys
    and raster out of those of pages in the same worker, so that what it opens is never sent through the JVM. A
    picture that a task has seen among its last KNOWN others, as blank pages are, is not looked at again."""
    rows = pages if opened else pages.select(*keys, raster)
    kinds = T.StructType([*[rows.schema[k] for k in keys], T.StructField("trimmed", TRIM), T.StructField("focused", FOCUS), *HASHES.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[tuple, dict] = OrderedDict()

        def once(height: int, width: int, data: pa.Buffer) -> dict:
            key = height, width, hashlib.sha256(data).digest()
            if key not in known:
                known[key] = facts(np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3))
                if len(known) > KNOWN:
                    known.popitem(last=False)
            known.move_to_end(key)
            return known[key]

        for batch in opened(batches) if opened else batches:
            h, w, data = (batch.column(len(keys)).field(c) for c in ("height", "width", "data"))
            got = []
            for i in range(batch.num_rows):
                there = batch.column(len(keys))[i].is_valid and data[i].is_valid and h[i].as_py() and w[i].as_py()
                got.append(once(h[i].as_py(), w[i].as_py(), data[i].as_buffer()) if there else {})
            trim = pa.struct([("crop_height", pa.int32()), ("removed_percent", pa.float64()), ("background", pa.string())])
            box = pa.struct([("crop_box", pa.list_(pa.int32())), ("removed_percent", pa.float64())])
            made = [pa.array([g.get(c) for g in got], k) for c, k in (("trimmed", trim), ("focused", box), ("phash", pa.string()), ("colorhash", pa.string()))]
            yield pa.record_batch([*batch.columns[: len(keys)], *made], names=kinds.names)

    return rows.mapInArrow(work, kinds)
