"""Signatures as columns: 64-bit words, colour bins, blank pages, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The distance of colour hashes that cannot be compared.
INCOMPARABLE = 2147483647


def word(hex16: Column) -> Column:
    """16 hex digits as a signed 64-bit number."""
    return F.conv(hex16, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def nibble(s: Column, i: Column) -> Column:
    """The i-th hex digit (from 1) as a number."""
    return F.conv(F.substring(s, i, F.lit(1)), 16, 10).cast("int")


def colorhash_distance(a: Column, b: Column, first: int = 0, last: int = 14) -> Column:
    """Sum of absolute differences of the hex digits in [first, last)."""
    if last <= first:
        bins = F.lit(0)
    else:
        places = F.array(*[F.lit(i) for i in range(first + 1, last + 1)])
        bins = F.aggregate(F.transform(places, lambda i: F.abs(nibble(a, i) - nibble(b, i))), F.lit(0), lambda s, x: s + x)
    return F.when((F.length(a) != 14) | (F.length(b) != 14), F.lit(INCOMPARABLE)).otherwise(bins).cast("int")


def blank_signature(phash: Column, colorhash: Column) -> Column:
    """A flat picture: at most one bit set, all pixels black or all grey, no hue."""
    flat = F.bit_count(word(phash)) <= 1
    full = (F.substring(colorhash, 1, 1) == "f") | (F.substring(colorhash, 2, 1) == "f")
    return F.coalesce((F.length(colorhash) >= 14) & flat & full & colorhash.rlike("^..0*$"), F.lit(False))


def median_bits(values: Column) -> Column:
    """Bit i (most significant first) says whether value i is above the median of 64 values.

    The median is an element of a one-element array that a lambda reads, so it is computed once a row."""
    doubles = values.cast("array<double>")
    ordered = F.sort_array(doubles)
    median = F.array((F.get(ordered, F.lit(31)) + F.get(ordered, F.lit(32))) / 2)
    zero, one = (F.lit(x).cast("long") for x in (0, 1))
    return F.get(F.transform(median, lambda m: F.aggregate(doubles, zero, lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > m, one).otherwise(zero)))), F.lit(0))


def hex16(w: Column) -> Column:
    return F.lower(F.lpad(F.hex(w), 16, "0"))
