"""Fill-in-middle transformation by a two-pass matcher that stores no units.

A text is read as units (by default runs of ASCII letters and single other characters). The first pass
counts the matches; the second advances a lazy match iterator to the smaller and then to the larger of two
ranks, which a hash of the document's id gives, and keeps nothing but the two offsets. The three parts are
then put together with marks: prefix, suffix, middle (``psm``), suffix, prefix, middle (``spm``), or as the
text is (``plain``). Beside the text and its output a task holds two numbers, however long the text is.

A text that contains a mark is plain, so the first suffix mark after the prefix mark and the first middle
mark after that are the ones put in: ``restore`` reads the text back out of output and form alone.

Defined results: null text counts as empty; an empty text is plain with n 0; a null doc_id is hashed as the
empty string; rows of one doc_id are cut at ranks of the same hash, each in its own text; an empty table
gives an empty result; very long texts are processed whole; of equal ranks the middle is empty; of other
columns those in ``keep`` come back inside ``row``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents, how many stay plain, and how many of the others have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Rows that a task turns to Python strings at a time.
ROWS = 256


def draws(key: str) -> tuple[int, int, int, int]:
    """The first four groups of eight digits of the hex sha256 of the key."""
    h = hashlib.sha256(key.encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def cut(text: str, unit: re.Pattern[str], low: int, high: int) -> tuple[int, int]:
    """Offsets after ``low`` and after ``high`` units, from one pass of a lazy iterator."""
    matches = unit.finditer(text)
    first = next(islice(matches, low - 1, low)).end() if low else 0
    return first, next(islice(matches, high - low - 1, high - low)).end() if high > low else first


def rearranged(text: str, key: str, unit: re.Pattern[str], marks: tuple[str, str, str], plain: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, code points of prefix and of middle, output)."""
    n = sum(1 for _ in unit.finditer(text))
    h1, h2, h3, h4 = draws(key)
    if not text or h3 % 100 >= 100 - plain or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, last = cut(text, unit, min(a, b), max(a, b))
    p, s, m = marks
    if h4 % 100 < suffix_first:
        form, output = "spm", f"{s}{text[last:]}{p}{text[:first]}{m}{text[first:last]}"
    else:
        form, output = "psm", f"{p}{text[:first]}{s}{text[last:]}{m}{text[first:last]}"
    return n, form, first, last - first, output


def fill_in_middle(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), unit: str = UNIT, seed: str = "1", marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``row`` (a struct of the columns named in keep), n, form, prefix_chars, middle_chars and output, for every row."""
    pattern = re.compile(unit)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), key.alias("key"), F.col("text").cast("string").alias("text"))
    made = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            done = [rearranged(t or "", k, pattern, marks, plain, suffix_first) for k, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*done), made.values())]
            yield pa.record_batch([part.column(0), *columns], names=["row", *made])

    schema = T.StructType([rows.schema["row"], *(T.StructField(name, T.LongType() if kind == pa.int64() else T.StringType()) for name, kind in made.items())])
    return rows.mapInArrow(work, schema)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of ``fill_in_middle`` was made of."""
    p, s, m = marks

    def between(opening: str, closing: str) -> tuple[Column, Column, Column]:
        """What stands after the opening mark, after the closing one, and after the middle one."""
        body = F.substring(output, F.lit(len(opening) + 1), F.length(output))
        at = F.instr(body, F.lit(closing))
        rest = F.substring(body, at + len(closing), F.length(body))
        end = F.instr(rest, F.lit(m))
        return F.substring(body, F.lit(1), at - 1), F.substring(rest, F.lit(1), end - 1), F.substring(rest, end + len(m), F.length(rest))

    prefix, suffix, middle = between(p, s)
    late, early, inner = between(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, inner, late)).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256."""
    done = fill_in_middle(docs)

    def sha(x: Column) -> Column:
        return F.sha2(x.cast("binary"), 256)

    return done.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
