"""Around external scanners: who is scanned, in what time, and what the output says.

A scanner itself is an outside program; its exit code, output and duration come in as columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.lookups import QR_FORMATS
from ..functions.text import normal_format, stripped

FLOOR_S, KILLED = 30, -9
QR_RESULT = "array<struct<format:string,value:string,position:string,error_correction_level:string,is_mirrored:boolean,raw_bytes_hex:string>>"


def error_kind(message: Column) -> Column:
    """A message that speaks of a timeout is a skip without warning; any other is an error."""
    return F.when(message.isNull(), F.lit(None)).when(F.contains(F.lower(message), F.lit("timeout")), "timeout").otherwise("error")


def qr_skipped(enabled: Column, blank: Column, exit_code: Column) -> Column:
    return F.when(~enabled, "disabled").when(blank, "blank_page").when(exit_code == KILLED, "timeout").when(exit_code != 0, "error")


def worth_ocr(images: Column, drawings: Column, text_empty: Column) -> Column:
    """Pages that could not be read count as worth it."""
    return (F.coalesce(images, F.lit(1)) > 0) | F.coalesce(drawings, F.lit(True)) | F.coalesce(text_empty, F.lit(True))


def ocr_skipped(enabled: Column, blank: Column, every: Column, worth: Column, left_s: Column, exit_code: Column) -> Column:
    return (
        F.when(~enabled, "disabled")
        .when(blank, "blank_page")
        .when(~every & ~worth, "no_images")
        .when(left_s < FLOOR_S, "timeout_budget")
        .when(exit_code == KILLED, "timeout")
        .when(exit_code != 0, "error")
    )


def with_time_left(pages: DataFrame, budget_s: float, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Seconds of the document's budget before each page, pages taken one after the other.

    A real run takes pages in parallel against one clock; this is its replay in order."""
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("left_s", F.lit(float(budget_s)) - F.coalesce(F.sum("duration_ms").over(w), F.lit(0)) / 1000)


def ocr_text(stdout: Column) -> Column:
    """Without the newlines at the end."""
    return F.regexp_replace(stdout, r"\n+\z", "")


def scan_timeouts(left_s: Column, warm_s: Column) -> tuple[Column, Column]:
    """(warm, cold): whole seconds a page may take in the warm scanner, and in the cold one after the warm one took
    warm_s in vain. What the warm try took is taken off, so both together stay within the budget; a try has a second."""
    spent = F.greatest(F.lit(0.0), left_s - F.coalesce(warm_s, F.lit(0.0)))
    return F.floor(F.greatest(F.lit(0.0), left_s)).cast("int"), F.greatest(F.lit(1), F.floor(spent).cast("int"))


def warm_or_cold(warm: Column, cold: Column) -> tuple[Column, Column]:
    """(text, warning): the warm result if there is one, else the cold one with a warning."""
    return F.coalesce(warm, cold), F.when(warm.isNull(), "ocr_warm_fallback")


def json_lines(stdout: Column) -> Column:
    """Results of one JSON object a line; lines that do not parse, or have no format, are dropped."""
    rows = F.transform(F.split(stdout, r"\r?\n"), lambda s: F.from_json(s, "map<string,string>"))
    good = F.filter(rows, lambda m: m.isNotNull() & F.coalesce(m["Format"] != "", F.lit(False)))
    return F.transform(
        good,
        lambda m: F.struct(
            normal_format(m["Format"]).alias("format"),
            F.coalesce(m["Text"], F.lit("")).alias("value"),
            m["Position"].alias("position"),
            m["ECLevel"].alias("error_correction_level"),
            F.coalesce(F.lower(m["IsMirrored"]) == "true", F.lit(False)).alias("is_mirrored"),
            m["Bytes"].alias("raw_bytes_hex"),
        ),
    )


def plain_blocks(stdout: Column) -> Column:
    """Results of blocks of ``key: value`` lines that blank lines part; of repeated keys the last line holds.

    A format that is not in the table is put into normal form; quotes come off the text in pairs only."""
    table = F.create_map(*[F.lit(x) for kv in QR_FORMATS.items() for x in kv])
    blocks = F.split(F.regexp_replace(stdout, r"\r\n?", "\n"), r"\n[^\S\n]*\n")

    def field(b: Column, name: str) -> Column:
        line = rf"(?ms)\A(?:.*^)?[^\S\n]*{name}[^\S\n]*:([^\n]*)$"
        return F.when(b.rlike(line), stripped(F.regexp_extract(b, line, 1)))

    def made(b: Column) -> Column:
        raw, text = F.coalesce(field(b, "Format"), F.lit("")), F.coalesce(field(b, "Text"), F.lit(""))
        named = F.coalesce(F.element_at(table, F.translate(F.lower(raw), "-_ ", "")), normal_format(raw))
        bare = F.when(text == '"', "").when(text.startswith('"') & text.endswith('"'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
        return F.struct(
            named.alias("format"), bare.alias("value"), field(b, "Position").alias("position"), field(b, "EC Level").alias("error_correction_level"),
            (F.lower(F.coalesce(field(b, "IsMirrored"), F.lit("false"))) == "true").alias("is_mirrored"), field(b, "Bytes").alias("raw_bytes_hex"),
        )

    return F.filter(F.transform(blocks, made), lambda r: r["format"] != "")


#: Names of the older scanner's format argument.
OLD_NAMES = {"qr_code": "QRCode", "micro_qr_code": "MicroQRCode", "rmqr_code": "rMQRCode"}


def old_format_names(formats: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in OLD_NAMES.items() for x in kv])
    return F.array_join(F.transform(F.split(formats, ","), lambda x: F.coalesce(F.element_at(table, F.trim(x)), F.trim(x))), ",")


def found_nothing(stdout: Column) -> Column:
    return F.contains(stdout, F.lit("No barcode found"))


#: One member: commas and blanks, a key in quotes, a colon, a value in quotes or a bare word.
_MEMBER = re.compile(r'[ \t,]*"((?:[^"\\]|\\.)*)"[ \t]*:[ \t]*(?:"((?:[^"\\]|\\.)*)"|((?!")[^,}]*))', re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def parse_line(line: str) -> dict[str, str | None] | None:
    """One flat object by the scanner's own grammar: string keys, values that are strings or bare words.

    A bare null is None and other bare words stay text. Of escapes only ``n``, ``r`` and ``t`` mean another
    character; any other stands for the character after the backslash. None if the line does not follow."""

    def plain(s: str) -> str:
        return _ESCAPE.sub(lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), s)

    line = line.strip()
    if len(line) < 2 or line[0] != "{" or line[-1] != "}":
        return None
    body, at, out = line[1:-1], 0, {}
    while body[at:].strip(" \t,"):
        m = _MEMBER.match(body, at)
        if not m:
            return None
        bare = (m[3] or "").strip()
        out[plain(m[1])] = plain(m[2]) if m[2] is not None else None if bare == "null" else bare
        at = m.end()
    return out


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def exact_lines(stdout: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The exact grammar, for output that from_json reads differently; an iterator UDF over Arrow."""
    for s in stdout:
        yield s.map(lambda x: [r for r in map(parse_line, (x or "").splitlines()) if r is not None])
