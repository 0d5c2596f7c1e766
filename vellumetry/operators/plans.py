"""Export plans, options, warnings and the per-document record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.text import stripped


def export_plan(label: Column) -> dict[str, Column]:
    """Which application exports a label, whether it goes by way of a workbook, and the steps."""
    app = L.application_of(label)
    twice = label.isin(L.TWO_PASS)
    return {"application": app, "two_pass": twice, "steps": F.when(twice, F.array(F.lit("xlsx"), app)).otherwise(F.array(app))}


def rasterizer(name: Column, dpi: int) -> Column:
    """The resolution argument of a rasterizer; null for an unknown one."""
    return F.when(name == "pdfium", F.format_string("--scale=%.6f", F.lit(dpi / 72))).when(name == "pdftoppm", F.lit(f"-r {dpi}"))


#: How long a whole number may be, what recognition languages and lists of barcode formats look
#: like, and words for yes.
MOST_DIGITS = 4300
LANGUAGES, FORMATS = r"^[A-Za-z0-9_+\-]+\z", r"^(?!,)(?!.*,,)[a-z0-9_,]*[a-z0-9_]\z"
YES = ["1", "true", "yes", "on"]



def option_clamp(raw: Column, default: int, low: int, high: int) -> Column:
    """A whole-number option within its bounds, however long it is; text that is no whole number is the default."""
    text = stripped(raw)
    digits = F.regexp_replace(text, "[+_-]", "")
    # Single strokes may stand between digits. No pattern here repeats a group, which would go as deep as the text is long.
    whole = text.rlike(r"^[+-]?[0-9][0-9_]*\z") & ~text.contains("__") & ~F.endswith(text, F.lit("_")) & (F.length(digits) <= MOST_DIGITS)
    # Ten digits are beyond every bound.
    bare = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    size = F.when(F.length(bare) > 9, F.lit(10**9)).otherwise(bare.try_cast("int"))
    value = F.when(whole, F.when(F.startswith(text, F.lit("-")), -size).otherwise(size))
    return F.greatest(F.lit(low), F.least(F.coalesce(value, F.lit(default)), F.lit(high)))


def option_flag(raw: Column, default: bool) -> Column:
    """A switch: on if it says so, off for any other text, the default where it is not given."""
    return F.when(raw.isNull(), F.lit(default)).otherwise(F.lower(stripped(raw)).isin(YES))


def option_text(raw: Column, pattern: str, default: str) -> Column:
    """Text of a fixed shape; any other is the default."""
    text = F.coalesce(stripped(raw), F.lit(""))
    return F.when(text.rlike(pattern), text).otherwise(default)


def convert_options(params: Column, timeout: Column) -> Column:
    """All options of one conversion from its untrusted parameters (a map of texts), each validated and clamped."""

    def p(name: str) -> Column:
        return F.element_at(params, name)

    return F.struct(
        F.greatest(F.lit(1), F.least(timeout, F.lit(600))).alias("timeout_s"),
        option_flag(p("QR"), True).alias("qr_enabled"),
        option_text(p("QR_FORMATS"), FORMATS, "qr_code,micro_qr_code,rmqr_code").alias("qr_formats"),
        option_clamp(p("QR_TIMEOUT_S"), 10, 1, 120).alias("qr_timeout_s"),
        option_flag(p("OCR"), False).alias("ocr_enabled"),
        option_flag(p("OCR_ALL"), False).alias("ocr_all"),
        option_text(p("OCR_LANG"), LANGUAGES, "eng+Latin").alias("ocr_lang"),
        option_clamp(p("OCR_PSM"), 3, 0, 13).alias("ocr_psm"),
        option_clamp(p("OCR_TIMEOUT_S"), 60, 1, 600).alias("ocr_timeout_s"),
    )


def security_block(backend: Column, disclose: Column) -> Column:
    """What the record says of its sandbox: the backend only if that may be disclosed."""
    return F.struct(F.lit(True).alias("sandboxed"), F.when(disclose, backend).alias("backend"))


def warnings_in_order(pages: DataFrame, about: DataFrame, doc: str, page: str, before: list[tuple[str, Column]], after: list[tuple[str, Column]]) -> DataFrame:
    """(doc, codes): flags of the document, then page warnings in page order, then the rest.

    about has a row a document, whose columns the flags are of; pages may have none of some of them."""
    got = pages.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(page, "code"))).alias("w"))

    def flags(of: list[tuple[str, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(on, F.lit(code)) for code, on in of]))

    pages_of = F.coalesce(F.col("w")["code"], F.array().cast("array<string>"))
    return about.join(got, doc, "left").select(doc, F.concat(flags(before), pages_of, flags(after)).alias("codes"))


#: Characters of each field that a record keeps.
FIELD_LIMITS = {"ocr_text": 10_000, "warning_code": 64, "warning_message": 2000, "scan_error": 500, "fallback_error": 200}


def cut(field: str, value: Column) -> Column:
    """The beginning of a value, as much as its field keeps."""
    return F.substring(value, 1, FIELD_LIMITS[field])


def warning(code: Column, message: Column) -> Column:
    """A warning as the record has it: cut to size, and never without a code."""
    code = F.when(F.coalesce(code, F.lit("")) == "", "warning").otherwise(code)
    return F.struct(cut("warning_code", code).alias("code"), cut("warning_message", F.coalesce(message, F.lit(""))).alias("message"))
