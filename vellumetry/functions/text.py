"""String rules: names, paths, markup values, validators. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension_hint(path: Column) -> Column:
    """Lower-case suffix without its dot; empty for dotfiles and names without a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), -1)


def safe_filename(name: Column, fallback: Column) -> Column:
    """Last segment, odd characters as underscores, dots and underscores off both ends."""
    clean = F.regexp_replace(F.regexp_replace(base_name(name), r"[^A-Za-z0-9._-]", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", fallback).otherwise(clean)


def upload_name(name: Column) -> Column:
    """A base name of safe characters, at most 255 of them; empty and hidden names become upload.bin."""
    clean = F.substring(F.regexp_replace(base_name(name), r"[^A-Za-z0-9._-]", "_"), 1, 255)
    return F.when((clean == "") | clean.startswith("."), F.lit("upload.bin")).otherwise(clean)


def sanitize_error(message: Column) -> Column:
    """Absolute paths of two segments or more become <path>."""
    return F.regexp_replace(message, r"/[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)+", "<path>")


def positional_ok(arg: Column) -> Column:
    """False for an argument that a program would take as an option."""
    return ~arg.startswith("-")


def clamp_confidence(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v, F.lit(0.0))))


def valid_hash(value: Column, length: int | None = None) -> Column:
    """The value if it is hex of the given length, else null."""
    return F.when(value.rlike(f"^[0-9a-fA-F]{{{length}}}$" if length else "^[0-9a-fA-F]+$"), value)


def column_number(letters: Column) -> Column:
    """A = 1, Z = 26, AA = 27."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)


def oversized_range(ref: Column, max_col: int = 30, max_row: int = 200) -> Column:
    """Whether the far corner of a sheet's dimension, which has two corners, lies beyond the limits."""
    end = F.regexp_extract(ref, "^[^:]*:([^:]*)$", 1)
    col, row = F.regexp_replace(end, "[^A-Za-z]", ""), F.regexp_replace(end, "[^0-9]", "")
    return F.coalesce((col != "") & (row != "") & ((column_number(col) > max_col) | (row.try_cast("decimal(38,0)") > max_row)), F.lit(False))


#: Fixed value: bytes of a compound file's workbook beyond which its sheets count as oversized.
WORKBOOK_BYTES = 500_000


def oversized_workbook(streams: Column) -> Column:
    """Of the streams (name, size) of a compound file: whether the first of Workbook and Book is too large."""
    def size(name: str) -> Column:
        return F.get(F.filter(streams, lambda s: s["name"] == name), F.lit(0))["size"]

    return F.coalesce(F.coalesce(size("Workbook"), size("Book")) > WORKBOOK_BYTES, F.lit(False))


#: Characters of a sheet's name that are kept, a sheet's page setup, and its end.
SHEET_NAME = 255
PAGE_SETUP, SHEET_END = r"(?is)<pageSetup\b[^/]*/?>|<pageSetup\b.*?</pageSetup>", "(?is)</worksheet>"


def landscape_patch(xml: Column) -> Column:
    """Every page setup becomes landscape; without one it goes before the first end of the sheet."""
    setup = '<pageSetup orientation="landscape"/>'
    return F.when(xml.rlike(PAGE_SETUP), F.regexp_replace(xml, PAGE_SETUP, setup)).otherwise(F.regexp_replace(xml, r"(?is)\A(.*?)</worksheet>", f"$1{setup}</worksheet>"))


def css_value(value: Column) -> Column:
    """Quotes off both ends; three-digit hex colours doubled."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), '^"+|"+$', ""), "^'+|'+$", "")
    return F.regexp_replace(bare, "^#([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])$", "#$1$1$2$2$3$3")


#: Points below which a text has the legacy font sizes 1 to 6; from the last on it is 7.
FONT_RUNGS = [9.0, 11.0, 13.5, 16.5, 21.0, 30.0]


def font_rung(size: Column) -> Column:
    """A CSS length as a legacy font size 1 to 7; null for relative units and nonsense."""
    v = F.lower(F.trim(size))
    number = F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?)\s*(px|pc|pt)?$", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?)\s*(px|pc|pt)?$", 2)
    pt = F.when(unit == "px", number * 0.75).when(unit == "pc", number * 12).otherwise(number)
    out = F.when(pt.isNull(), F.lit(None))
    for i, top in enumerate(FONT_RUNGS, 1):
        out = out.when(pt < top, str(i))
    return out.otherwise("7")


#: How a property is found in a style; its value ends at a semicolon.
_STYLE = {
    "background": r"(?i)background(?:-color)?\s*:\s*([^;]+)",
    "color": r"(?i)(?<!-)color\s*:\s*([^;]+)",
    "text-align": r"(?i)text-align\s*:\s*(center|left|right|justify)",
    "font-family": r"(?i)font-family\s*:\s*([^;]+)",
    "font-size": r"(?i)font-size\s*:\s*([^;]+)",
    "font-weight": r"(?i)font-weight\s*:\s*([^;]+)",
    "text-decoration": r"(?i)text-decoration\s*:\s*([^;]+)",
}


def _style(style: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(style, _STYLE[name], 1), F.lit(""))


def css_background(style: Column) -> Column:
    return css_value(_style(style, "background"))


def inherited_props(style: Column) -> dict[str, Column]:
    """align, color, family, size, weight and decoration of a style, null where absent or not understood."""
    weight, line = (F.lower(css_value(_style(style, name))) for name in ("font-weight", "text-decoration"))
    number = F.when(weight.rlike("^[0-9]+$"), F.when(F.length(F.regexp_replace(weight, "^0+", "")) > 9, F.lit(10**9)).otherwise(weight.try_cast("int")))
    return {
        "align": F.lower(_style(style, "text-align")),
        "color": css_value(_style(style, "color")),
        "family": css_value(F.get(split_unquoted(_style(style, "font-family"), ","), F.lit(0))),
        "size": font_rung(_style(style, "font-size")),
        "weight": F.when(weight.isin("bold", "bolder") | (number >= 600), "bold").when(weight.isin("normal", "lighter") | (number < 600), "normal"),
        "decoration": F.when(line.contains("underline"), "underline").when(line.contains("none"), "none"),
    }


def split_unquoted(text: Column, sep: str) -> Column:
    """Pieces of text between separators that stand outside quotes; an open quote runs to the end, and an empty
    last piece is none."""
    tokens = F.regexp_extract_all(text, F.lit(rf"""{sep}|"[^"]*(?:"|\z)|'[^']*(?:'|\z)|[^{sep}"']+"""), F.lit(0))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, t: Column) -> Column:
        ended = F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.lit("").alias("now"))
        return F.when(t == sep, ended).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], t).alias("now")))

    return F.aggregate(tokens, zero, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def declarations(style: Column) -> Column:
    """MAP of lower-cased name to value in the order of the names' first coming; empty ones dropped."""
    pairs = F.transform(split_unquoted(style, ";"), lambda d: F.struct(F.lower(stripped(F.substring_index(d, ":", 1))).alias("key"), F.when(F.locate(":", d) > 0, stripped(F.regexp_extract(d, r"(?s)^[^:]*:(.*)\z", 1))).alias("value")))
    kept = F.filter(pairs, lambda p: (p["key"] != "") & p["value"].isNotNull() & (p["value"] != ""))
    # Of equal names the last value holds, in the first one's place.
    first = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, 1, i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"].alias("key"), F.element_at(F.filter(kept, lambda q: q["key"] == p["key"]), -1)["value"].alias("value"))))


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def non_text_ops(stream: Column) -> Column:
    """Whether a content stream paints images or paths."""
    return stream.rlike(r"(?:^|\s)(Do|BI|f|F|S|B|b|f\*|B\*|b\*)(?:$|\s)")


def memory_gb(spec: Column) -> Column:
    """g, m, k or plain bytes as GB; anything else is 0."""
    v = F.lower(F.trim(spec))
    n = F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?)([gmk]?)$", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?)([gmk]?)$", 2)
    by = F.when(unit == "g", 1.0).when(unit == "m", 1 / 1024).when(unit == "k", 1 / 1024**2).otherwise(1 / 1024**3)
    return F.coalesce(n * by, F.lit(0.0))


def valid_lang(lang: Column) -> Column:
    return (F.length(lang) <= 100) & lang.rlike(r"^[A-Za-z]{2,}(_[A-Za-z]+)*(\+[A-Za-z]{2,}(_[A-Za-z]+)*)*$")


def valid_formats(formats: Column) -> Column:
    """1 to 32 names of at most 40 characters, split at commas and bars."""
    names = F.transform(F.split(formats, r"[,|]"), lambda x: F.trim(x))
    ok = F.forall(names, lambda x: (F.length(x) <= 40) & x.rlike(r"^[a-z0-9]+(_[a-z0-9]+)*$"))
    return F.coalesce(ok & F.size(names).between(1, 32), F.lit(False))


def normal_format(name: Column) -> Column:
    """Camel case to snake case; other characters become underscores."""
    split = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    split = F.regexp_replace(split, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.regexp_replace(F.lower(F.regexp_replace(split, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")


def page_file(index: Column, variant: str = "") -> Column:
    return F.format_string(f"page-%03d{'-' + variant if variant else ''}.png", index)


#: Names that a document's artifacts have.
ARTIFACT_FILE = r"page-\d{1,4}(-trimmed|-focused)?\.png|document\.pdf|metadata\.json"


def valid_page_file(name: Column) -> Column:
    return name.rlike(r"^page-\d{1,4}(-trimmed|-focused)?\.png$")


def page_index(name: Column) -> Column:
    """The number before .png, null for derivatives and other files."""
    return F.regexp_extract(name, r"-(\d+)\.png$", 1).try_cast("int")
