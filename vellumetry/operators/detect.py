"""Type detection as one chain of columns.

Input columns: path, length, clf_label, clf_score, clf_mime, libmagic_mime, and facts about the bytes
that the container operators supply: is_zip, package_ok (the package gate over all entries), entity_count,
is_mht, odf_marker, zip_dirs, is_rtf, streams (names in a compound file) and entries (name, size). A
rejection is a pair of columns, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as T

MAX_INPUT = 100 * 1024 * 1024
MAX_RATIO, MAX_ENTRIES, MAX_ENTITIES = 100.0, 5000, 64
#: Labels whose files are zip packages with content types, and compound files.
PACKAGES, COMPOUND = ["docx", "xlsx", "pptx"], ["doc", "xls", "ppt"]


def ooxml_gate(names: Column, compressed: Column, sizes: Column) -> Column:
    """Entries, sizes: a sane package with a content-types part and no bomb's ratio."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    packed = F.aggregate(compressed, F.lit(0).cast("long"), lambda s, x: s + x)
    ratio = F.when(packed == 0, total == 0).otherwise(total / packed <= MAX_RATIO)
    return F.coalesce((F.size(names) <= MAX_ENTRIES) & F.array_contains(names, "[Content_Types].xml") & ratio, F.lit(False))


def entity_gate(xml: Column) -> Column:
    return F.regexp_count(xml, F.lit("<!ENTITY")) <= MAX_ENTITIES


def safe_xml(xml: Column) -> Column:
    """True if there is no document type and no entity declaration at all."""
    return ~xml.rlike(r"(?i)<!DOCTYPE|<!ENTITY")


def mht_sniff(content: Column) -> Column:
    """The first 8192 bytes speak of a MIME version near each other, and of multipart."""
    head = F.lower(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"))
    mime, version, multi = (F.locate(w, head) for w in ("mime", "version", "multipart"))
    return F.coalesce((mime > 0) & (version > 0) & (multi > 0) & (F.abs(version - mime) < 20), F.lit(False))


def rtf_magic(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"{\\rt"), F.lit(False))


def magic_label(label: Column, mime: Column, zip_dirs: Column) -> Column:
    """What the magic library says of a label that is re-checked; else, for packages, the one family of its folders."""
    out = F.lit(None).cast("string")
    for pattern, to in reversed(L.MAGIC):
        out = F.when(F.contains(mime, F.lit(pattern)), to).otherwise(out)
    ppt, word, xl = (F.exists(zip_dirs, _starts(p)) for p in ("ppt/", "word/", "xl/"))
    n = sum(F.when(x, 1).otherwise(0) for x in (ppt, word, xl))
    family = F.when(label.isin(PACKAGES) & (n == 1), F.when(ppt, "pptx").when(word, "docx").otherwise("xlsx"))
    return F.when(label.isin(L.RECHECKED), F.coalesce(out, family, label)).otherwise(label)


def _starts(prefix: str):
    return lambda n: n.startswith(prefix)


def odf_label(label: Column, marker: Column) -> Column:
    out = label
    for word, to in (("text", "odt"), ("spreadsheet", "ods"), ("presentation", "odp"), ("graphics", "odg")):
        out = F.when(F.contains(marker, F.lit("opendocument." + word)), to).otherwise(out)
    return F.when(label.isin("odt", "ods", "odp", "odg"), out).otherwise(label)


def ole_warnings(streams: Column) -> Column:
    """Of the stream names of a compound file: macros without content, encryption."""
    content = ["PowerPoint Document", "PP97_DUALSTORAGE", "WordDocument", "1Table", "0Table", "Workbook", "Book"]
    encrypted = F.array_contains(streams, "EncryptedPackage")
    has = F.exists(streams, lambda s: s.isin(content)) | encrypted
    vba = F.exists(streams, lambda s: s.contains("VBA") | s.contains("Macros"))
    return F.array_compact(F.array(F.when(vba & ~has, "ole_macro_only_payload"), F.when(encrypted, "ole_encrypted")))


def ooxml_warnings(entries: Column) -> Column:
    """Of (name, size) entries: an empty core document, odd executables outside the standard folders."""
    core = F.exists(entries, lambda e: e["name"].isin("word/document.xml", "xl/workbook.xml", "ppt/presentation.xml") & (e["size"] == 0))
    standard = r"^(ppt/|word/|xl/|_rels/|docProps/|\[Content_Types\])"
    odd = F.exists(entries, lambda e: ~e["name"].rlike(standard) & e["name"].rlike(r"\.(bin|exe|dll|dat|vbs|js)$"))
    return F.array_compact(F.array(F.when(core, "ooxml_empty_core_document"), F.when(odd, "ooxml_suspicious_entries")))


def detect(df: DataFrame, max_input: int = MAX_INPUT) -> DataFrame:
    """Adds ext, label, mime, source, agreed, confidence, warnings, reject_reason.

    Four ways to a label, in this order: a label that is supported; a generic container or an unknown file
    whose extension is on the list; text of any kind. Where the extension decides, confidence is 0."""
    df = df.withColumn("ext", T.extension_hint(F.col("path")))
    full = F.col("length") > 0
    first = F.coalesce("clf_label", F.lit("unknown"))
    label = F.when(full, odf_label(magic_label(first, F.col("libmagic_mime"), F.col("zip_dirs")), F.col("odf_marker"))).otherwise(first)
    df = df.withColumn("__seen", F.when(full & F.col("is_mht"), "mht").otherwise(label))
    seen = F.col("__seen")
    structural = F.when(full & seen.isin(COMPOUND), ole_warnings(F.col("streams"))).when(full & seen.isin(PACKAGES), ooxml_warnings(F.col("entries")))
    df = df.withColumn("__structural", F.coalesce(structural, F.array().cast("array<string>")))
    df = df.withColumn("__seen", F.when(L.supported_label(seen).isNull() & F.col("is_rtf"), "rtf").otherwise(seen))
    known, allowed = L.supported_label(seen), L.extension_label(F.col("ext"))
    generic, unknown = seen.isin("zip", "xml"), seen == "unknown"
    text = L.is_text_mime(F.coalesce("clf_mime", F.lit("")))
    sane = F.coalesce("package_ok", F.lit(False))
    gate = F.when(seen == "zip", sane).otherwise(F.coalesce("entity_count", F.lit(0)) <= MAX_ENTITIES)
    by_name = known.isNull() & (generic | unknown)
    reason = (
        F.when(F.col("length") > max_input, "input_too_large")
        .when(known.isNotNull(), F.when(seen.isin(PACKAGES) & ~sane, "ooxml_structural_check_failed"))
        .when(by_name & allowed.isNull(), "magika_unknown_extension_mismatch")
        .when(generic, F.when(~gate, "magika_unknown_extension_mismatch"))
        .when(unknown, F.when(allowed.isin(PACKAGES) & F.coalesce("is_zip", F.lit(False)) & ~sane, "ooxml_structural_check_failed"))
        .when(~text, "unsupported_type")
    )
    warnings = (
        F.when(known.isNotNull(), F.col("__structural"))
        .when(generic, F.array(F.concat(F.lit("magika_labeled_as_"), seen)))
        .when(unknown, F.array(F.lit("magika_unrecognized_content")))
        .otherwise(F.array(F.concat(F.lit("rendered_as_text_from_"), seen)))
    )
    agreed = F.when(by_name, True).when(known.isNull(), F.col("ext") == "txt").otherwise((F.col("ext") == known) | F.coalesce(allowed == known, F.lit(False)))
    score = F.when(by_name, F.lit(0.0)).otherwise(T.clamp_confidence(F.col("clf_score")))
    taken = F.col("reject_reason").isNull()
    out = df.withColumn("reject_reason", reason)
    out = out.withColumn("label", F.when(taken, F.when(known.isNotNull(), known).when(by_name, allowed).otherwise("txt")))
    return out.withColumns({
        "mime": L.mime_of(F.col("label")),
        "source": F.when(taken, F.when(by_name, "extension").otherwise("magika")),
        "agreed": F.when(taken, agreed),
        "confidence": F.when(taken, score),
        "warnings": F.when(taken, warnings),
    }).drop("__seen", "__structural")
