"""The nested record of a document: status, detection, a payload with a node for each page, artifacts, warnings.

What the producer knows of a document comes as one VARIANT, of any shape. The record's typed part is read out
of it by path; the whole of it goes along as text, so that nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .plans import cut, warning

#: What is said of a document of no known type.
UNKNOWN, OCTETS = "unknown", "application/octet-stream"
#: Characters of a rejection's reason that are kept.
REASON = 2000
_WARNING = "array<struct<code:string,message:string>>"
_HASHES = (("phash", 16), ("colorhash", None), ("sha256", 64))
_IMAGES = (("file", ""), ("trimmed_file", "-trimmed"), ("focused_file", "-focused"))


def _read(meta: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(meta, path, kind)


def _text(meta: Column, path: str, default: str) -> Column:
    """Text at a path; none and empty text are the default."""
    return F.coalesce(F.nullif(_read(meta, path, "string"), F.lit("")), F.lit(default))


def scanner_record() -> Column:
    """What the scanners found on a page: a child of the page's node."""
    return F.struct(
        F.coalesce(F.size("qr"), F.lit(0)).cast("long").alias("qr_count"), F.col("qr_skipped").alias("qr_skipped"),
        cut("ocr_text", F.coalesce("ocr_text", F.lit(""))).alias("ocr_text"), F.coalesce("ocr_char_count", F.lit(0)).cast("long").alias("ocr_char_count"), F.col("ocr_skipped").alias("ocr_skipped"),
    )


def page_node() -> Column:
    """A page: its size, its picture, those of its hashes that are well formed, and its scanner record."""
    hashes = [F.when(T.valid_hash(F.col(c), n).isNotNull(), F.struct(F.lit(c).alias("algo"), F.col(c).alias("value"))) for c, n in _HASHES]
    dims = F.struct(F.col("width_mm").alias("width"), F.col("height_mm").alias("height"), F.lit("mm").alias("unit"))
    image = F.concat(F.lit("p"), F.col("page").cast("string"))
    return F.struct(F.col("page").alias("index"), dims.alias("dims"), image.alias("image"), F.array_compact(F.array(*hashes)).alias("hashes"), F.array(scanner_record()).alias("children"))


def _files() -> Column:
    """A page's artifacts: its picture and the derivatives it has."""
    every = [F.struct(F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(tail)).alias("id"), F.col(c).alias("path"), F.lit("image").alias("kind")) for c, tail in _IMAGES]
    return F.filter(F.array(*every), lambda f: f["path"].isNotNull())


def _warnings(meta: Column) -> Column:
    """Warnings that are objects, each with a code and a message cut to size."""
    listed = F.coalesce(_read(meta, "$.warnings", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(listed, lambda w: F.startswith(F.schema_of_variant(w), F.lit("OBJECT")))
    return F.transform(objects, lambda w: warning(_read(w, "$.code", "string"), _read(w, "$.message", "string")))


def envelope(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One nested record a document: doc_id, status, detected, payload, artifacts, warnings and total_ms.

    docs has doc_id, reject_reason, has_pdf and meta (a VARIANT: input.detected, render, version, warnings and
    whatever else); pages has doc_id, page, ms, file, trimmed_file, focused_file (null where there is none),
    width_mm, height_mm, phash, colorhash, sha256, qr (an array), qr_skipped, ocr_text, ocr_char_count and
    ocr_skipped. A rejection is a record of its own kind: unknown type, confidence 0, the reason as its only warning and
    in its payload, no pages and no artifacts; its pages are left out before the shuffle."""
    live = docs.where("reject_reason is null").select("doc_id")
    got = pages.join(live, "doc_id", "left_semi").select("doc_id", "ms", F.struct("page", page_node().alias("node"), _files().alias("files")).alias("p"))
    got = got.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"), F.sum("ms").alias("total_ms"))
    out = docs.join(got, "doc_id", "left")
    meta, no = F.col("meta"), F.col("reject_reason").isNotNull()
    reason = F.substring("reject_reason", 1, REASON)
    node, file = (got.select(F.col("p")[0][c].alias("x")).schema["x"].dataType.simpleString() for c in ("node", "files"))

    def either(rejected: Column, seen: Column) -> Column:
        return F.when(no, rejected).otherwise(seen)

    label, mime = (either(F.lit(default), _text(meta, f"$.input.detected.{name}", default)) for name, default in (("label", UNKNOWN), ("mime", OCTETS)))
    confidence = either(F.lit(0.0), T.clamp_confidence(_read(meta, "$.input.detected.confidence", "double")))

    def counted(name: str) -> Column:
        return F.when(~no, F.coalesce(_read(meta, f"$.render.{name}", "long"), F.lit(0)))

    about = F.struct(
        either(F.lit("rejected"), label).alias("label"), F.when(no, reason).alias("reason"), counted("page_count_total").alias("page_count_total"), counted("page_count_rendered").alias("page_count_rendered"),
        F.when(~no, F.coalesce(_read(meta, "$.render.truncated", "boolean"), F.lit(False))).alias("truncated"), F.when(~no, F.coalesce(_read(meta, "$.version", "string"), F.lit(""))).alias("version"),
        F.when(~no, F.coalesce(F.to_json(meta), F.lit(""))).alias("metadata"),
    )
    children = F.coalesce(F.when(~no, F.transform("p", lambda x: x["node"])), F.array().cast(f"array<{node}>"))
    payload = F.struct(F.lit("/").alias("path"), mime.alias("content_type"), F.lit(0).alias("depth"), about.alias("metadata"), children.alias("children"))
    none = F.array().cast(file)
    pdf = F.when(F.col("has_pdf"), F.array(F.struct(F.lit("document-pdf").alias("id"), F.lit("document.pdf").alias("path"), F.lit("pdf").alias("kind")))).otherwise(none)
    artifacts = F.when(no, none).otherwise(F.concat(F.coalesce(F.flatten(F.transform("p", lambda x: x["files"])), none), pdf))
    refusal = F.array(F.struct(F.lit("rejected").alias("code"), reason.alias("message")))
    return out.select(
        "doc_id", either(F.lit("rejected"), F.lit("ok")).alias("status"), F.struct(label.alias("label"), mime.alias("mime"), confidence.alias("confidence")).alias("detected"), payload.alias("payload"),
        artifacts.alias("artifacts"), either(refusal.cast(_WARNING), _warnings(meta).cast(_WARNING)).alias("warnings"), F.coalesce("total_ms", F.lit(0)).cast("long").alias("total_ms"),
    )


def details(record: Column) -> Column:
    """The producer's metadata of a record, as it was: a VARIANT to read by path."""
    return F.try_parse_json(record["payload"]["metadata"]["metadata"])


def json_record(record: Column) -> Column:
    """JSON text; optional keys that are null are absent."""
    return F.to_json(record, {"ignoreNullFields": "true"})
