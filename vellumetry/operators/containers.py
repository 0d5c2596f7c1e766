"""Looking into containers: zip packages, spreadsheets, Word packages, MIME messages, style sheets.

Bytes are opened inside Arrow batches, under caps that hold while a member is being inflated; what
comes out are plain rows, and everything after that is joins and columns.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import ALTCHUNK_TYPES
from ..functions.text import declarations, oversized_range
from .arrow import packed, rows

MEMBER_BYTES, TOTAL_BYTES, ENTRIES = 256 << 20, 512 << 20, 10_000
MHT_PARTS, MHT_BYTES = 4000, 512 << 20


def bounded_read(z: zipfile.ZipFile, name: str, most: int = MEMBER_BYTES) -> bytes | None:
    """A member's bytes, or None if it declares or yields more than ``most``, or cannot be read."""
    try:
        if z.getinfo(name).file_size > most:
            return None
        with z.open(name) as f:
            data = f.read(most + 1)
    except (KeyError, OSError, zlib.error, zipfile.BadZipFile, RuntimeError, NotImplementedError):
        return None
    return data if len(data) <= most else None


def zip_entries(files: DataFrame) -> DataFrame:
    """(doc_id, pos, name, compress_size, file_size) of content; no rows for what is not a zip."""

    schema = "doc_id long, pos int, name string, compress_size long, file_size long"

    def entries(doc_id: int, content: bytes | None) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                return [(doc_id, i, e.filename, e.compress_size, e.file_size) for i, e in enumerate(z.infolist())]
        except (zipfile.BadZipFile, OSError):
            return []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed((e for r in rows(batches) for e in entries(*r)), schema)

    return files.select("doc_id", "content").mapInArrow(read, schema)


def within_budget(entries: DataFrame, total: int = TOTAL_BYTES, count: int = ENTRIES) -> DataFrame:
    """The entries of packages whose pass stays within bytes and entries; a package that does not gives none."""
    whole = entries.groupBy("doc_id").agg(F.sum("file_size").alias("size"), F.count("*").alias("n"))
    return entries.join(whole.where((F.col("size") > total) | (F.col("n") > count)).select("doc_id"), "doc_id", "left_anti")


def zip_members(files: DataFrame, names: str, total: int = TOTAL_BYTES, count: int = ENTRIES) -> DataFrame:
    """(doc_id, name, data) of members whose name matches a pattern; a pass over its budget fails and gives none."""
    wanted = re.compile(names)

    schema = "doc_id long, name string, data binary"

    def members(doc_id: int, content: bytes | None) -> list[tuple]:
        out, left, n = [], total, 0
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                for e in z.infolist():
                    if not wanted.search(e.filename):
                        continue
                    n += 1
                    data = bounded_read(z, e.filename, min(MEMBER_BYTES, left)) if n <= count else None
                    if data is None:
                        return []
                    left -= len(data)
                    out.append((doc_id, e.filename, data))
        except (zipfile.BadZipFile, OSError):
            pass
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed((m for r in rows(batches) for m in members(*r)), schema)

    return files.select("doc_id", "content").mapInArrow(read, schema)


def altchunk_policy(chunks: DataFrame) -> DataFrame:
    """Per document: error for a type that cannot be rendered or for two that can, else substitute."""
    good = F.col("content_type").isin([t for t, ok in ALTCHUNK_TYPES.items() if ok])
    out = chunks.groupBy("doc_id").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    return out.select("doc_id", F.when(F.col("bad") > 0, "unsupported_type").when(F.col("good") > 1, "several").otherwise("substitute").alias("action"))


_UNSAFE = re.compile(r"[^A-Za-z0-9._-]")


def _file_name(name: str) -> str:
    return _UNSAFE.sub("_", name.replace("\\", "/").rpartition("/")[2]).strip("._")


def _decoded(data: bytes, charset: str | None) -> str | None:
    try:
        return data.decode(charset or "utf-8", "replace")
    except (LookupError, ValueError):
        return None


def mht_parts(files: DataFrame) -> DataFrame:
    """(doc_id, pos, root, ctype, cid, cloc, local_name, payload, text): leaf parts of MIME messages, within the caps.

    The first HTML part is the root and has no local name; its text is read in the character set it names, else
    in UTF-8, and is null for a set that is not known. Another part is named for its location, or for
    its digest; a name that is taken gets ``_1``, ``_2`` … at its end. Empty parts are left out. The caps are
    looked at before a part is taken, so the last one may overshoot; the root does not count."""

    schema = "doc_id long, pos int, root boolean, ctype string, cid string, cloc string, local_name string, payload binary, text string"

    def leaves(doc_id: int, content: bytes | None) -> list[tuple]:
        out, size, taken, rooted = [], 0, set(), False
        for part in email.message_from_bytes(content or b"", policy=email.policy.compat32).walk():
            data = None if part.is_multipart() else part.get_payload(decode=True)
            if not data:
                continue
            kind, cid, place = part.get_content_type(), (part.get("Content-ID") or "").strip().strip("<>").lower(), (part.get("Content-Location") or "").strip()
            root, name = kind == "text/html" and not rooted, None
            if root:
                rooted = True
            elif len(taken) >= MHT_PARTS or size >= MHT_BYTES:
                break
            else:
                base = _file_name(place) or f"part-{hashlib.sha1(data).hexdigest()[:10]}.bin"
                name, again = base, 0
                while name in taken:
                    again += 1
                    name = f"{base}_{again}"
                taken.add(name)
                size += len(data)
            out.append((doc_id, len(out), root, kind, cid or None, place or None, name, data, _decoded(data, part.get_content_charset()) if root else None))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed((x for r in rows(batches) for x in leaves(*r)), schema)

    return files.select("doc_id", "content").mapInArrow(read, schema)


def _names(parts: DataFrame, key: Column) -> DataFrame:
    """(doc_id, names): a map from keys to local names; of equal keys the later part's holds."""
    last = parts.where("not root").select("doc_id", key.alias("key"), "local_name", "pos").where("key <> ''").groupBy("doc_id", "key").agg(F.max_by("local_name", "pos").alias("name"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "name"))).alias("names"))


def rewrite_cids(html: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, html) with every ``cid:`` of a known part replaced by its local name.

    html has doc_id and html; parts are those of ``mht_parts``. A document's names are one map."""
    pattern = r"cid:[^\"'>)\s]+"
    found = F.regexp_extract_all("html", F.lit(f"(?i)({pattern})"), F.lit(1))
    between = F.split("html", f"(?i){pattern}", -1)
    new = F.transform(found, lambda m: F.coalesce(F.element_at("names", F.lower(F.regexp_replace(F.substring(m, F.lit(5), F.length(m)), "^<+|[<>]+$", ""))), m))
    joined = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return html.join(_names(parts, F.col("cid")), "doc_id", "left").select("doc_id", F.when(F.col("names").isNull(), F.col("html")).otherwise(joined).alias("html"))


def oversized_sheets(files: DataFrame) -> DataFrame:
    """(doc_id, oversized): whether any worksheet of a package has a dimension beyond the limits."""
    sheets = zip_members(files, r"^xl/worksheets/sheet\d+\.xml$")
    ref = F.regexp_extract(F.decode("data", "UTF-8"), r'<dimension\s+ref="([^"]+)"', 1)
    return sheets.groupBy("doc_id").agg(F.bool_or(oversized_range(ref)).alias("oversized"))


#: Fixed value: selectors that are applied.
SELECTOR = r"^([a-zA-Z][a-zA-Z0-9]*)?(?:\.([A-Za-z_](?U:[\w-])*))?$"
#: Fixed value: the attributes whose quoted values are rewritten.
URL_ATTRIBUTE = r"(?i)((?:src|href|background)\s*=\s*)(\"[^\"]*\"|'[^']*')"


def rewrite_urls(html: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, html) with the locations of the document's own parts, and the last segments of these, replaced
    by local names in quoted src, href and background values: the longest first, of one length in the order of
    the parts. Of parts with one location the last gives the name."""
    known = parts.where("not root and cloc is not null")
    short = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.regexp_replace("cloc", r"\\", "/"), "/"), -1), "[^A-Za-z0-9._-]", "_"), "^[._]+|[._]+$", "")
    both = known.select("doc_id", "pos", "local_name", F.posexplode(F.array_distinct(F.array(F.col("cloc"), short))).alias("k", "key")).where("key <> ''")
    place = F.struct("pos", "k")
    each = both.groupBy("doc_id", "key").agg(F.max_by("local_name", place).alias("name"), F.min(place).alias("first"))
    names = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("key")).alias("n"), "first", "key", "name"))).alias("ordered"))
    found = F.regexp_extract_all("html", F.lit(URL_ATTRIBUTE), F.lit(0))
    between = F.split("html", URL_ATTRIBUTE, -1)

    def changed(m: Column) -> Column:
        value = F.regexp_extract(m, URL_ATTRIBUTE, 2)
        return F.concat(F.regexp_extract(m, URL_ATTRIBUTE, 1), F.aggregate("ordered", value, lambda v, e: F.replace(v, e["key"], e["name"])))

    joined = F.array_join(F.flatten(F.zip_with(between, F.transform(found, changed), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    rows = html.join(names, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("ordered").isNull(), F.col("html")).otherwise(joined).alias("html"))


def css_rules(html: DataFrame) -> DataFrame:
    """(doc_id, selector, prop, value, at) of the style blocks; of repeated settings the last one holds.

    at is where a selector first sets a property: block, rule and place in the rule. Only tag, .class and tag.class
    selectors. Rules are cut with split, which takes linear time; quoted semicolons do not end a declaration."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))
    rules = html.select("doc_id", F.posexplode(blocks).alias("b", "block")).select("doc_id", "b", F.posexplode(F.split(F.regexp_replace("block", r"(?s)/\*.*?\*/", ""), r"\}")).alias("r", "rule"))
    rules = rules.where(F.contains("rule", F.lit("{"))).select("doc_id", "b", "r", F.split(F.substring_index("rule", "{", 1), ",").alias("selectors"), declarations(F.regexp_extract("rule", r"(?s)^[^{]*\{(.*)\z", 1)).alias("props"))
    rules = rules.where(F.size("props") > 0).select("doc_id", "b", "r", F.explode("selectors").alias("selector"), "props")
    rules = rules.withColumn("selector", F.regexp_replace("selector", r"(?U)^\s+|\s+\z", "")).where(F.col("selector").rlike(SELECTOR) & (F.col("selector") != ""))
    dot = F.locate(".", F.col("selector"))
    named = F.when(dot > 0, F.concat(F.lower(F.substring_index("selector", ".", 1)), F.substring(F.col("selector"), dot, F.length("selector")))).otherwise(F.lower("selector"))
    each = rules.select("doc_id", named.alias("selector"), "b", "r", F.posexplode(F.map_entries("props")).alias("i", "d"))
    at = F.struct("b", "r", "i")
    return each.groupBy("doc_id", "selector", F.col("d.key").alias("prop")).agg(F.max_by("d.value", at).alias("value"), F.min(at).alias("at"))
