"""Parts of office packages: their XML as rows, sheets, embedded sub-documents, and packages written anew.

Members are opened and parsed inside Arrow batches, behind the guard against document types and entities and under the
pass budget of containers; what comes out are rows of elements, and everything after that is joins and columns.
"""

from __future__ import annotations

import copy
import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import ALTCHUNK_TYPES
from ..functions.text import PAGE_SETUP, SHEET_END, SHEET_NAME
from .arrow import packed, rows
from .containers import ENTRIES, MEMBER_BYTES, TOTAL_BYTES, bounded_read, zip_members

#: Namespaces and types of packages.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
DOCUMENT_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
ALTCHUNK = DOCUMENT_RELATIONS + "/aFChunk"
#: Declarations that no part may have, and where a Word package keeps what it embeds.
DECLARATIONS = re.compile(rb"<!DOCTYPE|<!ENTITY", re.IGNORECASE)
DOCUMENT, DOCUMENT_RELS, CONTENT_TYPES = "word/document.xml", "word/_rels/document.xml.rels", "[Content_Types].xml"

_ROWS = "doc_id long, part string, pos int, around int, depth int, space string, tag string, attributes map<string,string>"


def xml_elements(members: DataFrame, tags: list[str]) -> DataFrame:
    """(doc_id, part, pos, around, depth, space, tag, attributes) of the elements of these local names.

    members has doc_id, name and data, as zip_members gives them. pos counts all start tags of a part, around is the
    pos of the element an element is in (-1 for the root), depth 0 the root. Attributes of a namespace are named
    ``{namespace}name``. A part that is malformed or declares a type or an entity gives no rows."""
    wanted = set(tags)

    def rows_of(data: bytes) -> list[tuple]:
        if DECLARATIONS.search(data):
            return []
        out, open_at, pos = [], [-1], 0
        try:
            for event, e in ET.iterparse(io.BytesIO(data), ("start", "end")):
                if event == "end":
                    open_at.pop()
                    e.clear()
                    continue
                space, _, tag = e.tag[1:].rpartition("}") if e.tag[:1] == "{" else ("", "", e.tag)
                if tag in wanted:
                    out.append((pos, open_at[-1], len(open_at) - 1, space, tag, list(e.attrib.items())))
                open_at.append(pos)
                pos += 1
        except (ET.ParseError, LookupError, ValueError):
            return []
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(((doc_id, name, *r) for doc_id, name, data in rows(batches) for r in rows_of(data or b"")), _ROWS)

    return members.select("doc_id", "name", "data").mapInArrow(read, _ROWS)


def sheets(files: DataFrame) -> DataFrame:
    """(doc_id, pos, name, state, type) of a workbook's sheets in order; nameless ones are left out.

    They are the children of the first list of sheets below the root that is in the spreadsheet namespace, or else
    in none."""
    found = xml_elements(zip_members(files, r"^xl/workbook\.xml$"), ["sheets", "sheet"])
    lists = found.where((F.col("tag") == "sheets") & (F.col("depth") == 1) & F.col("space").isin(MAIN, ""))
    first = lists.groupBy("doc_id").agg(F.min(F.struct((F.col("space") != MAIN).alias("other"), "pos")).alias("at")).select("doc_id", F.col("at.pos").alias("around"))
    own = found.where("tag = 'sheet'").join(first, ["doc_id", "around"])

    def of(name: str, default: str) -> Column:
        return F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(default))

    return own.select("doc_id", "pos", F.substring(of("name", ""), 1, SHEET_NAME).alias("name"), of("state", "visible").alias("state"), of("type", "worksheet").alias("type")).where("name <> ''")


def normal_path(folder: str, target: Column) -> Column:
    """The target as an absolute path, seen from a folder: without empty, ``.`` and ``..`` segments."""
    whole = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit(folder + "/"), target))
    zero = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        up = F.when(F.size(s) > 0, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)
        return F.when(x.isin("", "."), s).when(x == "..", up).otherwise(F.concat(s, F.array(x)))

    # Two slashes at the beginning stay, by the rule of paths.
    lead = F.when(F.startswith(whole, F.lit("//")) & ~F.startswith(whole, F.lit("///")), "//").otherwise("/")
    return F.concat(lead, F.array_join(F.aggregate(F.split(whole, "/"), zero, step), "/"))


def _of(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _altchunk_elements(files: DataFrame) -> DataFrame:
    """The elements of Word packages that name sub-documents, with their ``kind``: ref, rel or type."""
    names = "|".join(re.escape(n) for n in (DOCUMENT, DOCUMENT_RELS, CONTENT_TYPES))
    found = xml_elements(zip_members(files, f"^(?:{names})$"), ["altChunk", "Relationship", "Override"])

    def is_a(part: str, space: str, tag: str) -> Column:
        return (F.col("part") == part) & (F.col("space") == space) & (F.col("tag") == tag)

    kind = F.when(is_a(DOCUMENT, WORD, "altChunk"), "ref").when(is_a(DOCUMENT_RELS, RELATIONS, "Relationship") & (F.col("depth") == 1), "rel").when(is_a(CONTENT_TYPES, TYPES, "Override") & (F.col("depth") == 1), "type")
    return found.withColumn("kind", kind).where("kind is not null")


def altchunk_parts(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, relations, types) of Word packages, as ``altchunks`` takes them; each opens the packages anew."""
    found = _altchunk_elements(files)
    refs = found.where("kind = 'ref'").select("doc_id", "pos", _of(f"{{{DOCUMENT_RELATIONS}}}id").alias("rel_id"))
    rels = found.where("kind = 'rel'").select("doc_id", "pos", _of("Id").alias("rel_id"), _of("Type").alias("type"), _of("Target").alias("target"), _of("TargetMode").alias("target_mode"))
    types = found.where("kind = 'type'")
    return refs, rels, types.select("doc_id", "pos", F.coalesce(_of("PartName"), F.lit("")).alias("part_name"), F.coalesce(_of("ContentType"), F.lit("")).alias("content_type"))


def package_altchunks(files: DataFrame) -> DataFrame:
    """What ``altchunks`` gives for the packages' own parts, each package opened once: the three kinds of elements meet
    in groups, by relation, then by part, so none is read again for a join."""
    found = _altchunk_elements(files).select(
        "doc_id", "kind", "pos", F.when(F.col("kind") == "ref", _of(f"{{{DOCUMENT_RELATIONS}}}id")).when(F.col("kind") == "rel", _of("Id")).otherwise(F.coalesce(_of("PartName"), F.lit(""))).alias("key"),
        _of("Type").alias("type"), _of("Target").alias("target"), _of("TargetMode").alias("target_mode"), F.coalesce(_of("ContentType"), F.lit("")).alias("content_type"),
    )
    is_type, is_ref = F.col("kind") == "type", F.col("kind") == "ref"
    found = found.where(F.col("key").isNotNull() & ((F.col("kind") != "rel") | _inner()))
    last = lambda c, of: F.max_by(F.when(of, F.col(c)), F.when(of, F.col("pos")))
    # One shuffle: both groupings are within a document.
    named = found.repartition("doc_id").groupBy("doc_id", is_type.alias("typed"), "key").agg(F.collect_list(F.when(is_ref, F.col("pos"))).alias("places"), last("target", F.col("kind") == "rel").alias("target"), last("content_type", is_type).alias("content_type"))
    part = F.when(F.col("typed"), F.col("key")).otherwise(normal_path("/word", F.col("target")))
    met = named.withColumn("part_name", part).where("part_name is not null").groupBy("doc_id", "part_name").agg(F.flatten(F.collect_list("places")).alias("places"), F.max("content_type").alias("content_type"))
    return met.where(F.col("content_type").isin(list(ALTCHUNK_TYPES))).select("doc_id", F.explode("places").alias("pos"), "part_name", "content_type")


def _inner() -> Column:
    """Relations that are sub-documents inside the package; external and empty targets are none."""
    return (F.col("type") == ALTCHUNK) & (F.lower(F.coalesce("target_mode", F.lit(""))) != "external") & (F.coalesce("target", F.lit("")) != "") & (F.coalesce("key", F.lit("")) != "")


def altchunks(refs: DataFrame, rels: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_id, pos, part_name, content_type) of sub-documents in the order the document refers to them.

    refs: doc_id, pos, rel_id. rels: doc_id, pos, rel_id, type, target, target_mode. types: doc_id, pos, part_name,
    content_type. External and empty targets, other relations and other types are left out; of relations of one
    id, and of types of one part, the last holds."""
    inner = rels.where((F.col("type") == ALTCHUNK) & (F.lower(F.coalesce("target_mode", F.lit(""))) != "external") & (F.coalesce("target", F.lit("")) != "") & (F.coalesce("rel_id", F.lit("")) != ""))
    inner = inner.groupBy("doc_id", "rel_id").agg(F.max_by("target", "pos").alias("target")).select("doc_id", "rel_id", normal_path("/word", F.col("target")).alias("part_name"))
    known = types.groupBy("doc_id", "part_name").agg(F.max_by("content_type", "pos").alias("content_type")).where(F.col("content_type").isin(list(ALTCHUNK_TYPES)))
    return refs.join(inner, ["doc_id", "rel_id"]).join(known, ["doc_id", "part_name"]).select("doc_id", "pos", "part_name", "content_type")


def altchunk_data(files: DataFrame, chunks: DataFrame, total: int = TOTAL_BYTES) -> DataFrame:
    """(doc_id, pos, part_name, content_type, data) of the chunks that can be read.

    One budget holds for a package's pass, the three parts that name the chunks included; a chunk beyond it, or
    one that is not there, is left out and the next is tried."""
    each = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part_name", "content_type"))).alias("chunks"))

    schema = "doc_id long, pos int, part_name string, content_type string, data binary"

    def held(doc_id: int, content: bytes, found: list[dict]) -> Iterator[tuple]:
        left = total
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in (DOCUMENT, DOCUMENT_RELS, CONTENT_TYPES):
                    left -= z.getinfo(name).file_size
                for c in found:
                    data = bounded_read(z, c["part_name"].lstrip("/"), min(MEMBER_BYTES, left)) if left >= 0 else None
                    if data is not None:
                        left -= len(data)
                        yield doc_id, c["pos"], c["part_name"], c["content_type"], data
        except (zipfile.BadZipFile, OSError, KeyError):
            pass

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed((x for r in rows(batches) for x in held(*r)), schema)

    return files.select("doc_id", "content").join(each, "doc_id").mapInArrow(read, schema)


_SHEET_PART = re.compile(r"xl/worksheets/sheet\d+\.xml$")
_SETUP, _END = re.compile(PAGE_SETUP.encode()), re.compile(SHEET_END.encode())
_LANDSCAPE = b'<pageSetup orientation="landscape"/>'


def _raw(z: zipfile.ZipFile, e: zipfile.ZipInfo) -> bytes:
    """A member as it is stored, compressed."""
    z.fp.seek(e.header_offset)
    head = z.fp.read(30)
    if head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile("no local header")
    z.fp.seek(int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), 1)
    data = z.fp.read(e.compress_size)
    if len(data) != e.compress_size:
        raise zipfile.BadZipFile("cut short")
    return data


def landscape(content: bytes, total: int = TOTAL_BYTES, count: int = ENTRIES) -> bytes | None:
    """The package with every worksheet in landscape; None for no zip, a broken one, or one beyond the budget.

    Members that do not change are copied as they are stored, so they are never inflated."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries = z.infolist()
            if len(entries) > count or sum(e.file_size for e in entries) > total or any(e.file_size > MEMBER_BYTES for e in entries):
                return None
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
                for e in entries:
                    if _SHEET_PART.match(e.filename):
                        data = bounded_read(z, e.filename)
                        if data is None:
                            return None
                        data = _SETUP.sub(_LANDSCAPE, data) if _SETUP.search(data) else _END.sub(lambda m: _LANDSCAPE + b"</worksheet>", data, count=1)
                        new.writestr(copy.copy(e), data, zipfile.ZIP_DEFLATED)
                        continue
                    raw, kept = _raw(z, e), copy.copy(e)
                    # The sizes stand in the header, so no descriptor follows the data.
                    kept.flag_bits, kept.header_offset = e.flag_bits & ~0x08, out.seek(new.start_dir)
                    out.write(kept.FileHeader(zip64=False))
                    out.write(raw)
                    new.start_dir = out.tell()
                    new.filelist.append(kept)
                    new.NameToInfo[kept.filename] = kept
                    new._didModify = True
            return out.getvalue()
    except (zipfile.BadZipFile, zipfile.LargeZipFile, OSError, zlib.error, KeyError, NotImplementedError, RuntimeError):
        return None


def landscape_packages(files: DataFrame) -> DataFrame:
    """(doc_id, content) of spreadsheet packages in landscape; content is null where a package stays out."""

    schema = "doc_id long, content binary"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(((doc_id, None if content is None else landscape(content)) for doc_id, content in rows(batches)), schema)

    return files.select("doc_id", "content").mapInArrow(rewrite, schema)
