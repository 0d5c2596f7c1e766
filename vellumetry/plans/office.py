"""Queries over office packages made of conversations: a sheet, a sub-document or a part for each turn."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import containers as C
from ..operators import office as W
from ..operators.arrow import packed, rows
from .registry import query


def _turns(t):
    """doc_id and turns (an array of turn, role and text, one for each turn)."""
    c = t("conversations").groupBy(F.col("conv_id").alias("doc_id"), "turn").agg(F.min(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("is"))
    return c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "is.role", "is.text"))).alias("turns"))


def _packages(t, members):
    """(doc_id, content): a zip of what members(doc_id, turns) gives, names and texts."""

    schema = "doc_id long, content binary"

    def package(doc_id, turns) -> bytes:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in members(doc_id, turns):
                z.writestr(name, text)
        return held.getvalue()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(((doc_id, package(doc_id, turns)) for doc_id, turns in rows(batches)), schema)

    return _turns(t).mapInArrow(pack, schema)


def _attribute(text: str) -> str:
    """Quoted for XML, with the quote that the text asks for; white space other than blanks as character references."""
    return quoteattr(text, {"\n": "&#10;", "\r": "&#13;", "\t": "&#9;"})


def _workbook(doc_id, turns):
    spaces = ['xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', ""]
    pre = "x:" if doc_id % 3 == 1 else ""
    rows = "".join(f"<{pre}sheet name={_attribute(x['text'][:40])} sheetId='{x['turn']}'{' state=' + chr(39) + 'hidden' + chr(39) if x['turn'] % 3 == 1 else ''}{' type=' + chr(34) + 'macro' + chr(34) if x['role'] == 'user' else ''}/>" for x in turns)
    head = "<!DOCTYPE x>" if doc_id % 7 == 6 else ""
    yield "xl/workbook.xml", f"{head}<{pre}workbook {spaces[doc_id % 3]}><{pre}sheets>{rows}</{pre}sheets><{pre}other><{pre}sheet name='no'/></{pre}other></{pre}workbook>"


@query("""
WITH c AS (SELECT conv_id, turn, min(struct_pack(r := role, t := coalesce(text, ''))) AS x FROM conversations GROUP BY 1, 2)
SELECT conv_id AS doc_id, x.t[1:40] AS name, CASE WHEN turn % 3 = 1 THEN 'hidden' ELSE 'visible' END AS state, CASE WHEN x.r = 'user' THEN 'macro' ELSE 'worksheet' END AS type FROM c WHERE conv_id % 7 <> 6 AND x.t <> ''""")
def sheet_xml(spark, t):
    """Sheets named by texts, in single or double quotes and with entities, in three ways of namespaces; packages that declare a type have none."""
    return W.sheets(_packages(t, _workbook)).select("doc_id", "name", "state", "type")


def _document(doc_id, turns):
    kinds = {"user": "text/html", "assistant": "message/rfc822", "system": "application/msword"}
    ups = ["", "./", "a/../", "a/b/../../", "/word/", "../word/", "x/./../"]
    refs = "".join(f"<w:p><w:altChunk r:id='r{x['turn']}'/></w:p>" for x in reversed(turns))
    rels = "".join(
        f'<Relationship Id="r{x["turn"]}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/aFChunk" Target="{ups[x["turn"] % len(ups)]}chunk{x["turn"]}.bin"{" TargetMode=" + chr(34) + "External" + chr(34) if len(x["text"]) % 5 == 0 else ""}/>'
        for x in turns
    )
    types = "".join(f"<Override PartName='/word/chunk{x['turn']}.bin' ContentType={_attribute(kinds.get(x['role'], 'image/png'))}/>" for x in turns)
    yield "word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>{refs}</w:body></w:document>'
    yield "word/_rels/document.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
    yield "[Content_Types].xml", f"<Types xmlns='http://schemas.openxmlformats.org/package/2006/content-types'>{types}</Types>"
    for x in turns:
        if len(x["text"]) % 3:
            yield f"word/chunk{x['turn']}.bin", x["text"]


_CHUNKS = """
WITH c AS (SELECT conv_id, turn, min(struct_pack(r := role, t := coalesce(text, ''))) AS x FROM conversations GROUP BY 1, 2),
k AS (SELECT conv_id AS doc_id, turn, x.t AS text, CASE x.r WHEN 'user' THEN 'text/html' WHEN 'assistant' THEN 'message/rfc822' WHEN 'system' THEN 'application/msword' END AS content_type FROM c WHERE length(x.t) % 5 <> 0)"""


@query(f"{_CHUNKS} SELECT doc_id, CASE WHEN count(*) FILTER (WHERE content_type = 'application/msword') > 0 THEN 'unsupported_type' WHEN count(*) > 1 THEN 'several' ELSE 'substitute' END AS action FROM k WHERE content_type IS NOT NULL GROUP BY doc_id")
def altchunk_join(spark, t):
    """What is done about sub-documents, from the package's own document, relations and content types."""
    return C.altchunk_policy(W.package_altchunks(_packages(t, _document)))


@query(f"""
{_CHUNKS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) AS nth, '/word/chunk' || turn || '.bin' AS part_name, content_type, octet_length(encode(text))::BIGINT AS size, md5(text) AS data
FROM k WHERE content_type IS NOT NULL AND length(text) % 3 <> 0""")
def altchunk_bytes(spark, t):
    """The sub-documents' bytes in the order of reference, which is the turns' from the last; missing parts are left out."""
    from pyspark.sql.window import Window

    files = _packages(t, _document)
    got = W.altchunk_data(files, W.package_altchunks(files))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long")
    return got.select("doc_id", nth.alias("nth"), "part_name", "content_type", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("data"))


def _sheets(doc_id, turns):
    for x in turns:
        setup = '<pageSetup paperSize="9"/>' if x["role"] == "user" else ""
        yield f"xl/worksheets/sheet{x['turn']}.xml", f"<worksheet><c>{escape(x['text'])}</c>{setup}</worksheet>"
        yield f"xl/media/{x['turn']}.txt", x["text"]


@query("""
WITH c AS (SELECT conv_id, turn, min(struct_pack(r := role, t := coalesce(text, ''))) AS x FROM conversations GROUP BY 1, 2)
SELECT conv_id AS doc_id, 'xl/worksheets/sheet' || turn || '.xml' AS name, md5('<worksheet><c>' || replace(replace(replace(x.t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</c><pageSetup orientation="landscape"/></worksheet>') AS data FROM c
UNION ALL SELECT conv_id, 'xl/media/' || turn || '.txt', md5(x.t) FROM c""")
def landscape_packages(spark, t):
    """Every member of the packages written anew: sheets in landscape, all else as it was."""
    done = W.landscape_packages(_packages(t, _sheets)).where("content is not null")
    return C.zip_members(done, ".").select("doc_id", "name", F.md5("data").alias("data"))


def _dimensions(doc_id, turns):
    for x in turns:
        n = len(x["text"])
        letters = chr(65 + n % 26) if n % 52 < 26 else "A" + chr(65 + n % 26)
        yield f"xl/worksheets/sheet{x['turn']}.xml", f'<worksheet><dimension ref="A1:{letters}{n % 250 + 1}"/></worksheet>'


@query("""
WITH c AS (SELECT conv_id, turn, min(struct_pack(r := role, t := coalesce(text, ''))) AS x FROM conversations GROUP BY 1, 2), n AS (SELECT conv_id AS doc_id, length(x.t) AS n FROM c)
SELECT doc_id, bool_or(n % 250 + 1 > 200 OR CASE WHEN n % 52 < 26 THEN n % 26 + 1 ELSE 26 + n % 26 + 1 END > 30) AS oversized FROM n GROUP BY doc_id""")
def oversized_packages(spark, t):
    """Workbooks of which any sheet goes beyond the limits, from the sheets' own dimensions."""
    return C.oversized_sheets(_packages(t, _dimensions))
