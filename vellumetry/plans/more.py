"""Further queries: artifacts by route, relabelling, content warnings, the style cascade, fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as T
from ..operators import attempts as A
from ..operators import cascade, containers, scanners
from ..operators import detect as D
from ..operators import jobs as J
from ..operators import plans as O
from ..sources.files import artifact
from .registry import query


def _of(column: str, values: list):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values)).cast("int"))


@query("""
SELECT conv_id::VARCHAR AS job_id, CASE WHEN conv_id % 4 = 1 THEN 409 WHEN conv_id % 4 = 2 THEN 410 WHEN max(turn) >= 2 THEN 200 ELSE 404 END AS http, CASE WHEN conv_id % 4 IN (0, 3) AND max(turn) >= 2 THEN 'page-003.png' END AS file
FROM conversations GROUP BY conv_id""")
def artifact_route(spark, t):
    c = t("conversations").select(F.col("conv_id").cast("string").alias("job_id"), "conv_id", "turn")
    files = c.select("job_id", T.page_file((F.col("turn") + 1).cast("int")).alias("file")).distinct()
    jobs = c.select("job_id", _of("conv_id", ["done", "running", "expired", "done"]).alias("status")).distinct()
    return artifact(files, jobs, F.col("job_id"), F.lit(3)).select("job_id", "http", "file")


#: Names and types that a word stands for, by its length; {} is the word itself.
_MIMES = ["application/vnd.ms-excel", "application/zip", "text/rtf", "image/{}", "application/vnd.openxmlformats-officedocument.presentationml.{}", "text/csv", "application/msword", "application/{}"]
_LABELS = ["docx", "xlsx", "odt", "txt", "pdf", "pptx", "odg"]
_FOLDERS = ["ppt/{}", "word/{}", "xl/{}", "{}", "word"]
_MARKERS = ["text", "spreadsheet", "presentation", "graphics", "{}"]
_STREAMS = ["WordDocument", "VBA/{}", "Macros", "{}", "EncryptedPackage", "1Table", "{}", "Book/{}", "{}", "{}", "PP97_DUALSTORAGE"]
_ENTRIES = ["word/document.xml", "xl/{}.bin", "{}.exe", "odd/{}.vbs", "word/{}.bin", "{}.txt", "docProps/{}.js", "xl/workbook.xml", "{}.dllx"]


def _stands_for(word, names: list):
    def filled(x: str):
        return F.concat(*[p for i, part in enumerate(x.split("{}")) for p in ([word] if i else []) + [F.lit(part)]])

    return F.get(F.array(*map(filled, names)), F.length(word) % len(names))


def _sql_for(word: str, names: list) -> str:
    return f"CASE length({word}) % {len(names)} " + " ".join(f"WHEN {i} THEN replace('{x}', '{{}}', {word})" for i, x in enumerate(names)) + " END"


def _words(t, n: int):
    return t("documents").select("doc_id", F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, n).alias("w")).where(F.size("w") == n)


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+')[1:6] AS w FROM documents), e AS (SELECT * FROM d WHERE len(w) = 6),
f AS (SELECT doc_id, {_sql_for('w[1]', _MIMES)} AS mime, {_sql_for('w[2]', _LABELS)} AS label, list_transform(w[3:5], lambda x: {_sql_for('x', _FOLDERS)}) AS dirs, 'application/vnd.oasis.opendocument.' || {_sql_for('w[6]', _MARKERS)} AS marker FROM e),
g AS (SELECT *, CASE WHEN contains(mime, 'presentationml') THEN 'pptx' WHEN contains(mime, 'wordprocessingml') THEN 'docx' WHEN contains(mime, 'spreadsheetml') THEN 'xlsx' WHEN contains(mime, 'vnd.ms-powerpoint') THEN 'ppt' WHEN contains(mime, 'msword') THEN 'doc'
  WHEN contains(mime, 'vnd.ms-excel') THEN 'xls' WHEN contains(mime, 'text/rtf') OR contains(mime, 'application/rtf') THEN 'rtf' WHEN contains(mime, 'text/csv') THEN 'csv' END AS said,
  len(list_filter(dirs, lambda x: starts_with(x, 'ppt/'))) > 0 AS p, len(list_filter(dirs, lambda x: starts_with(x, 'word/'))) > 0 AS w, len(list_filter(dirs, lambda x: starts_with(x, 'xl/'))) > 0 AS x FROM f)
SELECT doc_id, CASE WHEN label IN ('docx', 'xlsx', 'pptx', 'txt') THEN coalesce(said, CASE WHEN label <> 'txt' AND p::INT + w::INT + x::INT = 1 THEN CASE WHEN p THEN 'pptx' WHEN w THEN 'docx' ELSE 'xlsx' END END, label) ELSE label END AS office,
CASE WHEN label IN ('odt', 'odg') THEN CASE WHEN ends_with(marker, '.text') THEN 'odt' WHEN ends_with(marker, '.spreadsheet') THEN 'ods' WHEN ends_with(marker, '.presentation') THEN 'odp' WHEN ends_with(marker, '.graphics') THEN 'odg' ELSE label END ELSE label END AS odf FROM g""")
def relabelled(spark, t):
    """Labels as the first words of documents have them, corrected by media type, folders and marker."""
    w = [F.get("w", F.lit(i)) for i in range(6)]
    label = _stands_for(w[1], _LABELS)
    dirs = F.transform(F.slice("w", 3, 3), lambda x: _stands_for(x, _FOLDERS))
    marker = F.concat(F.lit("application/vnd.oasis.opendocument."), _stands_for(w[5], _MARKERS))
    return _words(t, 6).select("doc_id", D.magic_label(label, _stands_for(w[0], _MIMES), dirs).alias("office"), D.odf_label(label, marker).alias("odf"))


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+')[1:7] AS w FROM documents), e AS (SELECT * FROM d WHERE len(w) = 7),
f AS (SELECT doc_id, list_transform(w[1:3], lambda x: {_sql_for('x', _STREAMS)}) AS streams, list_transform(w[4:7], lambda x: {{'name': {_sql_for('x', _ENTRIES)}, 'size': greatest(length(x) - 4, 0)}}) AS entries FROM e),
g AS (SELECT *, list_contains(streams, 'EncryptedPackage') AS locked, len(list_filter(streams, lambda x: contains(x, 'VBA') OR contains(x, 'Macros'))) > 0 AS vba,
  len(list_filter(streams, lambda x: x IN ('PowerPoint Document', 'PP97_DUALSTORAGE', 'WordDocument', '1Table', '0Table', 'Workbook', 'Book'))) > 0 AS content FROM f)
SELECT doc_id, concat_ws(',', CASE WHEN vba AND NOT content AND NOT locked THEN 'ole_macro_only_payload' END, CASE WHEN locked THEN 'ole_encrypted' END) AS ole,
concat_ws(',', CASE WHEN len(list_filter(entries, lambda x: x.name IN ('word/document.xml', 'xl/workbook.xml') AND x.size = 0)) > 0 THEN 'ooxml_empty_core_document' END,
 CASE WHEN len(list_filter(entries, lambda x: regexp_matches(x.name, '\\.(bin|exe|vbs|js)$') AND NOT regexp_matches(x.name, '^(word|xl|docProps)/'))) > 0 THEN 'ooxml_suspicious_entries' END) AS ooxml FROM g""")
def content_warnings(spark, t):
    """Stream names and package entries as the first words of documents have them."""
    streams = F.transform(F.slice("w", 1, 3), lambda x: _stands_for(x, _STREAMS))
    entries = F.transform(F.slice("w", 4, 4), lambda x: F.struct(_stands_for(x, _ENTRIES).alias("name"), F.greatest(F.length(x) - 4, F.lit(0)).cast("long").alias("size")))
    return _words(t, 7).select("doc_id", F.array_join(D.ole_warnings(streams), ",").alias("ole"), F.array_join(D.ooxml_warnings(entries), ",").alias("ooxml"))


@query(r"""
WITH RECURSIVE d AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN '"' ELSE '' END || replace(replace(replace(replace(text[1:400], '.', ';'), ' ', ': '), 'a', '"'), ',', '''') AS style FROM conversations),
w(conv_id, turn, i, quote, n, ch, style) AS (SELECT conv_id, turn, 0, '', 0, '', style FROM d
  UNION ALL SELECT conv_id, turn, i + 1, CASE WHEN quote <> '' THEN CASE WHEN style[i + 1] = quote THEN '' ELSE quote END WHEN style[i + 1] IN ('"', '''') THEN style[i + 1] ELSE '' END,
   n + (quote = '' AND style[i + 1] = ';')::INT, CASE WHEN quote = '' AND style[i + 1] = ';' THEN '' ELSE style[i + 1] END, style FROM w WHERE i < length(style)),
p AS (SELECT conv_id, turn, n, string_agg(ch, '' ORDER BY i) AS piece FROM w WHERE i > 0 GROUP BY ALL),
v AS (SELECT conv_id, turn, n, lower(regexp_replace(split_part(piece, ':', 1), '^\s+|\s+$', '', 'g')) AS name, regexp_replace(piece[position(':' IN piece) + 1:], '^\s+|\s+$', '', 'g') AS value FROM p WHERE contains(piece, ':')),
k AS (SELECT conv_id, turn, name, arg_max(value, n) AS value, min(n) AS n FROM v WHERE name <> '' AND value <> '' GROUP BY ALL)
SELECT d.conv_id, d.turn, count(k.name) AS n, coalesce(string_agg(k.name || '=' || k.value, '|' ORDER BY k.n), '') AS declared FROM d LEFT JOIN k USING (conv_id, turn) GROUP BY ALL""")
def css_declarations(spark, t):
    """Turns as styles, their points semicolons and many of their letters quotes: what is declared, in order."""
    text = F.substring("text", 1, 400)
    for old, new in ((".", ";"), (" ", ": "), ("a", '"'), (",", "'")):
        text = F.replace(text, F.lit(old), F.lit(new))
    props = T.declarations(F.concat(F.when(F.length("text") % 3 == 0, '"').otherwise(""), text))
    pairs = F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t("conversations").select("conv_id", "turn", F.size(pairs).cast("long").alias("n"), F.array_join(pairs, "|").alias("declared"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '<worksheet><pageSetup orientation="landscape"/></worksheet>' WHEN 1 THEN '<worksheet>' || p_size::VARCHAR || '<pageSetup orientation="landscape"/></worksheet>' ELSE '<other/>' END AS xml FROM part""")
def landscape_patch(spark, t):
    xml = F.when(F.col("p_size") % 3 == 0, '<worksheet><pageSetup paper="9"/></worksheet>').when(F.col("p_size") % 3 == 1, F.concat(F.lit("<worksheet>"), F.col("p_size").cast("string"), F.lit("</worksheet>"))).otherwise("<other/>")
    return t("part").select("p_partkey", T.landscape_patch(xml).alias("xml"))


@query("""
SELECT conv_id AS doc_id, 1 + 2 * (turn - 1) + k AS pos, CASE k WHEN 0 THEN 'td' ELSE 'p' END AS tag, CASE WHEN k = 0 AND turn % 2 = 0 THEN '#aabbcc' END AS bgcolor, 'center' AS align,
CASE WHEN k = 1 AND turn % 3 = 0 THEN 'red' ELSE 'navy' END AS color, turn % 3 = 0 AND k = 1 AS bold FROM (SELECT DISTINCT conv_id, 1 AS turn FROM conversations UNION SELECT DISTINCT conv_id, 2 FROM conversations UNION SELECT DISTINCT conv_id, 3 FROM conversations), (VALUES (0), (1)) v(k)""")
def style_cascade(spark, t):
    """A centred table of three cells, whose rules come from tag, class and style attribute."""
    rows = "".join(f'<td{" style=" + chr(34) + "background:#abc" + chr(34) if i % 2 == 0 else ""}><p{" class=k" if i % 3 == 0 else ""}>x</p></td>' for i in (1, 2, 3))
    html = f'<table style="text-align:center">{rows}</table>'
    docs = t("conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    rules = containers.css_rules(docs.withColumn("html", F.lit("<style>td{color:navy} p{color:green;color:navy} p.k{color:red;font-weight:700}</style>")))
    got = cascade.legacy_attributes(docs.withColumn("html", F.lit(html)), rules)
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "tag", "bgcolor", "align", "color", "bold")


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'calc_pdf_Export:{"SinglePageSheets":{"type":"boolean","value":"true"}};calc_pdf_Export;writer_pdf_Export' WHEN 2 THEN 'impress_pdf_Export;writer_pdf_Export' ELSE 'writer_pdf_Export' END AS tries, p_size % 4 IN (1, 2) AS renamed,
CASE p_size % 3 WHEN 0 THEN '--scale=2.083333' WHEN 1 THEN '-r 150' END AS raster, p_size % 2 = 0 AS argv_ok, p_size % 4 = 0 AS focus FROM part""")
def fallback_plans(spark, t):
    label, ext = _of("p_size", ["xlsx", "docx", "pptx", "txt"]), _of("p_size", ["xlsm", "doc", "odg", "csv"])
    return t("part").select(
        "p_partkey", F.array_join(A.filters_to_try(label), ";").alias("tries"), A.needs_rename(label, ext).alias("renamed"), O.rasterizer(_of("p_size", ["pdfium", "pdftoppm", "none"]), 150).alias("raster"),
        T.positional_ok(_of("p_size", ["in.doc", "-in.doc"])).alias("argv_ok"), label.isin(L.FOCUSABLE).alias("focus"),
    )


@query("SELECT event_id::VARCHAR AS job_id FROM events WHERE event_id % 7 = 3 AND event_id % 2 = 0")
def jobs_by_id(spark, t):
    jobs = t("events").select(F.col("event_id").cast("string").alias("job_id"), "event_id")
    gone = jobs.where("event_id % 2 = 1")
    return J.by_id(J.without(jobs, gone), F.when(F.col("event_id") % 7 == 3, F.col("job_id"))).select("job_id")


@query("""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+')[1:3] AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: CASE length(x) % 4 WHEN 0 THEN 'QRCode' WHEN 1 THEN 'MicroQRCode' WHEN 2 THEN 'rMQRCode' ELSE x END), ',') AS formats, length(w[1]) % 2 = 0 AS nothing FROM w WHERE len(w) = 3""")
def scanner_arguments(spark, t):
    """Formats as the first words of turns name them, and output that says so or not."""
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 3)
    named = F.array_join(F.transform(words, lambda x: F.when(F.length(x) % 4 == 0, " qr_code").when(F.length(x) % 4 == 1, "micro_qr_code ").when(F.length(x) % 4 == 2, "rmqr_code").otherwise(x)), ",")
    output = F.concat(F.col("text"), F.when(F.length(F.get(words, F.lit(0))) % 2 == 0, "\nNo barcode found\n").otherwise("\nText: x"))
    return t("conversations").where(F.size(words) == 3).select("conv_id", "turn", scanners.old_format_names(named).alias("formats"), scanners.found_nothing(output).alias("nothing"))


@query("""
SELECT page_id, md5(coalesce(h, '')) AS html, length(h) - length(html) AS added FROM (SELECT page_id, html, replace(regexp_replace(html, '(?s)<style>p\\{margin:0\\}</style>', ''), '<p>', '<p style="margin:0">') AS h FROM pages)""")
def legacy_html(spark, t):
    """Pages with what their style blocks say put into the tags, all else as it was."""
    pages = t("pages").select(F.col("page_id").alias("doc_id"), "html")
    done = cascade.inject(pages, containers.css_rules(pages)).withColumnRenamed("html", "new")
    got = pages.join(done, "doc_id")
    return got.select(F.col("doc_id").alias("page_id"), F.md5(F.coalesce("new", F.lit(""))).alias("html"), (F.length("new") - F.length("html")).cast("long").alias("added"))
