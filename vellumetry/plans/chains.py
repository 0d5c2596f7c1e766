"""Queries of export chains and conversion options, over events and the texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attempts as A
from ..operators.plans import convert_options
from .registry import query

_LABELS = ["docx", "xlsx", "pptx", "doc", "xls", "ppt", "odt", "ods", "odp", "odg", "rtf", "txt", "csv", "md", "xps", "oxps", "xlsb", "mht"]
_EXTENSIONS = ["docx", "dotm", "doc", "dot", "xlsx", "xlam", "xls", "xla", "xlsb", "pptx", "ppsx", "ppt", "pot", "rtf", "odt", "fodt", "ods", "odp", "odg", "csv", "md", "htm", "xyz"]
_TIMEOUT = 60

_FAMILY = """CASE WHEN {0} IN ('docx', 'docm', 'dotx', 'dotm') THEN 'wx' WHEN {0} IN ('doc', 'dot') THEN 'wo' WHEN {0} IN ('xlsx', 'xlsm', 'xltx', 'xltm', 'xlam') THEN 'cx' WHEN {0} IN ('xls', 'xlt', 'xla') THEN 'co'
WHEN {0} = 'xlsb' THEN 'cb' WHEN {0} IN ('pptx', 'pptm', 'ppsx', 'ppsm', 'potx', 'potm', 'ppam') THEN 'ix' WHEN {0} IN ('ppt', 'pps', 'pot', 'ppa') THEN 'io' WHEN {0} IN ('odt', 'ott', 'fodt') THEN 'ot'
WHEN {0} IN ('ods', 'ots', 'fods') THEN 'oc' WHEN {0} IN ('odp', 'otp', 'fodp') THEN 'oi' WHEN {0} IN ('odg', 'otg', 'fodg') THEN 'od' WHEN {0} IN ('txt', 'csv', 'md') THEN 'tx' ELSE {0} END"""

_ATTEMPTS = f"""
e AS (SELECT event_id // 6 AS doc, event_id % 6 + 1 AS pos, event_type, value FROM events),
l AS (SELECT doc, {_LABELS}[doc % {len(_LABELS)} + 1] AS label, {_EXTENSIONS}[doc // {len(_LABELS)} % {len(_EXTENSIONS)} + 1] AS ext FROM (SELECT DISTINCT doc FROM e)),
n AS (SELECT *, ({_FAMILY.format('label')}) <> ({_FAMILY.format('ext')}) AND label <> ext AS renamed, 'in' || doc || '.' || ext AS original, label = 'mht' AS preserve FROM l),
s AS (SELECT *, CASE WHEN label = 'mht' THEN 'in' || doc || '.html' WHEN label IN ('xls', 'ods', 'csv', 'xlsb') AND doc % 5 <> 0 THEN 'in' || doc || '.xlsx' WHEN renamed THEN 'in' || doc || '.' || label ELSE original END AS prepared,
  CASE WHEN label IN ('xlsx', 'xls', 'ods', 'csv', 'xlsb') THEN ['calc_pdf_Export:{{"SinglePageSheets":{{"type":"boolean","value":"true"}}}}', 'calc_pdf_Export', 'writer_pdf_Export'] WHEN label IN ('pptx', 'ppt', 'odp') THEN ['impress_pdf_Export', 'writer_pdf_Export']
  WHEN label IN ('odg', 'xps', 'oxps') THEN ['draw_pdf_Export', 'writer_pdf_Export'] ELSE ['writer_pdf_Export'] END AS filters FROM n),
u AS (SELECT doc, unnest(range(len(filters))) AS step, unnest(filters) AS filter, prepared, original, preserve, renamed FROM s),
p AS (SELECT doc, step, false AS again, filter, CASE WHEN step = 0 OR preserve THEN prepared ELSE original END AS name FROM u
  UNION ALL SELECT doc, 0, true, filter, original FROM u WHERE step = 0 AND renamed AND prepared <> original AND NOT preserve),
k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY step, again) AS pos FROM p)"""


def _planned(t):
    """Six events a document: what its attempts would give, with a label, a name and a staged form."""
    e = t("events").withColumn("doc", F.floor(F.col("event_id") / 6))
    kind = F.col("event_type")
    stderr = F.when(kind == "error", "Error: Source File Could Not Be Loaded").when(kind == "signup", "crash in no PDF").otherwise("")
    outcome = F.struct(F.col("value").cast("double").alias("seconds"), (kind == "view").alias("killed"), F.when(kind == "error", 1).when(kind == "signup", 77).otherwise(0).alias("exit_code"), stderr.alias("stderr"), (kind == "purchase").alias("made"))
    docs = e.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("event_id", outcome.alias("is"))))["is"].alias("outcomes"))
    doc = F.col("doc")

    def of(values, k):
        return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))

    docs = docs.withColumns({"label": of(_LABELS, doc), "ext": of(_EXTENSIONS, F.floor(doc / len(_LABELS)))})
    stem = F.concat(F.lit("in"), doc.cast("string"))
    sheets = F.col("label").isin("xls", "ods", "csv", "xlsb") & (doc % 5 != 0)
    prepared = F.when(F.col("label") == "mht", F.concat(stem, F.lit(".html"))).when(sheets, F.concat(stem, F.lit(".xlsx"))).otherwise(A.staged_name(stem, F.col("label"), F.col("ext")))
    return docs.select("doc", "outcomes", A.planned_attempts(F.col("label"), F.col("ext"), F.concat(stem, F.lit("."), "ext"), prepared, F.col("label") == "mht").alias("attempts"))


@query(f"WITH {_ATTEMPTS} SELECT doc, pos, step, again, filter, name FROM k")
def attempts_planned(spark, t):
    """Every attempt that each document's chain may take, in order."""
    got = _planned(t).select("doc", F.posexplode("attempts").alias("pos", "a"))
    return got.select("doc", (F.col("pos") + 1).cast("long").alias("pos"), F.col("a.step").cast("long").alias("step"), "a.again", "a.filter", "a.name")


@query(f"""
WITH RECURSIVE {_ATTEMPTS},
x AS (SELECT k.*, e.event_type AS kind, e.value AS seconds FROM k JOIN e USING (doc, pos)),
r(doc, pos, elapsed, over, retry, ok, tried, error, filter, name) AS (SELECT doc, 0, 0.0::DOUBLE, false, false, false, 0, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM s
  UNION ALL SELECT doc, pos, elapsed + CASE WHEN run THEN seconds ELSE 0 END, over OR stop OR (run AND kind = 'purchase'), run AND NOT again AND kind = 'error', ok OR (run AND kind = 'purchase'), tried + run::INT,
   CASE WHEN run AND kind = 'view' THEN 'soffice killed (timeout?): ' WHEN run AND kind = 'error' THEN 'soffice exited 1: Error: Source File Could Not Be Loaded' WHEN run AND kind = 'signup' THEN 'soffice exited 77: crash in no PDF' WHEN run AND kind = 'click' THEN 'soffice produced no PDF'
    WHEN stop THEN coalesce(error, 'soffice fallback budget exhausted') ELSE error END,
   CASE WHEN run AND kind = 'purchase' THEN now_filter ELSE filter END, CASE WHEN run AND kind = 'purchase' THEN now_name ELSE name END
   FROM (SELECT r.doc, x.pos, r.elapsed, r.over, r.ok, r.tried, r.error, r.filter, r.name, x.again, x.kind, x.seconds, x.filter AS now_filter, x.name AS now_name,
     NOT r.over AND NOT x.again AND x.step > 0 AND r.elapsed >= {_TIMEOUT} AS stop, NOT r.over AND CASE WHEN x.again THEN r.retry AND r.elapsed < {_TIMEOUT} ELSE x.step = 0 OR r.elapsed < {_TIMEOUT} END AS run
     FROM r JOIN x ON x.doc = r.doc AND x.pos = r.pos + 1)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos DESC) AS last FROM r)
SELECT doc, ok, filter, name, tried, elapsed, CASE WHEN NOT ok THEN coalesce(error, 'conversion failed') END AS error,
CASE WHEN NOT ok THEN CASE WHEN NOT contains(coalesce(error, ''), 'killed') AND contains(coalesce(error, ''), 'no PDF') THEN 'empty_output' ELSE 'error' END END AS error_class FROM f WHERE last = 1""")
def attempt_chains(spark, t):
    """What each document's chain of attempts comes to, within a minute for all."""
    got = _planned(t).select("doc", A.run_chain(F.col("attempts"), F.col("outcomes"), _TIMEOUT).alias("r"))
    return got.select("doc", "r.ok", "r.filter", "r.name", "r.tried", "r.elapsed", "r.error", "r.error_class")


def _whole(value: str, default: int, low: int, high: int) -> str:
    return f"CASE WHEN regexp_full_match(trim({value}), '[+-]?[0-9]+(_[0-9]+)*') THEN greatest({low}, least({high}, replace(trim({value}), '_', '')::HUGEINT))::INT ELSE {default} END"


@query(f"""
WITH p AS (SELECT doc_id, regexp_extract(text, '[-+]?[0-9][0-9_.]* ?') AS a, regexp_extract(text, '[0-9]{{2,}}_?[0-9]*') AS b, regexp_extract(text, '[a-z0-9]+,[a-z0-9]*') AS formats, regexp_extract(text, '[A-Za-z+]+ ?') AS lang,
 CASE WHEN doc_id % 3 > 0 THEN regexp_extract(text, '(?i:on|yes|true|1|no|der) ?') END AS flag, n_chars FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, lower(trim(flag)) IN ('1', 'true', 'yes', 'on') AS says FROM p)
SELECT doc_id, greatest(1, least(600, n_chars))::BIGINT AS timeout_s, coalesce(says, true) AS qr_enabled, CASE WHEN regexp_full_match(formats, '[a-z0-9_]+(,[a-z0-9_]+)*') THEN formats ELSE 'qr_code,micro_qr_code,rmqr_code' END AS qr_formats, {_whole('a', 10, 1, 120)} AS qr_timeout_s,
coalesce(says, false) AS ocr_enabled, coalesce(says, false) AS ocr_all, CASE WHEN regexp_full_match(trim(lang), '[A-Za-z0-9_+-]+') THEN trim(lang) ELSE 'eng+Latin' END AS ocr_lang, {_whole('a', 3, 0, 13)} AS ocr_psm, {_whole('b', 60, 1, 600)} AS ocr_timeout_s FROM g""")
def conversion_options(spark, t):
    """Options read from untrusted texts, here pieces of whole documents: huge numbers, numbers with signs, points and strokes, words, lists."""
    text = F.col("text")
    found = {"QR_TIMEOUT_S": r"[-+]?[0-9][0-9_.]* ?", "OCR_PSM": r"[-+]?[0-9][0-9_.]* ?", "OCR_TIMEOUT_S": r"[0-9]{2,}_?[0-9]*", "QR_FORMATS": "[a-z0-9]+,[a-z0-9]*", "OCR_LANG": "[A-Za-z+]+ ?"}
    flag = F.when(F.col("doc_id") % 3 > 0, F.regexp_extract(text, "(?i:on|yes|true|1|no|der) ?", 0))
    pairs = [F.lit(x) if i == 0 else F.regexp_extract(text, x, 0) for k, p in found.items() for i, x in enumerate((k, p))]
    params = F.create_map(*pairs, *[x for k in ("QR", "OCR", "OCR_ALL") for x in (F.lit(k), flag)])
    got = t("documents").where("text is not null").select("doc_id", convert_options(params, F.col("n_chars")).alias("o"))
    return got.select("doc_id", "o.*")
