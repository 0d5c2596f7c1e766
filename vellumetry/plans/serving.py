"""Queries of scanners, jobs and metrics. Conversations stand for pages, events for jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as T
from ..operators import jobs as J
from ..operators import scanners as S
from ..operators.envelope import details, envelope
from ..operators.plans import cut, export_plan, option_clamp, security_block, warning, warnings_in_order
from .registry import query

_C = "conversations"
#: Pages of records that one task holds.
PAGES = 200_000


def _pick(column: str, values: list) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values)).cast("int"))


@query("""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, 'o') = false THEN 'disabled' WHEN length(t) % 7 = 0 THEN 'blank_page' WHEN contains(t, '?') THEN 'timeout' WHEN ends_with(t, chr(10)) OR contains(t, '***') THEN 'error' END AS skipped FROM c""")
def qr_gating(spark, t):
    """Whether a turn's page is scanned, by its text: what is blank, what ran too long, what went wrong."""
    text = F.coalesce("text", F.lit(""))
    code = F.when(text.contains("?"), -9).when(text.endswith("\n") | text.contains("***"), 1).otherwise(0)
    return t(_C).select("conv_id", "turn", S.qr_skipped(text.contains("o"), F.length(text) % 7 == 0, code).alias("skipped"))


@query("""
WITH p AS (SELECT conv_id, turn, length(text) * 100 AS ms, conv_id % 5 <> 0 AS en, turn % 4 = 0 AS blank, conv_id % 2 = 0 AS every, turn % 2 = 1 AS worth, CASE turn % 3 WHEN 0 THEN 0 WHEN 1 THEN -9 ELSE 1 END AS code FROM conversations),
b AS (SELECT *, 60.0 - coalesce(sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000.0 AS left_s FROM p)
SELECT conv_id, turn, CASE WHEN NOT en THEN 'disabled' WHEN blank THEN 'blank_page' WHEN NOT every AND NOT worth THEN 'no_images' WHEN left_s < 30 THEN 'timeout_budget' WHEN code = -9 THEN 'timeout' WHEN code <> 0 THEN 'error' END AS skipped FROM b""")
def ocr_gating(spark, t):
    p = t(_C).select("conv_id", "turn", (F.length("text") * 100).alias("duration_ms"))
    p = S.with_time_left(p, 60, "conv_id", "turn")
    worth = S.worth_ocr(F.lit(0), F.col("turn") % 2 == 1, F.lit(False))
    return p.select("conv_id", "turn", S.ocr_skipped(F.col("conv_id") % 5 != 0, F.col("turn") % 4 == 0, F.col("conv_id") % 2 == 0, worth, F.col("left_s"), _pick("turn", [0, -9, 1])).alias("skipped"))


@query("""
WITH p AS (SELECT conv_id, turn, length(text) * 100 AS ms FROM conversations),
b AS (SELECT *, 60.0 - coalesce(sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000.0 AS left_s FROM p)
SELECT conv_id, turn, floor(greatest(0, left_s))::INT AS warm, greatest(1, floor(greatest(0, left_s - ms / 1000.0)))::INT AS cold FROM b""")
def ocr_timeouts(spark, t):
    """Seconds that the warm scanner may take for a page, and the cold one after the warm one failed."""
    p = S.with_time_left(t(_C).select("conv_id", "turn", (F.length("text") * 100).alias("duration_ms")), 60, "conv_id", "turn")
    warm, cold = S.scan_timeouts(F.col("left_s"), F.col("duration_ms") / 1000)
    return p.select("conv_id", "turn", warm.alias("warm"), cold.alias("cold"))


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'error' END AS kind, rtrim(text, chr(10)) AS text, length(rtrim(text, chr(10)))::BIGINT AS char_count,
CASE WHEN turn % 2 = 0 THEN 'warm' ELSE 'cold' END AS used, CASE WHEN turn % 2 = 1 THEN 'ocr_warm_fallback' END AS warning FROM conversations""")
def scan_outcome(spark, t):
    text = S.ocr_text(F.concat("text", F.lit("\n\n")))
    used, warning = S.warm_or_cold(F.when(F.col("turn") % 2 == 0, "warm"), F.lit("cold"))
    message = F.when(F.col("turn") % 3 == 0, "scan TimeOut after 10 s").when(F.col("turn") % 3 == 1, "no such file")
    return t(_C).select("conv_id", "turn", S.error_kind(message).alias("kind"), text.alias("text"), F.length(text).cast("long").alias("char_count"), used.alias("used"), warning.alias("warning"))


@query("""
SELECT conv_id, turn, 'qr_code' AS format, role AS value, turn % 2 = 0 AS is_mirrored FROM conversations
UNION ALL SELECT conv_id, turn, 'ean_13', conv_id::VARCHAR, false FROM conversations""")
def qr_parse_json(spark, t):
    first = F.concat(F.lit('{"Format":"QRCode","Text":"'), "role", F.lit('","IsMirrored":'), F.when(F.col("turn") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    second = F.concat(F.lit('{"Format":"EAN-13","Text":"'), F.col("conv_id").cast("string"), F.lit('"}'))
    out = F.concat(first, F.lit('\nnot a line\n{"Text":"no format"}\n'), second)
    rows = t(_C).select("conv_id", "turn", F.explode(S.json_lines(out)).alias("r"))
    return rows.select("conv_id", "turn", "r.format", "r.value", "r.is_mirrored")


@query("""
SELECT conv_id, turn, 'qr_code' AS format, '"' || role AS value, '1x1 2x2' AS position, 'M' AS level, turn % 2 = 0 AS mirrored, NULL AS bytes FROM conversations
UNION ALL SELECT conv_id, turn, 'upc_a', turn::VARCHAR, NULL, NULL, false, 'AB' FROM conversations UNION ALL SELECT conv_id, turn, 'new_code_7', role, NULL, NULL, false, NULL FROM conversations""")
def qr_parse_plain(spark, t):
    turn = F.col("turn").cast("string")
    mirrored = F.when(F.col("turn") % 2 == 0, "True").otherwise("no")
    out = F.concat(
        F.lit('Text: "old"\nText: "'), "role", F.lit("\nFormat: QRCode\nPosition: 1x1 2x2\nEC Level:  M\nIsMirrored: "), mirrored, F.lit("\n \nText:\t "), turn,
        F.lit("\nFormat:   UPC-A\nBytes: AB\n\nText: no format\n\n\nFormat: NewCode-7\r\nText: \""), "role", F.lit('"\n'),
    )
    r = t(_C).select("conv_id", "turn", F.explode(S.plain_blocks(out)).alias("r"))
    return r.select("conv_id", "turn", "r.format", "r.value", "r.position", F.col("r.error_correction_level").alias("level"), F.col("r.is_mirrored").alias("mirrored"), F.col("r.raw_bytes_hex").alias("bytes"))


@query("""SELECT conv_id, turn, text AS value, 'u0041b' AS odd, '12' AS bare, true AS none FROM conversations WHERE text IS NOT NULL""")
def qr_strict_lines(spark, t):
    """Each turn's text through the scanner's own line grammar, escapes and all; a broken line is dropped."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
    line = F.concat(F.lit('{"Text":"'), text, F.lit('", "odd" : "\\u0041\\b","bare":12 ,"none":null}\n{"broken":"x}\n'))
    r = t(_C).where("text is not null").select("conv_id", "turn", F.explode(S.exact_lines(line)).alias("r"))
    return r.select("conv_id", "turn", F.col("r")["Text"].alias("value"), F.col("r")["odd"].alias("odd"), F.col("r")["bare"].alias("bare"), F.col("r")["none"].isNull().alias("none"))


_JOBS = """(SELECT event_id::VARCHAR AS job_id, 'File' || user_id::VARCHAR || '.' || CASE event_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' ELSE 'csv' END AS filename,
CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status, epoch(ts) AS created_at, epoch(ts) + value AS finished_at, (event_id % 9)::INT AS pages_total, event_type, value FROM events)"""


def _jobs(t):
    e = t("events")
    created = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")) / 1e6
    return e.select(
        F.col("event_id").cast("string").alias("job_id"), F.concat(F.lit("File"), F.col("user_id").cast("string"), F.lit("."), _pick("event_id", ["docx", "xlsx", "csv"])).alias("filename"), _pick("event_id", ["queued", "running", "done", "failed"]).alias("status"),
        created.alias("created_at"), created.alias("started_at"), (created + F.col("value")).alias("finished_at"), (F.col("event_id") % 9).cast("int").alias("pages_total"), "event_type", "value",
    )


@query(f"SELECT job_id, filename, status, pages_total FROM {_JOBS} WHERE status = 'done' AND contains(lower(filename), 'file1') ORDER BY pages_total DESC, job_id LIMIT 50 OFFSET 10")
def jobs_list(spark, t):
    return J.listing(_jobs(t), status="done", q="FILE1", sort="pages", offset=10, limit=50).select("job_id", "filename", "status", "pages_total")


@query(f"""
SELECT job_id, CASE WHEN status = 'queued' AND 1706000000 - created_at > 600000 THEN 'failed' WHEN status IN ('done', 'failed') AND finished_at + 864000 < 1706000000 THEN 'expired' ELSE status END AS status FROM {_JOBS}""")
def jobs_expiry(spark, t):
    return _jobs(t).select("job_id", J.status_at(1706000000, 864000, 600000).alias("status"))


@query(f"SELECT event_type, count(*) FILTER (WHERE status = 'done') AS done, count(*) AS total FROM {_JOBS} GROUP BY ROLLUP (event_type)")
def corpus_tally(spark, t):
    return J.tally(_jobs(t), "event_type")


@query(f"""
WITH n AS (SELECT event_type, count(*) FILTER (WHERE status = 'done') AS done, count(*) AS total FROM {_JOBS} GROUP BY ROLLUP (event_type)),
b AS (SELECT event_type, count(*) FILTER (WHERE status = 'done') AS done, count(*) AS total FROM {_JOBS} WHERE value > 20 GROUP BY ROLLUP (event_type))
SELECT n.event_type, n.done, n.total, b.done AS base_done, b.total AS base_total, coalesce(n.done * b.total < b.done * n.total, false) AS worse FROM n LEFT JOIN b ON n.event_type IS NOT DISTINCT FROM b.event_type""")
def tally_against(spark, t):
    """All jobs against a baseline, the jobs of larger values."""
    jobs = _jobs(t)
    return J.tally_against(J.tally(jobs, "event_type"), J.tally(jobs.where("value > 20"), "event_type"), "event_type")


@query(f"SELECT status, event_type, count(*) AS n FROM {_JOBS} GROUP BY 1, 2")
def conversion_counter(spark, t):
    return J.counts(_jobs(t), "status", "event_type")


@query("""
WITH b AS (SELECT unnest([1024.0, 8192, 65536, 524288, 4194304, 33554432, 134217728]) AS le), v AS (SELECT source, octet_length(encode(text)) AS n FROM documents)
SELECT source, le::DOUBLE AS le, count(*) FILTER (WHERE v.n <= le) AS n FROM v, b GROUP BY 1, 2 UNION ALL SELECT source, 'inf'::DOUBLE, count(*) FROM v GROUP BY 1""")
def histogram_bytes(spark, t):
    return J.histogram(t("documents").select("source", F.octet_length("text").alias("n_bytes")), "n_bytes", L.BYTE_BUCKETS, "source")


@query(f"""
WITH b AS (SELECT unnest({L.SECOND_BUCKETS}) AS le), v AS (SELECT event_type, value / 10 AS s FROM events)
SELECT event_type, le::DOUBLE AS le, count(*) FILTER (WHERE s <= le) AS n FROM v, b GROUP BY 1, 2 UNION ALL SELECT event_type, 'inf'::DOUBLE, count(*) FROM v GROUP BY 1""")
def stage_timings(spark, t):
    return J.histogram(t("events").select("event_type", (F.col("value") / 10).alias("s")), "s", L.SECOND_BUCKETS, "event_type")


@query(f"""
WITH d AS (SELECT event_type, floor(created_at) AS t, 1 AS d FROM {_JOBS} UNION ALL SELECT event_type, floor(finished_at) + 1, -1 FROM {_JOBS}),
s AS (SELECT event_type, t, sum(d) AS d FROM d GROUP BY 1, 2) SELECT event_type, t::BIGINT AS t, (sum(d) OVER (PARTITION BY event_type ORDER BY t))::BIGINT AS running FROM s""")
def in_flight(spark, t):
    j = _jobs(t).withColumn("started_at", F.floor("created_at")).withColumn("finished_at", F.floor("finished_at") + 1)
    return J.in_flight(j, "event_type").select("event_type", F.col("t").cast("long").alias("t"), F.col("running").cast("long").alias("running"))


@query("SELECT conv_id::VARCHAR AS job_id, count(*) FILTER (WHERE turn % 3 <> 1) AS pages FROM conversations GROUP BY conv_id")
def pages_listed(spark, t):
    file = F.when(F.col("turn") % 3 == 0, T.page_file((F.col("turn") + 1).cast("int"))).when(F.col("turn") % 3 == 1, T.page_file((F.col("turn") + 1).cast("int"), "trimmed")).otherwise(F.concat(F.lit("page-"), F.col("turn").cast("string"), F.lit(".png")))
    return J.pages_listed(t(_C).select(F.col("conv_id").cast("string").alias("job_id"), file.alias("file")))


@query("""
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations), k AS (SELECT conv_id, turn, CASE length(w) % 3 WHEN 0 THEN 'APP_' || upper(w) WHEN 1 THEN upper(w) ELSE 'app_' || w END AS key FROM w),
a AS (SELECT DISTINCT key FROM k WHERE length(key) % 2 = 0), r AS (SELECT DISTINCT key FROM k WHERE length(key) % 5 = 0)
SELECT conv_id, turn, key, count(*) AS n FROM k WHERE regexp_full_match(key, '[A-Z][A-Z0-9_]*') AND key IN (FROM a) AND key NOT IN (FROM r) GROUP BY ALL""")
def forwardable_params(spark, t):
    """Keys made of the words of turns; which are allowed and which reserved goes by their length."""
    word = F.col("w")
    made = F.when(F.length(word) % 3 == 0, F.concat(F.lit("APP_"), F.upper(word))).when(F.length(word) % 3 == 1, F.upper(word)).otherwise(F.concat(F.lit("app_"), word))
    params = t(_C).select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select("conv_id", "turn", made.alias("key"))
    allowed, reserved = (params.where(F.length("key") % n == 0).select("key").distinct() for n in (2, 5))
    return J.forwardable(params, allowed, reserved).groupBy("conv_id", "turn", "key").agg(F.count("*").alias("n"))


@query(r"""
WITH p AS (SELECT DISTINCT '/sandbox' || regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS p FROM pages WHERE url IS NOT NULL UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) FROM pages WHERE url IS NOT NULL)
SELECT p AS path, CASE WHEN p = '/sandbox/fr' OR starts_with(p, '/sandbox/fr/') THEN '/host/jobs' || p[12:] WHEN p = '/sandbox' OR starts_with(p, '/sandbox/') THEN '/host' || p[9:] WHEN p = '/de' OR starts_with(p, '/de/') THEN '/mnt' || p[4:] ELSE p END AS host FROM p""")
def host_paths(spark, t):
    """The paths of URLs, inside a sandbox and outside; the longest known prefix is replaced."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1)
    both = t("pages").where("url is not null").select(F.explode(F.array(path, F.concat(F.lit("/sandbox"), path))).alias("path")).distinct()
    return J.host_path(both, spark.createDataFrame([("/sandbox", "/host"), ("/sandbox/fr", "/host/jobs"), ("/de", "/mnt")], "prefix string, host string"))


@query("""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'calc' WHEN 1 THEN 'impress' WHEN 2 THEN 'draw' WHEN 3 THEN 'writer' WHEN 4 THEN 'calc' ELSE 'writer' END AS application, p_size % 6 = 4 AS two_pass,
CASE p_size % 6 WHEN 4 THEN 'xlsx,calc' ELSE CASE p_size % 6 WHEN 0 THEN 'calc' WHEN 1 THEN 'impress' WHEN 2 THEN 'draw' ELSE 'writer' END END AS steps, least(greatest(p_size * 10, 1), 120) AS qr_timeout FROM part""")
def export_plans(spark, t):
    label = _pick("p_size", ["xlsx", "pptx", "odg", "docx", "csv", "txt"])
    plan = export_plan(label)
    return t("part").select("p_partkey", plan["application"].alias("application"), plan["two_pass"].alias("two_pass"), F.array_join(plan["steps"], ",").alias("steps"), option_clamp((F.col("p_size") * 10).cast("string"), 10, 1, 120).alias("qr_timeout"))


@query("""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, CASE WHEN contains(text, '?') THEN 'qr_scan_error' WHEN contains(text, '!') OR length(text) % 2 = 0 THEN 'ocr_scan_error' ELSE 'ocr_warm_fallback' END AS code FROM conversations)
SELECT conv_id AS doc_id, concat_ws(',', CASE WHEN sum(length(t)) > 4000 THEN 'resolution_clamped' END, CASE WHEN bool_or(contains(t, 'un ')) THEN 'extension_mismatch' END, CASE WHEN count(*) > 6 THEN 'macro_enabled_format' END,
string_agg(code, ',' ORDER BY turn, code), CASE WHEN bool_or(contains(t, 'the ')) THEN 'altchunk_present' END) AS codes FROM c GROUP BY conv_id""")
def warning_union(spark, t):
    """A conversation's warnings: what holds for all of it, what its turns say in their order, and what comes last."""
    text = F.coalesce("text", F.lit(""))
    code = F.when(text.contains("?"), "qr_scan_error").when(text.contains("!") | (F.length(text) % 2 == 0), "ocr_scan_error").otherwise("ocr_warm_fallback")
    code = F.when(F.col("text").isNull(), "ocr_warm_fallback").otherwise(code)
    pages = t(_C).select(F.col("conv_id").alias("doc_id"), "turn", code.alias("code"))
    about = t(_C).groupBy(F.col("conv_id").alias("doc_id")).agg(F.sum(F.length(text)).alias("size"), F.bool_or(text.contains("un ")).alias("un"), F.bool_or(text.contains("the ")).alias("the"), F.count("*").alias("n"))
    flags = [("resolution_clamped", F.col("size") > 4000), ("extension_mismatch", F.col("un")), ("macro_enabled_format", F.col("n") > 6)]
    got = warnings_in_order(pages, about, "doc_id", "turn", flags, [("altchunk_present", F.col("the"))])
    return got.select("doc_id", F.array_join("codes", ",").alias("codes"))


@query("""
SELECT doc_id, md5(text[1:10000]) AS ocr_text, CASE WHEN text = '' THEN 'warning' ELSE text[1:64] END AS code, md5(text[1:2000]) AS message, text[1:500] AS scan_error, text[1:200] AS fallback_error,
CASE WHEN doc_id % 2 = 0 THEN 'secure' ELSE 'hidden' END AS backend FROM documents WHERE text IS NOT NULL""")
def envelope_truncation(spark, t):
    """The five fields that a record cuts, on whole documents, many of them longer than any limit."""
    sec, w = security_block(F.lit("secure"), F.col("doc_id") % 2 == 0), warning(F.col("text"), F.col("text"))
    return t("documents").where("text is not null").select(
        "doc_id", F.md5(cut("ocr_text", F.col("text"))).alias("ocr_text"), w["code"].alias("code"), F.md5(w["message"]).alias("message"), cut("scan_error", F.col("text")).alias("scan_error"),
        cut("fallback_error", F.col("text")).alias("fallback_error"), F.coalesce(sec["backend"], F.lit("hidden")).alias("backend"),
    )


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR) AS h, l_linenumber % 2 = 0 AS trimmed, max(l_discount) > 0.05 AS focused, max(l_quantity) AS w, max(l_tax) AS x, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
p AS (SELECT k, count(*) AS pages, sum(n) AS ms, string_agg('p' || n::VARCHAR || '=page-' || lpad(n::VARCHAR, 3, '0') || '.png' || CASE WHEN trimmed THEN ';p' || n::VARCHAR || '-trimmed=page-' || lpad(n::VARCHAR, 3, '0') || '-trimmed.png' ELSE '' END
 || CASE WHEN focused THEN ';p' || n::VARCHAR || '-focused=page-' || lpad(n::VARCHAR, 3, '0') || '-focused.png' ELSE '' END, ';' ORDER BY n) AS files,
 string_agg(n::VARCHAR || CASE WHEN x > 0.04 THEN '' ELSE ':phash=' || h[1:16] END || ':colorhash=' || h[1:14] || ':sha256=' || h || h, ';' ORDER BY n) AS hashes,
 string_agg(CASE WHEN trimmed THEN '0:blank_page' ELSE (w::BIGINT % 4)::VARCHAR || ':' END || ':' || md5(repeat(h, CASE WHEN part % 20 = 0 THEN part % 400 ELSE 2 END::INT)[1:10000]) || ':' || (32 * part)::VARCHAR, ';' ORDER BY n) AS scans FROM l GROUP BY k),
d AS (SELECT *, o_orderstatus = 'F' AS no, repeat('not let in: ' || o_orderpriority, 200)[1:2000] AS reason, CASE WHEN o_orderpriority LIKE '1%' THEN 'unknown' ELSE lower(o_orderpriority[3:]) END AS label FROM orders)
SELECT o_orderkey AS doc_id, CASE WHEN no THEN 'rejected' ELSE 'ok' END AS status, CASE WHEN no THEN 'unknown' ELSE label END AS detected, CASE WHEN no THEN 'application/octet-stream' ELSE 'application/' || lower(o_orderpriority) END AS content_type,
CASE WHEN no THEN 0 ELSE greatest(0.0, least(1.0, o_totalprice / 200000)) END::DOUBLE AS confidence, CASE WHEN no THEN 'rejected' ELSE label END AS label, CASE WHEN no THEN reason END AS reason,
CASE WHEN no THEN 0 ELSE coalesce(pages, 0) END AS pages, CASE WHEN no THEN 0 ELSE coalesce(ms, 0) END::BIGINT AS total_ms, CASE WHEN NOT no THEN o_custkey END AS page_count_total, CASE WHEN NOT no THEN o_custkey % 3 = 0 END AS truncated,
CASE WHEN no THEN '' ELSE concat_ws(';', files, CASE WHEN o_orderkey % 3 = 0 THEN 'document-pdf=document.pdf' END) END AS artifacts, CASE WHEN no THEN '' ELSE coalesce(hashes, '') END AS hashes, CASE WHEN no THEN '' ELSE coalesce(scans, '') END AS scans,
CASE WHEN no THEN 'rejected=' || reason ELSE repeat(o_orderpriority, 20)[1:64] || '=;warning=' || o_orderpriority END AS warnings, CASE WHEN NOT no THEN o_orderpriority || '"' || chr(10) END AS read_back, CASE WHEN NOT no THEN o_custkey END AS read_count FROM d LEFT JOIN p ON k = o_orderkey""")
def envelopes(spark, t):
    """Orders as documents and lines as pages: files, hashes (some malformed), scanner records, and metadata read back out of the record."""
    n = F.col("l_linenumber")
    h = F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), n.cast("string")))
    # Dealt by document while the rows are narrow: no later step shuffles the pages, which are wide.
    # The partitions grow with the rows, as each row becomes a page of some hundred bytes in the task that holds it.
    dealt = t("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_tax", "l_partkey")
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, dealt.count() // PAGES + 1), "l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_discount", "l_quantity", "l_tax", "l_partkey")])
    part = F.col("l_partkey").cast("int")
    pages = lines.select(
        F.col("l_orderkey").alias("doc_id"), n.alias("page"), n.alias("ms"), T.page_file(n).alias("file"), F.when(n % 2 == 0, T.page_file(n, "trimmed")).alias("trimmed_file"), F.when(F.col("l_discount") > 0.05, T.page_file(n, "focused")).alias("focused_file"),
        F.col("l_quantity").alias("width_mm"), F.col("l_quantity").alias("height_mm"), F.when(F.col("l_tax") > 0.04, "no hash").otherwise(F.substring(h, 1, 16)).alias("phash"), F.substring(h, 1, 14).alias("colorhash"), F.concat(h, h).alias("sha256"),
        F.when(n % 2 == 1, F.array_repeat(F.lit("code"), (F.col("l_quantity").cast("long") % 4).cast("int"))).alias("qr"), F.when(n % 2 == 0, "blank_page").alias("qr_skipped"),
        F.repeat(h, F.when(part % 20 == 0, part % 400).otherwise(2)).alias("ocr_text"), (32 * part).alias("ocr_char_count"), F.lit(None).cast("string").alias("ocr_skipped"),
    )
    priority = F.col("o_orderpriority")
    seen = F.struct(F.when(~F.startswith(priority, F.lit("1")), F.lower(F.substring(priority, 3, 100))).otherwise("").alias("label"), F.concat(F.lit("application/"), F.lower(priority)).alias("mime"), (F.col("o_totalprice") / 200_000).alias("confidence"))
    render = F.struct(F.col("o_custkey").alias("page_count_total"), (F.col("o_custkey") % 3 == 0).alias("truncated"))
    notes = F.struct(F.concat(priority, F.lit('"\n')).alias("priority"))
    first, second = F.struct(F.repeat(priority, F.lit(20)).alias("code")), F.struct(F.lit("").alias("code"), priority.alias("message"))
    whole = F.concat(F.lit('{"input":{"detected":'), F.to_json(seen), F.lit('},"render":'), F.to_json(render), F.lit(',"notes":['), F.to_json(notes), F.lit('],"warnings":['), F.to_json(first), F.lit(",7,"), F.to_json(second), F.lit("]}"))
    no = F.when(F.col("o_orderstatus") == "F", F.repeat(F.concat(F.lit("not let in: "), priority), F.lit(200)))
    docs = t("orders").select(F.col("o_orderkey").alias("doc_id"), no.alias("reject_reason"), (F.col("o_orderkey") % 3 == 0).alias("has_pdf"), F.parse_json(whole).alias("meta"))
    r = envelope(docs, pages)
    record = F.struct(*r.columns)
    children, about = F.col("payload.children"), F.col("payload.metadata")
    scans = F.transform(F.flatten(F.transform(children, lambda p: p["children"])), lambda x: F.concat_ws(":", x["qr_count"].cast("string"), F.coalesce(x["qr_skipped"], F.lit("")), F.md5(x["ocr_text"]), x["ocr_char_count"].cast("string")))
    hashes = F.transform(children, lambda p: F.concat_ws(":", p["index"].cast("string"), F.transform(p["hashes"], lambda x: F.concat(x["algo"], F.lit("="), x["value"]))))

    def joined(c, one, two):
        return F.array_join(F.transform(c, lambda a: F.concat(a[one], F.lit("="), a[two])), ";").alias(c)

    return r.select(
        "doc_id", "status", F.col("detected.label").alias("detected"), "payload.content_type", "detected.confidence", about["label"].alias("label"), about["reason"].alias("reason"), F.size(children).cast("long").alias("pages"), "total_ms",
        about["page_count_total"].alias("page_count_total"), about["truncated"].alias("truncated"), joined("artifacts", "id", "path"), F.array_join(hashes, ";").alias("hashes"), F.array_join(scans, ";").alias("scans"), joined("warnings", "code", "message"),
        F.try_variant_get(details(record), "$.notes[0].priority", "string").alias("read_back"), F.try_variant_get(details(record), "$.render.page_count_total", "long").alias("read_count"),
    )
