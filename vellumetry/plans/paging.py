"""Queries over page rows. Lines of documents, turns of conversations and line items stand for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from .registry import query

_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents)"


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, len(l) AS n, len(list_filter(l[1:20], lambda x: length(trim(x, ' ')) < 20)) AS b FROM l)
SELECT doc_id, n::BIGINT AS page_count_total, (least(n, 20) - b)::BIGINT AS page_count_rendered, b::BIGINT AS blank_pages_skipped, n > 20 AS truncated FROM b""")
def paginate_summary(spark, t):
    return P.summary(t("documents"), max_pages=20)


@query(f"SELECT doc_id, page::BIGINT AS page, sha256(line) AS sha256 FROM {_LINES} WHERE page <= 20")
def page_limit_sha(spark, t):
    return P.limited(P.paginate(t("documents")), 20).select("doc_id", F.col("page").cast("long").alias("page"), F.sha2("line", 256).alias("sha256"))


@query(f"SELECT doc_id, page::BIGINT AS page, length(line)::BIGINT AS n FROM {_LINES} WHERE page <= 20 AND length(trim(line, ' ')) >= 20")
def blank_antijoin(spark, t):
    pages = P.limited(P.paginate(t("documents")), 20)
    kept = P.without_blanks(pages, pages.where(P.is_blank_line(F.col("line"))).select("doc_id", "page"))
    return kept.select("doc_id", F.col("page").cast("long").alias("page"), F.length("line").cast("long").alias("n"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, t):
    return t("documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT conv_id, string_agg(text, '|' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def ordered_reassembly(spark, t):
    return P.reassembled(t("conversations"), "conv_id", "turn", "text").select("conv_id", F.array_join("values", "|").alias("text"))


@query("""
SELECT a.conv_id, a.turn, a.role, b.n_chars, b.has_digit FROM conversations a
JOIN (SELECT conv_id, turn, max(length(text))::BIGINT AS n_chars, bool_or(regexp_matches(text, '[0-9]')) AS has_digit FROM conversations GROUP BY 1, 2) b
ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def zip_join(spark, t):
    c = t("conversations")
    facts = c.groupBy("conv_id", "turn").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.bool_or(F.col("text").rlike("[0-9]")).alias("has_digit"))
    at = [F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page")]
    met = P.by_position(c.select(*at, "role"), facts.select(*at, "n_chars"), facts.select(*at, "has_digit"))
    return met.select(F.col("doc_id").alias("conv_id"), (F.col("page") - 1).cast("int").alias("turn"), "role", "n_chars", "has_digit")


_SHEETS = "SELECT conv_id AS doc_id, turn, role || turn::VARCHAR AS name, CASE turn % 3 WHEN 0 THEN 'visible' WHEN 1 THEN 'hidden' ELSE 'visible' END AS state, CASE WHEN turn % 4 = 2 THEN 'macro' ELSE 'worksheet' END AS type FROM conversations"


def _sheets(t):
    c = t("conversations")
    state = F.when(F.col("turn") % 3 == 1, "hidden").otherwise("visible")
    kind = F.when(F.col("turn") % 4 == 2, "macro").otherwise("worksheet")
    sheet = F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("name"), state.alias("state"), kind.alias("type"))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(sheet)).alias("sheets"))


@query(f"""
WITH s AS ({_SHEETS}), v AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS page FROM s WHERE state = 'visible' AND type <> 'macro')
SELECT c.conv_id AS doc_id, (c.turn + 1)::BIGINT AS page, v.name AS sheet_name FROM conversations c LEFT JOIN v ON v.doc_id = c.conv_id AND v.page = c.turn + 1""")
def sheet_align(spark, t):
    pages = t("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("long").alias("page"))
    return P.aligned_sheets(pages, _sheets(t)).select("doc_id", "page", "sheet_name")


@query(f"""
SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE state = 'visible' AND type <> 'macro') AS rendered,
coalesce(string_agg(name, ',' ORDER BY turn) FILTER (WHERE NOT (state = 'visible' AND type <> 'macro')), '') AS others FROM ({_SHEETS}) GROUP BY doc_id""")
def sheet_summary(spark, t):
    shown = F.size(F.filter("sheets", P.visible_sheet)).cast("long")
    return _sheets(t).select("doc_id", F.size("sheets").cast("long").alias("total"), shown.alias("rendered"), F.array_join(P.other_sheets(F.col("sheets")), ",").alias("others"))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def dedupe_largest(spark, t):
    files = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return P.largest_of_each(files, ["l_orderkey", "l_linenumber"], "l_extendedprice", ["l_partkey", "l_suppkey"])


def _page_sizes(t):
    i = t("lineitem")
    return i.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 700).cast("int").alias("width_px"), (F.col("l_quantity") * 650 + F.col("l_linenumber") * 100).cast("int").alias("height_px"),
        (F.col("l_quantity") * 12.5).alias("width_mm"), (F.col("l_partkey") % 4).alias("image_count"),
    )


_SIZES = "(SELECT l_orderkey AS doc_id, l_linenumber AS page, (l_quantity * 700)::INT AS width_px, (l_quantity * 650 + l_linenumber * 100)::INT AS height_px, l_quantity * 12.5 AS width_mm, l_partkey % 4 AS image_count FROM lineitem)"


@query(f"SELECT doc_id, bool_or(width_px > 34000 OR height_px > 32768) AS failed FROM {_SIZES} GROUP BY doc_id")
def dimension_limit(spark, t):
    return P.too_large(_page_sizes(t), 34000, 32768)


@query(f"SELECT doc_id, count(*) FILTER (WHERE image_count > 0) AS image_page_count, sum(image_count)::BIGINT AS total_image_count FROM {_SIZES} GROUP BY doc_id")
def image_totals(spark, t):
    return P.image_totals(_page_sizes(t))


@query("""
SELECT p_partkey AS doc_id, greatest(p_size * 10.0, 1.0) AS width_mm,
least(greatest(p_size * 10.0, 1.0) / 25.4 * 150 * (297.0 / 25.4 * 150), 2e7) * 4 / 1048576 AS peak_mb FROM part""")
def peak_mb(spark, t):
    w = F.greatest(F.col("p_size") * F.lit(10.0), F.lit(1.0))
    return t("part").select(F.col("p_partkey").alias("doc_id"), w.alias("width_mm"), P.peak_mb(w, F.lit(297.0), F.lit(150), 20_000_000).alias("peak_mb"))


@query("""
SELECT p_partkey AS doc_id, CASE WHEN p_size * 1e6 > 2e7 THEN least(greatest(36, floor(150 * sqrt(2e7 / (p_size * 1e6)))::INT), 150) ELSE 150 END::INT AS dpi FROM part""")
def dpi_clamp(spark, t):
    return t("part").select(F.col("p_partkey").alias("doc_id"), P.effective_dpi(150, F.col("p_size") * F.lit(1e6), 20_000_000).alias("dpi"))


@query("""
WITH n AS (SELECT p_partkey AS doc_id, p_size, CASE WHEN p_size < 4 THEN 1 ELSE least(4, 6, p_size) END AS n FROM part WHERE p_size >= 1),
s AS (SELECT doc_id, p_size, n, p_size // n AS e, unnest(range(0, n)) AS shard FROM n)
SELECT doc_id, shard::INT AS shard, (shard * e + 1)::INT AS first, (CASE WHEN shard = n - 1 THEN p_size ELSE (shard + 1) * e END)::INT AS last FROM s""")
def shard_ranges(spark, t):
    return P.shard_ranges(t("part").select(F.col("p_partkey").alias("doc_id"), "p_size"), "p_size", 8, 6)


@query("""
WITH p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_suppkey) AS page, l_quantity * 40 AS w, l_tax * 10000 + 50 AS h FROM lineitem),
d AS (SELECT doc_id, count(*) AS pages, max(least(w / 25.4 * 150 * (h / 25.4 * 150), 2e7) * 4 / 1048576) AS peak_mb FROM p GROUP BY 1), n AS (SELECT *, CASE WHEN pages < 4 THEN 1 ELSE least(4, 6, pages) END AS n FROM d),
s AS (SELECT doc_id, pages, peak_mb, n, pages // n AS e, unnest(range(0, n)) AS shard FROM n),
r AS (SELECT doc_id, peak_mb, shard, shard * e + 1 AS first, CASE WHEN shard = n - 1 THEN pages ELSE (shard + 1) * e END AS last FROM s),
k AS (SELECT r.doc_id, shard, first, last, any_value(peak_mb) AS peak_mb, max(w / 25.4 * 150 * (h / 25.4 * 150)) AS px FROM r JOIN p ON p.doc_id = r.doc_id AND page BETWEEN first AND last GROUP BY ALL)
SELECT doc_id, shard::INT AS shard, first::INT AS first, last::INT AS last, CASE WHEN px > 2e7 THEN least(greatest(36, floor(150 * sqrt(2e7 / px))::INT), 150) ELSE 150 END::INT AS dpi, peak_mb FROM k""")
def shard_dpi(spark, t):
    """Lines as pages: each range of pages has its own resolution, and each document its peak."""
    order = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_suppkey"]
    lines = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), *order, (F.col("l_quantity") * 40).alias("width_mm"), (F.col("l_tax") * 10000 + 50).alias("height_mm"))
    return P.sharded_dpi(lines, order, 150, 20_000_000, 8, 6)


@query(f"""
WITH p AS (SELECT doc_id, page, width_px * 25.4 / width_mm AS eff FROM {_SIZES} WHERE width_mm > 0)
SELECT doc_id, count(*) AS pages, min(round_even(eff, 0))::INT AS lowest FROM p WHERE eff < 0.95 * 1500 GROUP BY doc_id""")
def clamp_warning(spark, t):
    got = P.clamp_warnings(_page_sizes(t), 1500)
    return got.select("doc_id", F.size("pages").cast("long").alias("pages"), F.array_min(F.col("pages")["effective_dpi"]).alias("lowest"))


@query("SELECT p_partkey AS doc_id, round_even((p_size * 7 + 595.276::DOUBLE) / 72 * 25.4::DOUBLE, 2) AS mm FROM part")
def page_mm(spark, t):
    return t("part").select(F.col("p_partkey").alias("doc_id"), P.mm(F.col("p_size") * 7 + F.lit(595.276)).alias("mm"))


@query("""
WITH m AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 64 / 1024.0 WHEN 2 THEN 0.0 ELSE p_size * 1048576.0 / 1073741824 END AS gb FROM part)
SELECT p_partkey, gb, CASE WHEN p_partkey % 5 = 0 AND p_partkey > 0 THEN least(200000000, greatest(1000000, p_partkey * 100000)) ELSE least(1e8, greatest(1e6, floor(CASE WHEN gb > 0 THEN gb ELSE 4 END * 1073741824 / 8 / 4))) END::BIGINT AS max_px, greatest(1, least(8, floor(0.5 * gb * 1024 / 250.0)))::INT AS ops FROM m""")
def page_budgets(spark, t):
    spec = F.when(F.col("p_size") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit("g"))).when(F.col("p_size") % 4 == 1, F.concat((F.col("p_size") * 64).cast("string"), F.lit("M")))
    spec = spec.when(F.col("p_size") % 4 == 2, "lots").otherwise((F.col("p_size") * 1048576).cast("string"))
    m = t("part").select("p_partkey", T.memory_gb(spec).alias("gb"))
    return m.select("p_partkey", "gb", P.max_page_px(F.col("gb"), F.when(F.col("p_partkey") % 5 == 0, (F.col("p_partkey") * 100_000).cast("string")).otherwise("none")).alias("max_px"), P.concurrent_ops(F.col("gb"), F.lit(250.0)).alias("ops"))


@query("""
WITH f AS (SELECT event_id AS file_id, 'u' || user_id || '/f' || event_id || '.' || ['docx', 'exe', 'xls', 'csv', 'html', 'odg', 'ppsx'][user_id % 7 + 1] AS path, ['docx', 'exe', 'xls', 'csv', 'html', 'odg', 'ppsx'][user_id % 7 + 1] AS ext,
 CASE event_type WHEN 'view' THEN 'application/vnd.ms-excel' WHEN 'error' THEN 'image/png' WHEN 'click' THEN 'text/plain' WHEN 'signup' THEN 'application/CDFV2-unknown' END AS mime FROM events)
SELECT file_id, ext, path, r FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY path, file_id) AS r FROM f WHERE ext IN ('docx', 'xls', 'csv', 'ppsx') AND mime <> 'image/png') WHERE r <= 20""")
def corpus_sample(spark, t):
    """The first twenty files of each wanted extension, of those whose media type fits."""
    kind, ext = F.col("event_type"), F.get(F.array(*map(F.lit, ["docx", "exe", "xls", "csv", "html", "odg", "ppsx"])), (F.col("user_id") % 7).cast("int"))
    mime = F.when(kind == "view", "application/vnd.ms-excel").when(kind == "error", "image/png").when(kind == "click", "text/plain").when(kind == "signup", "application/CDFV2-unknown")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/f"), F.col("event_id").cast("string"), F.lit("."), ext)
    files = t("events").select(F.col("event_id").alias("file_id"), path.alias("path"), T.extension_hint(path).alias("ext"), mime.alias("mime"))
    return P.sampled(P.wanted(files), 20).select("file_id", "ext", "path", F.col("r").cast("long").alias("r"))


@query("""
WITH f AS (SELECT page_id AS file_id, url AS path, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1)) AS ext FROM pages)
SELECT file_id, ext, path, r FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY path, file_id) AS r FROM f) WHERE r <= 5""")
def sampler_topn(spark, t):
    files = t("pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("path"), T.extension_hint(F.col("url")).alias("ext"))
    return P.sampled(files, 5).select("file_id", "ext", "path", F.col("r").cast("long").alias("r"))


@query("""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, turn FROM conversations),
f AS (SELECT doc_id, 'p' || page::VARCHAR AS artifact, 'page-' || lpad(page::VARCHAR, 3, '0') || '.png' AS file FROM p
UNION ALL SELECT doc_id, 'p' || page::VARCHAR || '-trimmed', 'page-' || lpad(page::VARCHAR, 3, '0') || '-trimmed.png' FROM p WHERE turn % 2 = 0
UNION ALL SELECT doc_id, 'p' || page::VARCHAR || '-focused', 'page-' || lpad(page::VARCHAR, 3, '0') || '-focused.png' FROM p WHERE turn % 3 = 0)
SELECT doc_id, artifact, file, try_cast(nullif(regexp_extract(file, '-([0-9]+)\\.png$', 1), '') AS INT) AS idx FROM f""")
def artifacts(spark, t):
    page = (F.col("turn") + 1).cast("int")
    p = t("conversations").select(F.col("conv_id").alias("doc_id"), page.alias("page"), T.page_file(page).alias("file"), F.when(F.col("turn") % 2 == 0, T.page_file(page, "trimmed")).alias("trimmed_file"), F.when(F.col("turn") % 3 == 0, T.page_file(page, "focused")).alias("focused_file"))
    return P.artifacts(p).withColumn("idx", T.page_index(F.col("file")))


@query("""
SELECT conv_id AS doc_id, turn, CASE WHEN turn % 3 = 0 THEN 'focused' WHEN turn % 2 = 0 THEN 'trimmed' ELSE 'original' END AS image FROM conversations""")
def scan_image(spark, t):
    image = P.best_image(F.lit("original"), F.when(F.col("turn") % 2 == 0, "trimmed"), F.when(F.col("turn") % 3 == 0, "focused"))
    return t("conversations").select(F.col("conv_id").alias("doc_id"), "turn", image.alias("image"))


@query("""
SELECT p_partkey, regexp_matches(p_type || CASE p_size % 5 WHEN 0 THEN ' Do' WHEN 1 THEN ' f* q' WHEN 2 THEN ' BT ET' WHEN 3 THEN ' fx' ELSE ' S' END, '(^|\\s)(Do|BI|f|F|S|B|b|f\\*|B\\*|b\\*)($|\\s)') AS graphics FROM part""")
def non_text_ops(spark, t):
    op = F.get(F.array(*[F.lit(x) for x in (" Do", " f* q", " BT ET", " fx", " S")]), F.col("p_size") % 5)
    return t("part").select("p_partkey", T.non_text_ops(F.concat("p_type", op)).alias("graphics"))
