"""Queries of type detection, markup rules, validators and signatures, on stand-in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import lookups as L
from ..functions import text as T
from ..operators import containers as C
from ..operators import detect as D
from ..operators import similarity as S
from .registry import query


def _case(key: str, table: dict, other: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


_CLF = ["docx", "zip", "unknown", "doc", "python", "markdown", "xml", "pdf", "xlsx"]
_EXT = ["docx", "pptm", "txt", "ods", "exe", "csv", "fodt", "html", "foo", "xlsb"]
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_FACTS = f"""(SELECT doc_id, length(text) AS length, ({_LIST(_CLF)})[(length(text) % 9)::INT + 1] AS clf, ({_LIST(_EXT)})[(doc_id % 10)::INT + 1] AS ext,
CASE WHEN contains(text, 'au') THEN 'text/x-code' ELSE 'application/octet-stream' END AS mime, length(text) % 7 <> 0 AS is_zip, doc_id % 3 <> 0 AS sane, length(text) - length(replace(text, 'e', '')) AS entities,
starts_with(text, 'I') AS mht, contains(text, 'AKIA') AS rtf, (doc_id % 150) / 100.0 - 0.1 AS score, contains(text, 'a') AS vba, contains(text, 'x') AS content, contains(text, 'z') AS hollow FROM documents)"""


def _facts(t):
    """Stand-ins for what a classifier and the container operators say of a file, read off the document."""
    d, n = F.col("doc_id"), F.length("text")

    def pick(xs, k):
        return F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))

    def has(word):
        return F.contains("text", F.lit(word))

    streams = F.array_compact(F.array(F.when(has("a"), "VBA/dir"), F.when(has("x"), "WordDocument")))
    entry = F.struct(F.lit("word/document.xml").alias("name"), F.when(has("z"), 0).otherwise(9).cast("long").alias("size"))
    return t("documents").select(
        "doc_id", F.concat(F.lit("/in/f"), d.cast("string"), F.lit("."), F.upper(pick(_EXT, d))).alias("path"), n.alias("length"), pick(_CLF, n).alias("clf_label"), ((d % 150) / 100.0 - 0.1).alias("clf_score"),
        F.when(has("au"), "text/x-code").otherwise("application/octet-stream").alias("clf_mime"), F.lit(None).cast("string").alias("libmagic_mime"), (n % 7 != 0).alias("is_zip"), (d % 3 != 0).alias("package_ok"),
        (n - F.length(F.replace("text", F.lit("e"), F.lit("")))).alias("entity_count"), F.startswith("text", F.lit("I")).alias("is_mht"), F.lit(None).cast("string").alias("odf_marker"), F.array().cast("array<string>").alias("zip_dirs"), has("AKIA").alias("is_rtf"),
        streams.alias("streams"), F.array(entry).alias("entries"),
    )


#: The cascade as the reference's rules state it: each way in turn, with its own gate.
_DETECTED = f"""(WITH a AS (SELECT *, CASE WHEN mht AND length > 0 THEN 'mht' ELSE clf END AS l1, {_case("ext", L.EXTENSIONS)} AS allowed FROM {_FACTS}),
b AS (SELECT *, CASE WHEN {_case("l1", L.LABELS)} IS NULL AND rtf THEN 'rtf' ELSE l1 END AS l2 FROM a),
c AS (SELECT *, {_case("l2", L.LABELS)} AS known, CASE WHEN l1 IN ('doc', 'xls', 'ppt') AND vba AND NOT content THEN 'ole_macro_only_payload' WHEN l1 IN ('docx', 'xlsx', 'pptx') AND hollow THEN 'ooxml_empty_core_document' ELSE '' END AS structural FROM b),
supported AS (SELECT doc_id, known AS label, 'magika' AS source, greatest(0.0, least(1.0, score))::DOUBLE AS confidence, ext = known OR coalesce(allowed = known, false) AS agreed, structural AS warnings,
 CASE WHEN l2 IN ('docx', 'xlsx', 'pptx') AND NOT sane THEN 'ooxml_structural_check_failed' END AS why FROM c WHERE known IS NOT NULL),
generic AS (SELECT doc_id, allowed AS label, 'extension' AS source, 0.0::DOUBLE AS confidence, true AS agreed, 'magika_labeled_as_' || l2 AS warnings,
 CASE WHEN allowed IS NULL OR (l2 = 'zip' AND NOT sane) OR (l2 = 'xml' AND entities > 64) THEN 'magika_unknown_extension_mismatch' END AS why FROM c WHERE known IS NULL AND l2 IN ('zip', 'xml')),
opaque AS (SELECT doc_id, allowed AS label, 'extension' AS source, 0.0::DOUBLE AS confidence, true AS agreed, 'magika_unrecognized_content' AS warnings,
 CASE WHEN allowed IS NULL THEN 'magika_unknown_extension_mismatch' WHEN allowed IN ('docx', 'xlsx', 'pptx') AND is_zip AND NOT sane THEN 'ooxml_structural_check_failed' END AS why FROM c WHERE known IS NULL AND l2 = 'unknown'),
plain AS (SELECT doc_id, 'txt' AS label, 'magika' AS source, greatest(0.0, least(1.0, score))::DOUBLE AS confidence, ext = 'txt' AS agreed, 'rendered_as_text_from_' || l2 AS warnings,
 CASE WHEN NOT starts_with(mime, 'text/') THEN 'unsupported_type' END AS why FROM c WHERE known IS NULL AND l2 NOT IN ('zip', 'xml', 'unknown')),
every AS (SELECT * FROM supported UNION ALL SELECT * FROM generic UNION ALL SELECT * FROM opaque UNION ALL SELECT * FROM plain)
SELECT c.doc_id, c.ext, CASE WHEN c.length > 20000 THEN 'input_too_large' ELSE why END AS reject_reason, label, source, confidence, agreed, warnings FROM c JOIN every USING (doc_id))"""


@query(f"""
SELECT doc_id, ext, reject_reason, CASE WHEN reject_reason IS NULL THEN label END AS label, CASE WHEN reject_reason IS NULL THEN {_case("label", L.MIME)} END AS mime, CASE WHEN reject_reason IS NULL THEN source END AS source,
CASE WHEN reject_reason IS NULL THEN agreed END AS agreed, CASE WHEN reject_reason IS NULL THEN confidence END AS confidence, CASE WHEN reject_reason IS NULL THEN warnings END AS warnings FROM {_DETECTED}""")
def detect_cascade(spark, t):
    return D.detect(_facts(t), 20000).select("doc_id", "ext", "label", "mime", "reject_reason", "source", "agreed", "confidence", F.array_join("warnings", ",").alias("warnings"))


@query(f"SELECT reject_reason AS reason, count(*) AS n FROM {_DETECTED} WHERE reject_reason IS NOT NULL GROUP BY 1")
def rejections_by_reason(spark, t):
    return D.detect(_facts(t), 20000).where("reject_reason is not null").groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
SELECT doc_id, ext, {_case("ext", L.EXTENSIONS)} AS label, {_case(_case("ext", L.EXTENSIONS), L.MIME)} AS mime, ext IN ({", ".join(repr(x) for x in L.MACRO)}) AS macro FROM {_FACTS}""")
def ext_hint_lookup(spark, t):
    f = _facts(t).select("doc_id", T.extension_hint(F.col("path")).alias("ext"))
    return f.join(F.broadcast(L.extension_table(spark)), "ext", "left").select("doc_id", "ext", "label", "mime", L.is_macro_extension(F.col("ext")).alias("macro"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+')[1:2] AS w FROM documents), m AS (SELECT doc_id, CASE length(w[1]) % 4 WHEN 0 THEN 'text/' || w[2] WHEN 1 THEN 'application/' || ['json', 'pdf', 'xml', 'x-sh', w[2]][length(w[2]) % 5 + 1] WHEN 2 THEN 'context/' || w[2] ELSE 'image/' || w[2] END AS mime FROM w WHERE len(w) = 2)
SELECT doc_id, mime, starts_with(mime, 'text/') OR mime IN ('application/json', 'application/xml', 'application/x-sh') AS is_text FROM m""")
def text_mime(spark, t):
    """Media types made of the first two words of documents."""
    one, two = (F.regexp_extract("text", f"^(?:[^A-Za-z]*[A-Za-z]+[^A-Za-z]+){{{i}}}[^A-Za-z]*([A-Za-z]+)", 1) for i in (0, 1))
    kind = F.length(one) % 4
    sub = F.get(F.array(F.lit("json"), F.lit("pdf"), F.lit("xml"), F.lit("x-sh"), two), F.length(two) % 5)
    mime = F.when(kind == 0, F.concat(F.lit("text/"), two)).when(kind == 1, F.concat(F.lit("application/"), sub)).when(kind == 2, F.concat(F.lit("context/"), two)).otherwise(F.concat(F.lit("image/"), two))
    return t("documents").where((one != "") & (two != "")).select("doc_id", mime.alias("mime"), L.is_text_mime(mime).alias("is_text"))


@query("""
WITH x AS (SELECT page_id, repeat('<!ENTITY e "x">', (page_id % 130)::INT) || html AS x FROM pages)
SELECT page_id, (length(x) - length(replace(x, '<!ENTITY', ''))) // 8 <= 64 AS entity_ok, NOT regexp_matches(x, '(?i)<!DOCTYPE|<!ENTITY') AS safe FROM x""")
def entity_gate(spark, t):
    x = F.concat(F.expr("repeat('<!ENTITY e \"x\">', cast(page_id % 130 as int))"), "html")
    return t("pages").select("page_id", D.entity_gate(x).alias("entity_ok"), D.safe_xml(x).alias("safe"))


@query(r"""
WITH c AS (SELECT page_id, 'MiMe' || CASE WHEN contains(url, '?') THEN regexp_extract(url, '^[a-z]+://([^/]*)', 1) ELSE regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) END || 'Version' || replace(html, '<article', 'MULTIPART') AS x, CASE WHEN contains(url, 'https') THEN '{\rt' ELSE '{\tr' END || html AS r FROM pages WHERE html IS NOT NULL)
SELECT page_id, position('version' IN lower(x)) - 1 < 20 AND contains(x, 'MULTIPART') AND strlen(x[1:position('MULTIPART' IN x) - 1]) + 9 <= 8192 AS mht, starts_with(r, '{\rt') AS rtf FROM c""")
def mht_sniff(spark, t):
    """Pages behind a head whose words stand as far apart as the host, or the path, of their URL is long."""
    url = F.col("url")
    between = F.when(url.contains("?"), F.regexp_extract(url, "^[a-z]+://([^/]*)", 1)).otherwise(F.regexp_extract(url, "^[a-z]+://[^/]*(/[^?#]*)", 1))
    x = F.concat(F.lit("MiMe"), between, F.lit("Version"), F.replace("html", F.lit("<article"), F.lit("MULTIPART")))
    r = F.concat(F.when(url.contains("https"), "{\\rt").otherwise("{\\tr"), "html")
    return t("pages").where("html is not null").select("page_id", D.mht_sniff(x.cast("binary")).alias("mht"), D.rtf_magic(r.cast("binary")).alias("rtf"))


@query("""SELECT page_id AS doc_id, regexp_extract(html, '<style>([a-z]+)\\{', 1) AS selector, regexp_extract(html, '<style>[a-z]+\\{([a-z]+):', 1) AS prop, regexp_extract(html, '<style>[a-z]+\\{[a-z]+:([^}]*)\\}', 1) AS value FROM pages""")
def css_rules(spark, t):
    return C.css_rules(t("pages").select(F.col("page_id").alias("doc_id"), "html")).drop("at")


@query("""
WITH r AS (SELECT page_id, regexp_extract_all(html, '<a href="(/[A-Za-z0-9]+)"', 1) AS raw FROM pages), i AS (SELECT page_id, unnest(raw) AS link, unnest(range(len(raw))) AS i FROM r), d AS (SELECT page_id, link, min(i) AS i FROM i GROUP BY 1, 2),
a AS (SELECT page_id, link AS key, i, 0 AS k FROM d UNION ALL SELECT page_id, link[2:], i, 1 FROM d), k AS (SELECT page_id, list(key ORDER BY -length(key), i, k) AS keys FROM a GROUP BY page_id)
SELECT page_id, '<a href="' || list_reduce(list_prepend(link, keys), lambda a, x: replace(a, x, '_' || length(replace(x, '/', ''))::VARCHAR || '_')) || '">' || link || '</a>' AS html FROM d JOIN k USING (page_id)""")
def href_rewrite(spark, t):
    """A page's links, each rewritten by the names of all of the page's own parts; the text of a link stays."""
    links = t("pages").select("page_id", F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="(/[A-Za-z0-9]+)"'), F.lit(1))).alias("links"))
    each = links.select("page_id", "links", F.posexplode("links").alias("at", "link")).withColumn("doc_id", F.col("page_id") * 1000 + F.col("at"))
    parts = each.select("doc_id", F.lit(False).alias("root"), F.posexplode("links").alias("pos", "cloc"))
    parts = parts.withColumn("local_name", F.concat(F.lit("_"), (F.length("cloc") - 1).cast("string"), F.lit("_")))
    html = each.select("doc_id", F.concat(F.lit('<a href="'), "link", F.lit('">'), "link", F.lit("</a>")).alias("html"))
    return C.rewrite_urls(html, parts).select(F.floor(F.col("doc_id") / 1000).alias("page_id"), "html")


_BASE = "regexp_extract(replace(url, chr(92), '/'), '([^/]*)$', 1)"


@query(f"""
WITH b AS (SELECT page_id, {_BASE} AS b FROM pages), c AS (SELECT page_id, regexp_replace(b, '[^A-Za-z0-9._-]', '_', 'g') AS c FROM b)
SELECT page_id, CASE WHEN regexp_replace(c, '^[._]+|[._]+$', '', 'g') = '' THEN 'fallback' ELSE regexp_replace(c, '^[._]+|[._]+$', '', 'g') END AS safe,
CASE WHEN c = '' OR starts_with(c, '.') THEN 'upload.bin' ELSE c[1:255] END AS upload FROM c""")
def safe_filename(spark, t):
    return t("pages").select("page_id", T.safe_filename(F.col("url"), F.lit("fallback")).alias("safe"), T.upload_name(F.col("url")).alias("upload"))


@query("SELECT event_id, regexp_replace('cannot open /srv/in/' || event_type || '.docx: ' || event_id::VARCHAR, '/[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)+', '<path>', 'g') AS message FROM events")
def sanitize_errors(spark, t):
    return t("events").select("event_id", T.sanitize_error(F.concat(F.lit("cannot open /srv/in/"), "event_type", F.lit(".docx: "), F.col("event_id").cast("string"))).alias("message"))


@query("""
WITH s AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 0.75 WHEN 1 THEN p_size * 12.0 WHEN 2 THEN p_size::DOUBLE END AS pt FROM part)
SELECT p_partkey, CASE WHEN pt IS NULL THEN NULL WHEN pt < 9 THEN '1' WHEN pt < 11 THEN '2' WHEN pt < 13.5 THEN '3' WHEN pt < 16.5 THEN '4' WHEN pt < 21 THEN '5' WHEN pt < 30 THEN '6' ELSE '7' END AS size FROM s""")
def font_rungs(spark, t):
    unit = F.get(F.array(*[F.lit(x) for x in ("px", "pc", "pt", "em")]), F.col("p_size") % 4)
    return t("part").select("p_partkey", T.font_rung(F.concat(F.col("p_size").cast("string"), unit)).alias("size"))


@query("""
WITH c AS (SELECT p_partkey, lpad(((p_size * 37) % 1000)::VARCHAR, 3, '0') AS c, p_size FROM part)
SELECT p_partkey, '#' || c[1:1] || c[1:1] || c[2:2] || c[2:2] || c[3:3] || c[3:3] AS color, 'center' AS align, p_size * 20 >= 600 AS bold, 'Arial' AS family FROM c""")
def inherited_props(spark, t):
    c = F.lpad(((F.col("p_size") * 37) % 1000).cast("string"), 3, "0")
    props = T.inherited_props(F.concat(F.lit("color: '#"), c, F.lit("'; Text-Align: center; font-family: \"Arial\", serif; font-weight:"), (F.col("p_size") * 20).cast("string")))
    return t("part").select("p_partkey", props["color"].alias("color"), props["align"].alias("align"), (props["weight"] == "bold").alias("bold"), props["family"].alias("family"))


@query("""
SELECT p_partkey, (p_size - 1) // 26 + 1 AS hi, (p_size - 1) % 26 + 1 AS lo, (((p_size - 1) // 26 + 1) * 26 + (p_size - 1) % 26 + 1)::BIGINT AS n,
((p_size - 1) // 26 + 1) * 26 + (p_size - 1) % 26 + 1 > 30 OR p_size * 10 > 200 AS oversized FROM part""")
def column_letters(spark, t):
    hi, lo = F.floor((F.col("p_size") - 1) / 26).cast("int") + 1, (F.col("p_size") - 1) % 26 + 1
    letters = F.concat(F.char(hi + 64), F.char(lo + 64))
    return t("part").select("p_partkey", hi.alias("hi"), lo.alias("lo"), T.column_number(letters).alias("n"), T.oversized_range(F.concat(F.lit("A1:"), letters, (F.col("p_size") * 10).cast("string"))).alias("oversized"))


@query(r"""
WITH s AS (SELECT conv_id, turn, replace(text[1:14], ' ', '+') AS lang, replace(lower(text[1:30]), ' ', CASE WHEN turn % 2 = 0 THEN ',' ELSE ' | ' END) AS formats, text[1:12] AS format FROM conversations WHERE text IS NOT NULL),
n AS (SELECT *, list_transform(regexp_split_to_array(formats, '[,|]'), lambda x: trim(x)) AS names FROM s),
f AS (SELECT *, regexp_replace(regexp_replace(format, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g') AS split FROM n)
SELECT conv_id, turn, regexp_full_match(lang, '[A-Za-z]{2,}(_[A-Za-z]+)*(\+[A-Za-z]{2,}(_[A-Za-z]+)*)*') AS lang_ok, len(names) BETWEEN 1 AND 32 AND len(list_filter(names, lambda x: NOT (length(x) <= 40 AND regexp_full_match(x, '[a-z0-9]+(_[a-z0-9]+)*')))) = 0 AS formats_ok,
regexp_replace(lower(regexp_replace(split, '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') AS format FROM f""")
def validators(spark, t):
    """The beginnings of turns as recognition languages, as lists of formats and as a format's name."""
    text = F.col("text")
    lang = F.replace(F.substring(text, 1, 14), F.lit(" "), F.lit("+"))
    formats = F.replace(F.lower(F.substring(text, 1, 30)), F.lit(" "), F.when(F.col("turn") % 2 == 0, ",").otherwise(" | "))
    return t("conversations").where("text is not null").select("conv_id", "turn", T.valid_lang(lang).alias("lang_ok"), T.valid_formats(formats).alias("formats_ok"), T.normal_format(F.substring(text, 1, 12)).alias("format"))


_W = "(SELECT vec_id AS id, list_reduce(list_prepend(0::UBIGINT, list_transform(range(1, 65), lambda i: CASE WHEN e[i] > list_median(e) THEN (1::UBIGINT << (64 - i)) ELSE 0::UBIGINT END)), lambda a, b: a + b) AS w FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))"


def _words(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), H.median_bits(F.col("embedding")).alias("w"))


@query(f"SELECT id, printf('%016x', w) AS phash FROM {_W}")
def phash_sig(spark, t):
    return _words(t).select("id", H.hex16(F.col("w")).alias("phash"))


_FLIPPED = f"""(WITH w AS (SELECT id, w FROM {_W}) SELECT id, w FROM w UNION ALL SELECT id + 1000000, xor(w, ((1::UBIGINT << (id % 5)::INT) - 1)) FROM w WHERE id % 3 = 0)"""


def _flipped(t):
    w = _words(t)
    mask = F.expr("shiftleft(1L, cast(id % 5 as int)) - 1")
    return w.union(w.where("id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("w").bitwiseXOR(mask)))


@query(f"WITH f AS (SELECT id, w FROM {_FLIPPED}) SELECT x.id AS a, y.id AS b, bit_count(xor(x.w, y.w))::INT AS distance FROM f x JOIN f y ON x.id < y.id WHERE bit_count(xor(x.w, y.w)) <= 4")
def hamming_pairs_banded(spark, t):
    return S.pairs_within(_flipped(t), 4)


@query(f"""
WITH c AS (SELECT w, count(*) AS n FROM {_FLIPPED} GROUP BY w)
SELECT printf('%016x', least(x.w, y.w)) AS word, printf('%016x', greatest(x.w, y.w)) AS other, CASE WHEN x.w <= y.w THEN x.n ELSE y.n END AS n_word, CASE WHEN x.w <= y.w THEN y.n ELSE x.n END AS n_other, bit_count(xor(x.w, y.w))::INT AS distance
FROM c x JOIN c y ON x.w::HUGEINT + CASE WHEN x.w >= 9223372036854775808 THEN -18446744073709551616::HUGEINT ELSE 0 END <= y.w::HUGEINT + CASE WHEN y.w >= 9223372036854775808 THEN -18446744073709551616::HUGEINT ELSE 0 END WHERE bit_count(xor(x.w, y.w)) <= 4""")
def hamming_classes(spark, t):
    """Words within a radius, with the number of rows of each: as many rows as there are near words."""
    near = S.near_words(_flipped(t), 4)
    a, b = H.hex16(F.col("wa")), H.hex16(F.col("wb"))
    return near.select(F.least(a, b).alias("word"), F.greatest(a, b).alias("other"), F.when(a <= b, F.col("na")).otherwise(F.col("nb")).alias("n_word"), F.when(a <= b, F.col("nb")).otherwise(F.col("na")).alias("n_other"), "distance")


@query(f"SELECT id // 4 AS doc_id, id % 4 AS page, printf('%016x', w) AS phash FROM {_W} WHERE id % 7 <> 3")
def page_originals(spark, t):
    """Pages with crops beside them; only the originals are searched."""
    w = _words(t).select(F.floor(F.col("id") / 4).alias("doc_id"), (F.col("id") % 4).alias("page"), F.when(F.col("id") % 7 == 3, "focused").alias("variant"), "w")
    crops = w.withColumn("variant", F.lit("trimmed")).withColumn("w", F.col("w") - 1)
    return S.original_pages(w.union(crops)).select("doc_id", "page", H.hex16(F.col("w")).alias("phash"))


@query(f"""
WITH f AS (SELECT id, w FROM {_FLIPPED}), d AS (SELECT x.id AS query, y.id AS id, bit_count(xor(x.w, y.w))::INT AS distance FROM f x, f y WHERE x.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r FROM d WHERE distance <= 7) SELECT query, id, distance FROM r WHERE r <= 3""")
def similar_topk(spark, t):
    f = _flipped(t)
    return S.search(f.where("id % 20 = 0"), f, 7, 3)


_NIBBLES = "CASE WHEN length(a) <> 14 OR length(b) <> 14 THEN 2147483647 ELSE list_sum(list_transform(range({0}, {1}), lambda i: abs(('0x' || a[i:i])::INT - ('0x' || b[i:i])::INT))) END::INT"


@query(f"""
WITH h AS (SELECT doc_id, sha256(text)[1:14] AS a, sha256(text)[20:33] AS b FROM documents)
SELECT doc_id, {_NIBBLES.format(1, 15)} AS whole, {_NIBBLES.format(3, 9)} AS faint FROM h""")
def colorhash_dist(spark, t):
    sha = F.sha2("text", 256)
    h = t("documents").select("doc_id", F.substring(sha, 1, 14).alias("a"), F.substring(sha, 20, 14).alias("b"))
    return h.select("doc_id", H.colorhash_distance(F.col("a"), F.col("b")).alias("whole"), H.colorhash_distance(F.col("a"), F.col("b"), 2, 8).alias("faint"))


@query("SELECT doc_id, doc_id % 3 = 0 AND doc_id % 2 = 0 AS blank FROM documents")
def blank_signature(spark, t):
    d = F.col("doc_id")
    return t("documents").select("doc_id", H.blank_signature(F.when(d % 3 == 0, "8000000000000000").otherwise("8000000000000011"), F.when(d % 2 == 0, "0f000000000000").otherwise("00000000f00000")).alias("blank"))


@query("SELECT doc_id, sha256(text)[1:16] AS h16, NULL::VARCHAR AS bad, greatest(0.0, least(1.0, doc_id / 500.0 - 0.5))::DOUBLE AS conf FROM documents")
def hash_validator(spark, t):
    sha = F.sha2("text", 256)
    return t("documents").select("doc_id", T.valid_hash(F.substring(sha, 1, 16), 16).alias("h16"), T.valid_hash(F.concat(F.lit("x"), F.substring(sha, 2, 15)), 16).alias("bad"), T.clamp_confidence(F.col("doc_id") / 500.0 - 0.5).alias("conf"))
