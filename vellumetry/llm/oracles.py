"""DuckDB SQL for the queries that SQL can express, each written another way than the operator works."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op5_warc_normaliser": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS intact FROM f""",
    "op7_url_filters": """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, r.h || r.p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS k
FROM h JOIN r ON (h.host = r.h OR ends_with(h.host, '.' || r.h)) AND starts_with(h.path, r.p))
SELECT h.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.k = 1""",
    "op8_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY 1),
p AS (SELECT source, ss, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT] AS w, (SELECT sum(ss) FROM s) AS t FROM p),
o AS (SELECT *, sum(2 * ss) OVER (ORDER BY 2.0 * ss / w, place ROWS UNBOUNDED PRECEDING) - 2 * ss AS cb, sum(w) OVER (ORDER BY 2.0 * ss / w, place ROWS UNBOUNDED PRECEDING) - w AS wb, sum(w) OVER () AS wt FROM w),
c AS (SELECT *, (150 * t - 100 * cb)::DOUBLE * w > (200 * ss)::DOUBLE * (wt - wb) AS capped FROM o),
k AS (SELECT coalesce(sum(2 * ss) FILTER (WHERE capped), 0) AS used, coalesce(sum(w) FILTER (WHERE capped), 0) AS wu FROM c),
g AS (SELECT source, place, ss, CASE WHEN capped THEN (2 * ss)::DOUBLE ELSE (150 * t - 100 * used)::DOUBLE * w::DOUBLE / (100 * (wt - wu))::DOUBLE END AS target FROM c, k),
x AS (SELECT row_number() OVER (ORDER BY d.doc_id, d.size) AS uid, d.doc_id, d.size, g.ss AS source_size, g.target, floor(g.target)::BIGINT AS goal, place, md5(d.doc_id::VARCHAR || ':17') AS h FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, (sum(size) OVER (PARTITION BY place ORDER BY ('0x' || h[1:3])::INT % 512, h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM x),
q AS (SELECT DISTINCT place, source_size, goal, (source_size + 511) // 512 AS blocks, goal // source_size * ((source_size + 511) // 512) + (goal % source_size + 511) // 512 AS need FROM y WHERE goal > 0),
e AS (SELECT *, sum(need) OVER (ORDER BY place) - need AS low, sum(need) OVER (ORDER BY place) AS high, sum(need) OVER () AS n FROM q),
i AS (SELECT unnest(range(coalesce((SELECT max(n) + 64 + 8 * floor(sqrt(max(n)))::BIGINT FROM e), 0)::BIGINT)) AS slot),
v AS (SELECT slot, ((slot + 1)::HUGEINT * 2654435769 % 4294967296)::HUGEINT AS point FROM i),
r AS (SELECT slot, place, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS k FROM v JOIN e ON point >= low::HUGEINT * 4294967296 // n AND point < high::HUGEINT * 4294967296 // n),
z AS (SELECT r.slot, r.place, r.k, e.need, e.blocks, e.source_size, e.goal FROM r JOIN e USING (place) WHERE r.k < e.need),
b AS (SELECT slot, place, k % blocks AS block, least(512, source_size - k % blocks * 512, goal - (k // blocks * source_size + k % blocks * 512)) AS words FROM z),
m AS (SELECT uid, min(slot) AS first_slot FROM (SELECT uid, place, start, size, unnest(range(start // 512, (start + size - 1) // 512 + 1)) AS block FROM y WHERE size > 0) l JOIN b USING (place, block) WHERE greatest(start, block * 512) < least(start + size, block * 512 + words) GROUP BY uid)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(start + size, goal % source_size) - start) END::BIGINT AS taken, first_slot FROM y LEFT JOIN m USING (uid)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE b AS (SELECT row_number() OVER () AS uid, doc_id, source, lang, n_chars, text, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i: [ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))), lambda x, y: CASE WHEN y < 256 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) % 2 = 1 AS even FROM documents),
f AS (SELECT uid, doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS found FROM b),
d AS (SELECT uid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS bad FROM f),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
g(source, level, idx, digest, n) AS (SELECT source, 0, idx, leaf, count(*) OVER (PARTITION BY source) FROM e
  UNION ALL SELECT source, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM g WHERE n > 1 GROUP BY source, level, idx // 3, n),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM g WHERE n = 1),
t(level, idx, digest, n) AS (SELECT 0, idx, subroot, (SELECT count(*) FROM s) FROM s
  UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY level, idx // 3, n),
up AS (SELECT e.uid, 0 AS part, g.level, string_agg(g.digest, '' ORDER BY g.idx) FILTER (WHERE g.idx < e.idx // (3 ** g.level)::BIGINT) AS l, string_agg(g.digest, '' ORDER BY g.idx) FILTER (WHERE g.idx > e.idx // (3 ** g.level)::BIGINT) AS r
  FROM e JOIN g ON g.source IS NOT DISTINCT FROM e.source AND g.n > 1 AND g.idx // 3 = e.idx // (3 ** (g.level + 1))::BIGINT GROUP BY ALL
  UNION ALL SELECT e.uid, 1, t.level, string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx < s.idx // (3 ** t.level)::BIGINT), string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx > s.idx // (3 ** t.level)::BIGINT)
  FROM e JOIN s ON s.source IS NOT DISTINCT FROM e.source JOIN t ON t.n > 1 AND t.idx // 3 = s.idx // (3 ** (t.level + 1))::BIGINT GROUP BY ALL),
o AS (SELECT uid, coalesce(l, '') AS l, coalesce(r, '') AS r, row_number() OVER (PARTITION BY uid ORDER BY part, level) AS k FROM up),
w(uid, k, d) AS (SELECT uid, 1, bad FROM d UNION ALL SELECT w.uid, w.k + 1, sha256(o.l || w.d || o.r) FROM w JOIN o ON o.uid = w.uid AND o.k = w.k),
p AS (SELECT uid, max_by(d, k) AS folded FROM w GROUP BY uid),
q AS (SELECT uid, string_agg(l || r, '' ORDER BY k) AS siblings FROM o GROUP BY uid)
SELECT e.doc_id, e.leaf, s.subroot, (SELECT digest FROM t WHERE n = 1) AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, p.folded AS folded_root, p.folded = (SELECT digest FROM t WHERE n = 1) AS verified
FROM e JOIN s ON s.source IS NOT DISTINCT FROM e.source JOIN p ON p.uid = e.uid LEFT JOIN q ON q.uid = e.uid""",
    "op12_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
r AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
}
