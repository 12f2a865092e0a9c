"""DuckDB SQL of those pipeline queries that SQL can express.

The others run XXH64, a tokenizer, a trained network or rolling hashes, which
DuckDB has not; tests hold them against brute-force versions instead. Of
operator 4 the base kinds have SQL, by the plain patterns of their definition.
"""

from __future__ import annotations

SUFFIX_DEDUP = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT rid, k, b, length(h) // 2 - 49 - b AS n, substr(h, 2 * b + 1, 698) AS part FROM (SELECT rid, k, h, unnest(range(0, length(h) // 2 - 49, 300)) AS b FROM d)),
w AS (SELECT rid, k, b + i AS i, substr(part, 2 * i + 1, 100) AS s FROM (SELECT rid, k, b, part, unnest(range(0, least(n, 300))) AS i FROM e)),
m AS (SELECT s, min(k) AS least FROM w GROUP BY s),
c AS (SELECT rid, i FROM w JOIN m USING (s) WHERE least < k),
n AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM c),
r AS (SELECT rid, i, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS run FROM n),
s AS (SELECT rid, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY ALL),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY run), 0) AS prior FROM s),
g AS (SELECT rid, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY run) AS head, max(b) AS b, sum(b - a) AS gone, count(*) AS spans FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (rid)"""

MIXING = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(text, ''))) AS key FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT source, s, [5, 2, 1][CAST((i - 1) % 3 + 1 AS INTEGER)] AS w FROM t),
o AS (SELECT *, 3 * s AS cap, row_number() OVER (ORDER BY 3.0 * s / w, source NULLS LAST) AS k FROM w),
c AS (SELECT *, sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM o),
f AS (SELECT min(k) AS k FROM c WHERE CAST(rest_ AS DOUBLE) * w / open_ <= cap),
g AS (SELECT source, s, cap, CASE WHEN c.k < f.k THEN CAST(cap AS DOUBLE) ELSE CAST((SELECT rest_ FROM c c2 WHERE c2.k = f.k) AS DOUBLE) * w / (SELECT open_ FROM c c2 WHERE c2.k = f.k) END AS target FROM c, f),
b AS (SELECT *, least(CAST(floor(target) AS BIGINT), cap) AS budget FROM g),
e AS (SELECT source, s, target, CASE WHEN s > 0 THEN budget // s ELSE 0 END AS whole, CASE WHEN s > 0 THEN budget % s ELSE 0 END AS rest FROM b),
q AS (SELECT source, key, sum(size) AS ks, count(*) AS c, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) AS upto FROM d GROUP BY source, key)
SELECT d.doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(whole * size + CASE WHEN upto + ks <= rest THEN size WHEN upto <= rest THEN (rest - upto) // c ELSE 0 END AS BIGINT) AS taken, d.source
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.key = q.key"""

TOP_K = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score FROM v q JOIN v r ON q.rid <> r.rid AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5"""

_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"regexp_full_match(m, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}')"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: (CAST(d[length(d) - i] AS INTEGER) * (1 + i % 2)) // 10 + (CAST(d[length(d) - i] AS INTEGER) * (1 + i % 2)) % 10)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
}
_MATCHES = " UNION ALL ".join(
    f"""SELECT rid, {n} AS n, '{kind}' AS kind, m, ends - length(m) AS starts, ends FROM (
  SELECT rid, m, i, sum(length(m) + length(gap)) OVER (PARTITION BY rid ORDER BY i) AS ends, regexp_replace(m, '[^0-9]', '', 'g') AS d
  FROM (SELECT rid, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(string_split_regex(t, '{pattern}')) AS gap, unnest(range(len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d WHERE regexp_matches(t, '{pattern}')) WHERE m IS NOT NULL) WHERE {test}"""
    for n, (kind, (pattern, test)) in enumerate(_KINDS.items())
)
PII_BASE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_MATCHES}),
g AS (SELECT rid, string_agg(kind || ':' || CAST(starts AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY n, starts) AS spans,
  {", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in _KINDS)} FROM m GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (rid)"""

WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) || '00' AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, octet_length(payload) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, (5 * i) // 4 + 1, 3) AS BIGINT) >> (12 - (5 * i) % 4 - 5)) & 31) + 1 AS BIGINT), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id IS NULL AND first IS NOT NULL OR page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to
FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": SUFFIX_DEDUP, "op3_mixing": MIXING, "pii_base_kinds": PII_BASE, "op7_top_k": TOP_K, "op10_warc": WARC}
