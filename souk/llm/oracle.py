"""DuckDB SQL of the contract queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS z
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.z, c.z), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

# targets: the level of an uncapped source, one more capped set per step of the recursion
OP6 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(md5(text), 'null') AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, h) AS copy FROM d
), s AS (
  SELECT source, source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), lvl AS (
  SELECT 0 AS step, sum(source_size)::DOUBLE / sum(weight)::DOUBLE AS level FROM s
  UNION ALL
  SELECT step + 1, next FROM (
    SELECT any_value(lvl.step) AS step, any_value(lvl.level) AS level,
           ((SELECT sum(source_size) FROM s)
            - coalesce(sum(3 * source_size) FILTER (3 * source_size < weight * level), 0))::DOUBLE
           / (sum(weight) FILTER (3 * source_size >= weight * level))::DOUBLE AS next
    FROM lvl, s)
  WHERE next > level
), t AS (
  SELECT source, source_size,
         least(weight * (SELECT max(level) FROM lvl), 3.0::DOUBLE * source_size) AS target
  FROM s
), e AS (
  SELECT r.*, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END
           - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS p,
         (('0x' || substr(md5('42' || chr(31) || coalesce(doc_id::VARCHAR, '') || chr(31) || h
           || chr(31) || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, target - source_size * whole AS wanted,
         (u / (1 - u)) / (p / (1 - p)) AS odds
  FROM e
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY floor(odds / (1 + odds) * 4503599627370496.0),
                            doc_id, h, copy ROWS UNBOUNDED PRECEDING) AS until,
         row_number() OVER (PARTITION BY source
                            ORDER BY floor(odds / (1 + odds) * 4503599627370496.0), doc_id, h, copy) AS pos
  FROM k WHERE size > 0 AND p > 0
), stop AS (
  SELECT source, CASE WHEN min(abs(until - wanted)) < min(wanted)
                      THEN arg_min(pos, abs(until - wanted)) ELSE 0 END AS last
  FROM c GROUP BY source
)
SELECT k.doc_id, k.size, k.source_size, k.target,
       (k.size * (k.whole + CASE WHEN c.pos <= stop.last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
LEFT JOIN c ON k.doc_id IS NOT DISTINCT FROM c.doc_id AND k.h = c.h AND k.copy = c.copy
  AND k.source IS NOT DISTINCT FROM c.source
LEFT JOIN stop ON k.source IS NOT DISTINCT FROM stop.source
"""

# the url after its first "://"; rules as rows, the longest that fits wins
OP9 = """
WITH rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), p AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN instr(coalesce(url, ''), '://') > 0
              THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), q AS (
  SELECT page_id, n,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), listed AS (
  SELECT DISTINCT host || rtrim(path, '/') AS canon FROM q
  WHERE regexp_matches(host, '(^|\\.)(spam-farm|cheap-pills)\\.') AND host || rtrim(path, '/') <> ''
), best AS (
  SELECT n, arg_max(rhost || rpath, len(rhost || rpath) * 1000 + len(rhost)) AS rule,
         arg_max(verdict, len(rhost || rpath) * 1000 + len(rhost)) AS verdict
  FROM q JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN host || rtrim(path, '/') IN (SELECT canon FROM listed)
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN best USING (n)
"""

# base32 of the digest: five bits at a time out of the hexadecimal digits
OP8 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS sha FROM pages
), b AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha) AS first,
         list_aggregate(list_transform(str_split(sha, ''),
           lambda h: right('000' || bin(('0x' || h)::INTEGER), 4)), 'string_agg', '') AS bits
  FROM p
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + 16 * substr(bits, (5 * i + 1)::INTEGER, 1)::INTEGER
                  + 8 * substr(bits, (5 * i + 2)::INTEGER, 1)::INTEGER
                  + 4 * substr(bits, (5 * i + 3)::INTEGER, 1)::INTEGER
                  + 2 * substr(bits, (5 * i + 4)::INTEGER, 1)::INTEGER
                  + substr(bits, (5 * i + 5)::INTEGER, 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

# all pairs by cosine; what a vector reaches is walked edge by edge, each vector once
OP10 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id,
         CASE WHEN embedding IS NOT NULL AND len(embedding) > 0
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
               AND len(list_filter(embedding, lambda x: x <> 0)) > 0
              THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e
  FROM embeddings
), link AS (
  SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.n <> b.n AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT n AS a, n AS b FROM v
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), comp AS (
  SELECT reach.a AS n, min(v.vec_id) AS component_id FROM reach JOIN v ON v.n = reach.b GROUP BY reach.a
)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp USING (n) LEFT JOIN (SELECT a AS n, count(*) AS k FROM link GROUP BY a) USING (n)
"""

# nearest entries by all distances; two rounds of floored means, then the last assignment
OP11_ROUND = """
, a{r} AS (
  SELECT n, p, arg_min(k, d * 64 + k) AS k, min(d) AS d
  FROM (SELECT q.n, q.p, b.k, CAST(list_sum(list_transform(list_zip(q.c, b.c),
               lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d
        FROM q JOIN b{r} b USING (p))
  GROUP BY n, p
)"""
OP11_MEANS = """
, s{r} AS (
  SELECT p, k, i, sum(q.c[i])::BIGINT AS s, count(*) AS w
  FROM a{r} JOIN q USING (n, p), (SELECT unnest(range(1, (SELECT max(len(c)) FROM q) + 1)) AS i)
  GROUP BY p, k, i
), m{r} AS (
  SELECT p, k, list((s - ((s % w) + w) % w) // w ORDER BY i) AS c FROM s{r} GROUP BY p, k
), b{next} AS (
  SELECT p, k, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, k)
)"""
OP11 = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, len(embedding) // 16 AS m,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS z
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT n, p, z[p * m + 1:(p + 1) * m] AS c FROM v, (SELECT unnest(range(16)) AS p)
), b0 AS (
  SELECT p, n - 1 AS k, c FROM q WHERE n <= 64
)""" + "".join(OP11_ROUND.format(r=r) + OP11_MEANS.format(r=r, next=r + 1) for r in (0, 1)) \
    + OP11_ROUND.format(r=2) + """
, e AS (
  SELECT n, string_agg(format('{:02x}', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY n
)
SELECT vec_id, code, error,
       sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256
FROM v JOIN e USING (n)
"""

# a CRC table by eight shifts per entry, then byte by byte over each different word
OP12 = """
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents
), g AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
  FROM benchmark
), dw AS (
  SELECT n, w, count(*) AS c FROM (SELECT n, unnest(ws) AS w FROM d) GROUP BY n, w
), tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT)
                                                 ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), vocabulary AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM g)
), bucket AS (
  SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT),
                4294967295::BIGINT) % 10000 AS b
  FROM vocabulary, tab
), source AS (
  SELECT b, sum(c)::BIGINT AS s FROM dw JOIN bucket USING (w) GROUP BY b
), target AS (
  SELECT b, count(*) AS t FROM g JOIN bucket USING (w) GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM source), 0)::DOUBLE + 10000)
                            / ((s::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM target), 0)::DOUBLE + 10000))))::BIGINT AS gain
  FROM source LEFT JOIN target USING (b)
), weights AS (
  SELECT n, sum(c * gain)::BIGINT AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY n
), scores AS (
  SELECT n, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))
                                                      ::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (n)
), places AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place
  FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM places) THEN place END AS rank
FROM scores LEFT JOIN places USING (n)
"""

QUERIES: dict[str, str] = {
    "op1_exact_topk": OP1,
    "op6_mixing": OP6,
    "op8_warc": OP8,
    "op9_url_filter": OP9,
    "op10_embedding_dedup": OP10,
    "op11_vector_codes": OP11,
    "op12_importance_resampling": OP12,
}
