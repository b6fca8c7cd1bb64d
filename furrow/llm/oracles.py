"""SQL the queries are checked against, where SQL can express them."""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, text, source FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT rid, i, a, lead(a) OVER (PARTITION BY rid ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM u),
r AS (SELECT rid, unnest(list(i)) AS i FROM v WHERE c IS NOT NULL GROUP BY rid, a, b, c HAVING count(*) >= 2),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
held AS (SELECT DISTINCT source, text, unnest(ls) AS line FROM w WHERE text IS NOT NULL),
norm AS (SELECT source, text, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM held),
often AS (SELECT source, line FROM norm GROUP BY source, line HAVING count(DISTINCT text) > 20),
gone AS (SELECT x.rid, sum(x.n) AS lost FROM (
           SELECT rid, source, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n,
                  lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
           FROM (SELECT rid, source, unnest(ls) AS l FROM w)) x
         JOIN often o ON x.source IS NOT DISTINCT FROM o.source AND x.line = o.line GROUP BY x.rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        coalesce(gone.lost, 0)::BIGINT AS furniture_words
      FROM w LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - furniture_words >= 0.5 * n_words AS kept,
  furniture_words
FROM f
"""

OP9 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP10 = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
s AS (SELECT page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS r FROM p),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
outcomes AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
             FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good FROM h LEFT JOIN outcomes USING (page_id) GROUP BY host),
parts AS (SELECT *, list_reverse(string_split(host, '.')) AS ls FROM hosts),
named AS (SELECT host, n, good, CASE WHEN len(ls) < 2 THEN ls[1] ELSE ls[2] || '.' || ls[1] END AS two, ls FROM parts),
multi AS (SELECT *, two IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') AS m FROM named),
base AS (SELECT host, n, good, CASE WHEN m AND len(ls) > 2 THEN ls[3] || '.' || two ELSE two END AS domain,
           CASE WHEN m THEN two ELSE ls[1] END AS suffix FROM multi),
suffixes AS (SELECT suffix, (sum(good) + 1.0) / (sum(n) + 2.0) AS prior FROM base GROUP BY suffix),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM base GROUP BY suffix, domain),
domain_spread AS (SELECT suffix, least(greatest((greatest(sum(CASE WHEN n > 0 THEN (good - n * prior) ** 2 / (n * prior * (1 - prior)) - 1 ELSE 0 END), 0) + 1.0)
                    / (sum(greatest(n - 1, 0)) + 10.0), 0.001), 0.9) AS rho FROM domains JOIN suffixes USING (suffix) GROUP BY suffix),
domain_means AS (SELECT domain, ((1 / rho - 1) * prior + good) / (1 / rho - 1 + n) AS prior
                 FROM domains JOIN suffixes USING (suffix) JOIN domain_spread USING (suffix)),
host_spread AS (SELECT domain, least(greatest((greatest(sum(CASE WHEN n > 0 THEN (good - n * prior) ** 2 / (n * prior * (1 - prior)) - 1 ELSE 0 END), 0) + 1.0)
                  / (sum(greatest(n - 1, 0)) + 10.0), 0.001), 0.9) AS rho FROM base JOIN domain_means USING (domain) GROUP BY domain),
posterior AS (SELECT host, ((1 / rho - 1) * prior + good) / (1 / rho - 1 + n) AS mean, 1 / rho - 1 + n AS weight
              FROM base JOIN domain_means USING (domain) JOIN host_spread USING (domain)),
judged AS (SELECT host, mean + 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) < 0.5 AS bad FROM posterior),
ruled AS (SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM h)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bad THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN judged USING (host)
"""

OP11 = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS n FROM t GROUP BY c),
coded AS (SELECT c, n, c - ((c % 5) + 5) % 5 AS base,
            xor(list_reduce([4294967295] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
              lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 9 AS h FROM own),
k AS (SELECT o.*, least(h, coalesce(b.n, 0)) AS head FROM coded o LEFT JOIN own b ON o.base = b.c),
turns AS (SELECT k.c, i AS d, r, x FROM k JOIN t ON t.c = k.base WHERE i <= head
          UNION ALL SELECT k.c, i - h + head, r, x FROM k JOIN t ON t.c = k.c WHERE i > h),
paths AS (SELECT c, d, x, sha256(string_agg(length(r) || ':' || length(x) || ':' || r || x, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM turns
          UNION ALL SELECT c, 0, '', '' FROM k),
rows AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS q, lead(p) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM paths),
nodes AS (SELECT p, min(q) AS q, min(d) AS d, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * min(strlen(x)) AS s,
            sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS e FROM rows GROUP BY p),
kids AS (SELECT q AS p, count(*) AS n_children FROM nodes WHERE q IS NOT NULL GROUP BY q),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (p)),
held AS (SELECT r.p, sum(CASE WHEN n.conv_id = c THEN s ELSE 0 END) OVER w AS s, sum(CASE WHEN n.conv_id = c AND n_children = 0 THEN 1 ELSE 0 END) OVER w AS l
         FROM rows r JOIN whole n USING (p) WINDOW w AS (PARTITION BY c ORDER BY r.d DESC)),
sums AS (SELECT p, sum(s) AS s, sum(l) AS l FROM held GROUP BY p)
SELECT n.conv_id, n.d::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n AS n_convs, n.n_children, sums.l::BIGINT AS n_leaves,
  sums.s::BIGINT AS saved_tokens, n.e AS ends_sha256
FROM whole n JOIN sums USING (p) LEFT JOIN nodes a ON n.q = a.p
"""

ORACLES: dict[str, str] = {"op2_topk": OP2, "op8_line_quality": OP8, "op9_warc": OP9, "op10_url_reputation": OP10, "op11_prefix_trie": OP11}
