"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

ORACLE: dict[str, str] = {}

# Words are runs of 0-9, a-z (after A-Z became a-z) and everything beyond ASCII.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9a-z\x{80}-\x{10FFFF}]+')"""

ORACLE["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# CRC-32 of a decimal number: bytes, then eight shifts a byte.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split({0}::VARCHAR, '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLE["op13_prefix_trie"] = f"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos, k, n
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {_CRC.format("conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT c.conv_id, o.pos, 0 AS own, o.k, o.n FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL SELECT o.conv_id, o.pos, 1, o.k, o.n FROM o JOIN c USING (conv_id) WHERE o.pos >= c.h),
p AS (
  SELECT c.conv_id, coalesce(list(r.k ORDER BY own, pos) FILTER (r.k IS NOT NULL), []) AS ks, coalesce(list(r.n ORDER BY own, pos) FILTER (r.k IS NOT NULL), []) AS ns
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (
  SELECT conv_id, d, array_to_string(ks[1:d], '') AS node, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS size, len(ks) = d AS ends
  FROM (SELECT conv_id, ks, ns, unnest(range(0, len(ks) + 1)) AS d FROM p)),
n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY node, d),
k AS (SELECT node[1:32 * (d - 1)] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
t AS (
  SELECT node[1:32 * a] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM (SELECT node, saved, n_children, unnest(range(0, d + 1)) AS a FROM n LEFT JOIN k USING (node)) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN t USING (node) LEFT JOIN k USING (node) LEFT JOIN n u ON n.d > 0 AND u.node = n.node[1:32 * (n.d - 1)]
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9a-z\x{80}-\x{10FFFF}]+')"""

ORACLE["op11_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
x AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, s),
a AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
f AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM a JOIN x USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM f WHERE score > 0) WHERE rank <= 20
"""
