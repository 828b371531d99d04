"""DuckDB SQL for the trie of rebuilt conversations: prefixes as lists, and ancestors and descendants met through their members."""

from .repair_sql import _CRC

SQL = f"""
WITH k AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS key, list(coalesce(role, '') || chr(0) || coalesce(text, '') ORDER BY turn NULLS FIRST, role, text) AS own,
           list(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) ORDER BY turn NULLS FIRST, role, text) AS words FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_CRC} % 4 AS h FROM k),
r AS (SELECT c.conv_id, list_concat(coalesce(d.own, [])[:c.h], c.own[c.h + 1:]) AS s, list_concat(coalesce(d.words, [])[:c.h], c.words[c.h + 1:]) AS w FROM h c LEFT JOIN h d ON d.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, sha256(array_to_string(s[1:d], chr(1))) AS id, CASE WHEN d > 0 THEN sha256(array_to_string(s[1:d - 1], chr(1))) END AS up, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, len(s) = d AS ends
      FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT d, id, min(up) AS up, min(w) AS w, count(*) AS n, min(conv_id) AS conv_id, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends FROM p GROUP BY d, id),
c AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.up = n.id) AS children FROM n),
a AS (SELECT DISTINCT p.d, p.id, q.d AS low_d, q.id AS low FROM p JOIN p q ON p.conv_id = q.conv_id AND q.d >= p.d),
s AS (SELECT a.d, a.id, count_if(c.children = 0) AS leaves, sum((c.n - 1) * c.w) AS saved FROM a JOIN c ON c.d = a.low_d AND c.id = a.low GROUP BY a.d, a.id)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, c.n AS n_convs, CAST(c.children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, c.ends AS ends_sha256
FROM c JOIN s ON s.d = c.d AND s.id = c.id LEFT JOIN c u ON u.d = c.d - 1 AND u.id = c.up
"""
