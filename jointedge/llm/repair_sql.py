"""DuckDB SQL for the repair of conversations: the backward vectors and the walk as two recursions over the rows."""

#: crc32 of an ASCII string, bit by bit.
_BYTES = "list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
_STEP = "list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda crc, b: {_STEP}), 4294967295)"

_FAR = 1000000000
_KEPT = {0: "CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 END", 1: "CASE initial WHEN 'u' THEN 2 END", 2: "CASE initial WHEN 'a' THEN 3 END", 3: "CASE initial WHEN 'u' THEN 2 END"}
_FILL = [2, 2, 3, 2]


def _base(state: int) -> str:
    keep = f"coalesce(v[{_KEPT[state]} + 1], {_FAR})"
    return f"least(2 + v[{state + 1}], CASE WHEN fault IN (1, 2) THEN {_FAR} ELSE more + least({keep}, 1 + v[{_FILL[state] + 1}]) END)"


SQL = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT *, {_CRC} % 20 AS damage FROM k),
g AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
             CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy
      FROM f WHERE damage <> 0),
n AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER o AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
      FROM g WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
d AS MATERIALIZED (SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more, lead(initial) OVER (PARTITION BY conv_id ORDER BY n) AS next FROM (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM n)),
s AS (SELECT conv_id, count(*) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
             count_if(next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id),
b AS (SELECT conv_id, rows_ AS n, [0, 10, 5, 0] AS v FROM s
      UNION ALL
      SELECT conv_id, n - 1, [least(b0, 5 + least(b2, 5 + b3)), least(b1, 5 + least(b2, 5 + b3)), least(b2, 5 + b3), least(b3, 5 + b2)] FROM (
        SELECT b.conv_id, b.n, {_base(0)} AS b0, {_base(1)} AS b1, {_base(2)} AS b2, {_base(3)} AS b3 FROM b JOIN d ON d.conv_id IS NOT DISTINCT FROM b.conv_id AND d.n = b.n)),
e AS MATERIALIZED (SELECT d.*, here.v AS here, v.v AS v FROM d JOIN b v ON v.conv_id IS NOT DISTINCT FROM d.conv_id AND v.n = d.n JOIN b here ON here.conv_id IS NOT DISTINCT FROM d.conv_id AND here.n = d.n - 1),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM s
      UNION ALL
      SELECT conv_id, n, CASE WHEN edit = 'D' THEN state WHEN edit = 'K' THEN kept ELSE fill END, audit || added || edit,
             list_concat(lines, CASE WHEN added = 'I' THEN [CASE WHEN state = 3 THEN 'assistant:' ELSE 'user:' END] ELSE [] END,
                         CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN fill = 3 THEN 'assistant:' ELSE 'user:' END || text] END)
      FROM (SELECT *, CASE WHEN gone THEN 'D' WHEN fault NOT IN (1, 2) AND more + v[kept + 1] = here[state + 1] THEN 'K' ELSE 'R' END AS edit FROM (
        SELECT *, CASE WHEN state = 2 THEN 3 ELSE 2 END AS fill, CASE WHEN initial = 's' AND state = 0 THEN 1 WHEN initial = 'u' AND state <> 2 THEN 2 WHEN initial = 'a' AND state = 2 THEN 3 END AS kept FROM (
          SELECT conv_id, n, role, text, initial, fault, more, here, v, audit, lines, gone, CASE WHEN gone OR NOT filled THEN '' ELSE 'I' END AS added, CASE WHEN gone OR NOT filled THEN state WHEN state = 2 THEN 3 ELSE 2 END AS state FROM (
            SELECT e.*, w.state, w.audit, w.lines, 2 + e.v[w.state + 1] = e.here[w.state + 1] AS gone, 5 + e.here[CASE WHEN w.state = 2 THEN 4 ELSE 3 END] = e.here[w.state + 1] AS filled
            FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.n + 1))))),
z AS (SELECT w.conv_id, audit || CASE state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END AS audit, list_concat(lines, CASE state WHEN 2 THEN ['assistant:'] WHEN 1 THEN ['user:', 'assistant:'] ELSE [] END) AS lines
      FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.rows_ = w.n),
t AS (SELECT s.*, z.audit, z.lines, b.v[1] AS cost FROM s JOIN z ON z.conv_id IS NOT DISTINCT FROM s.conv_id JOIN b ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND b.n = 0)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
