"""SQL that checks operators of this package where SQL can say what they do."""

from __future__ import annotations

# crc32 from its table, damage, faults, then the cheapest edits row by row over the four states of the role pattern.
REPAIR = r'''WITH RECURSIVE bits AS (SELECT list(list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
 named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
 kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] ||
   list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8))) % 20 AS kind FROM named, bits),
 damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
   FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
 placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM damaged),
 counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth FROM placed),
 faults AS (SELECT *, ending = '' AS blank, ending <> '' AND nth > 1 AS duplicate, ending <> '' AND nth = 1 AND ending NOT IN ('.', '!', '?') AS truncated,
   coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au'), FALSE) AS illegal FROM counted),
 inserts(st, mid, c, a, said) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']),
   (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])),
 edits(mid, op, initial, nxt, cost, role) AS (VALUES (0, 'D', '', 0, 3, ''), (1, 'D', '', 1, 3, ''), (2, 'D', '', 2, 3, ''), (3, 'D', '', 3, 3, ''),
   (0, 'R', '', 2, 2, 'user'), (1, 'R', '', 2, 2, 'user'), (2, 'R', '', 3, 2, 'assistant'), (3, 'R', '', 2, 2, 'user'),
   (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (3, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, '')),
 best AS (SELECT conv_id, CAST(0 AS BIGINT) AS place, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, place, st, cost, audit, said FROM (
   SELECT b.conv_id, f.place, e.nxt AS st, b.cost + i.c + e.cost + CASE WHEN f.truncated AND e.op <> 'D' THEN 1 ELSE 0 END AS cost, b.audit || i.a || e.op AS audit,
    b.said || i.said || CASE e.op WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.role || ':' || f.text] END AS said
   FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.place = b.place + 1 JOIN inserts i ON i.st = b.st
   JOIN edits e ON e.mid = i.mid AND (e.op = 'D' OR NOT f.blank AND NOT f.duplicate AND (e.op = 'R' OR e.initial = f.initial)))
   QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
 ended AS (SELECT b.conv_id, b.cost + i.c AS cost, b.audit || i.a AS audit, array_to_string(b.said || i.said, chr(10)) AS repaired
  FROM best b JOIN inserts i ON i.st = b.st AND i.mid = CASE WHEN b.st = 0 THEN 0 ELSE 3 END
  WHERE b.place = coalesce((SELECT max(place) FROM faults f WHERE f.conv_id IS NOT DISTINCT FROM b.conv_id), 0)),
 ends AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
 counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM faults GROUP BY 1)
 SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, sha256(repaired) AS repaired_sha256 FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id'''
