"""The results of the operators in SQL, where SQL can express them.

Not expressible: the token library (3), the learned models (4, 6), sketches of a hash that SQL
lacks (5), the block rules (7), XXH64 fingerprints and reachability (8). These are tested
against brute force, round trips and held-out accuracy.
"""

from __future__ import annotations

from termlens.llm import decontaminate, lines, mixing, suffixes

_OP1 = rf"""
WITH bare AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '{lines.HOST}', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{lines.SILENT}', chr(10), 'g'),
      '{lines.BREAKS}', chr(10), 'g'), '{lines.TAG}', '', 'g') AS bare
  FROM pages
), p AS (
  SELECT row_number() OVER () AS r, page_id, host, list_filter(list_transform(
    string_split_regex(bare, '[\r\n]'), lambda x: regexp_replace(x, '^[ \t]+|[ \t]+$', '', 'g')), lambda x: x <> '') AS ls
  FROM bare
), l AS (SELECT r, host, unnest(list_distinct(ls)) AS line FROM p),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM l GROUP BY host, line HAVING count(*) >= {lines.LEAST_PAGES}),
b AS (SELECT host, list(line) AS common FROM c JOIN t USING (host) WHERE n > {lines.RATIO} * pages GROUP BY host),
k AS (SELECT p.*, list_filter(ls, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM p LEFT JOIN b USING (host))
SELECT page_id, host, len(ls)::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_dropped,
  array_to_string(kept, chr(10)) AS text
FROM k
"""

_OP2 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {2**63 - 1}) AS doc, hex(encode(coalesce(text, ''))) AS h
  FROM documents
), blocks AS (
  SELECT r, doc, start, substr(h, 2 * start + 1, 2 * (128 + {suffixes.LENGTH} - 1)) AS part
  FROM (SELECT r, doc, h, unnest(range(0, length(h) // 2, 128)) AS start FROM d)
), p AS (
  SELECT r, doc, start + off AS place, md5_number(substr(part, 2 * off + 1, {2 * suffixes.LENGTH})) AS s
  FROM (SELECT r, doc, start, part, unnest(range(0, length(part) // 2 - {suffixes.LENGTH} + 1)) AS off FROM blocks)
), f AS (SELECT s, min(doc) AS first FROM p GROUP BY s),
hit AS (SELECT r, place FROM p JOIN f USING (s) WHERE doc > first),
marked AS (
  SELECT r, place, coalesce(place > lag(place) OVER (PARTITION BY r ORDER BY place) + {suffixes.LENGTH}, true) AS opens FROM hit
), runs AS (SELECT r, place, sum(opens::INT) OVER (PARTITION BY r ORDER BY place) AS run FROM marked),
spans AS (SELECT r, min(place) AS b, max(place) + {suffixes.LENGTH} AS e FROM runs GROUP BY r, run),
edges AS (
  SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS kept_from FROM spans
), kept AS (
  SELECT r, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS tail,
    string_agg(substr(h, 2 * kept_from + 1, 2 * (b - kept_from)), '' ORDER BY b) AS head
  FROM edges JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), {decontaminate.WINDOW}) AS size,
    array_to_string(w[pos : pos + {decontaminate.WINDOW} - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1) + 1)) AS pos FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, pos, array_to_string(w[pos : pos + size - 1], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d CROSS JOIN sizes WHERE len(w) >= size)
), found AS (SELECT r, pos, p.size, item_id FROM places p JOIN windows x ON p.size = x.size AND p.words = x.words),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontaminate.ONE_WORD_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_OP10 = f"""
WITH d AS (
  SELECT *, coalesce('=' || source, 'null') AS s,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(2.0::DOUBLE, 52) AS draw
  FROM documents
), sizes AS (SELECT s, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM d GROUP BY s),
rates AS (
  SELECT s, (SELECT sum(size) FROM sizes) * pow(size, {mixing.POWER}) / (SELECT sum(pow(size, {mixing.POWER})) FROM sizes) / size AS rate
  FROM sizes
), terms AS (SELECT s, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 40))::BIGINT + 1)) AS k FROM rates),
steps AS (
  SELECT s, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS upto FROM terms
), drawn AS (
  SELECT row_number() OVER () AS r, d.* FROM d
), copies AS (
  SELECT r, count(*) AS n FROM drawn JOIN steps USING (s) WHERE upto <= draw GROUP BY r
)
SELECT doc_id, source, text, copy::INTEGER AS copy
FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM drawn JOIN copies USING (r))
"""

_OP11 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM d
), nodes AS (SELECT list_sort(s) AS s, min(r) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
shingles AS (SELECT node, n, unnest(list_transform(s, lambda x: md5_number(x))) AS h FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT node, node AS other FROM nodes
  UNION SELECT reached.node, links.b FROM reached JOIN links ON reached.other = links.a
), members AS (SELECT r, doc_id, node FROM sets JOIN nodes ON list_sort(sets.s) = nodes.s),
least AS (SELECT reached.node, min(doc_id) AS component_id FROM reached JOIN members ON members.node = reached.other GROUP BY reached.node)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE component_id END AS component_id,
  sets.doc_id IS NOT DISTINCT FROM CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE component_id END AS kept
FROM sets LEFT JOIN members USING (r) LEFT JOIN least USING (node)
"""

_OP12 = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
  FROM documents
), numbers AS (
  SELECT doc_id, text, t, len(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn
), cut AS (
  SELECT doc_id, text, n, t, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, n, form, text, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

_OP13 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i::UBIGINT) AS c
    FROM range(0, 256) r(i))
), keyed AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), kinds AS (
  SELECT keyed.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::UBIGINT),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS kind
  FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id
), faults AS (
  SELECT *, role[1:1] AS initial, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN bare[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY c
), turned(state, next, role) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
inserts AS (
  SELECT state, state AS next, 0 AS cost, '' AS letters, []::VARCHAR[] AS lines FROM turned
  UNION ALL SELECT state, next, 5, 'I', [role || ':'] FROM turned
  UNION ALL SELECT a.state, b.next, 10, 'II', [a.role || ':', b.role || ':'] FROM turned a JOIN turned b ON a.next = b.state
), edits AS (
  SELECT c, i, state, state AS next, 2 AS cost, 'D' AS letter, []::VARCHAR[] AS lines FROM faults, turned
  UNION ALL
  SELECT c, i, state, next, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [faults.role || ':' || text]
  FROM faults JOIN turned ON initial = next WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT c, i, '', 's', CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [role || ':' || text]
  FROM faults WHERE initial = 's' AND fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT c, i, state, next, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [turned.role || ':' || text]
  FROM faults, turned WHERE fault NOT IN ('blank', 'duplicate')
), paths AS (
  SELECT c, 0::BIGINT AS i, '' AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS path FROM ids
  UNION ALL
  SELECT c, i, state, min(path) FROM (
    SELECT p.c, e.i, e.next AS state, {'cost': path.cost + s.cost + e.cost, 'audit': path.audit || s.letters || e.letter,
      'lines': list_concat(list_concat(path.lines, s.lines), e.lines)} AS path
    FROM paths p JOIN inserts s ON s.state = p.state JOIN edits e ON e.c = p.c AND e.i = p.i + 1 AND e.state = s.next)
  GROUP BY c, i, state
), best AS (
  SELECT p.c, min({'cost': path.cost + s.cost, 'audit': path.audit || s.letters, 'lines': list_concat(path.lines, s.lines)}) AS path
  FROM paths p LEFT JOIN counts USING (c) JOIN inserts s ON s.state = p.state
  WHERE p.i = coalesce(n, 0) AND s.next IN ('', 'a') GROUP BY p.c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, path.cost::BIGINT AS cost, path.audit AS audit,
  sha256(array_to_string(path.lines, chr(10))) AS repaired_sha256
FROM ids JOIN best USING (c) LEFT JOIN counts USING (c)
"""

ORACLES = {
    "op1_line_dedup": _OP1,
    "op2_suffix_dedup": _OP2,
    "op9_decontaminate": _OP9,
    "op10_mixing": _OP10,
    "op11_minhash": _OP11,
    "op12_middle": _OP12,
    "op13_conversations": _OP13,
}
