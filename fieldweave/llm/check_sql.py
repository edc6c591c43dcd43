"""SQL that gives the results of some queries, for tables of moderate size."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = """
WITH l AS (SELECT doc_id, text, spot, lines[spot] AS line FROM (
       SELECT doc_id, text, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS spot FROM documents)),
long AS (SELECT doc_id, spot, line, row_number() OVER (ORDER BY doc_id, spot) AS place FROM l WHERE length(line) >= 32),
firsts AS (SELECT line, min(place) AS place, length(line) AS size FROM long GROUP BY line),
near AS (SELECT DISTINCT b.line FROM firsts a JOIN (SELECT *, unnest([size - 2, size - 1, size, size + 1, size + 2]) AS other FROM firsts) b
         ON a.size = b.other AND a.place < b.place WHERE levenshtein(a.line, b.line) <= 2),
gone AS (SELECT g.doc_id, g.spot FROM long g JOIN firsts f ON g.line = f.line LEFT JOIN near n ON g.line = n.line WHERE g.place <> f.place OR n.line IS NOT NULL),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.spot) AS n_removed, coalesce(string_agg(CASE WHEN g.spot IS NULL THEN l.line END, chr(10) ORDER BY l.spot), '') AS body
         FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.spot = g.spot GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(body) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

#: Equal lines of any length but none; near ones from 32 characters on.
LINES_ALL = LINES.replace("WHERE length(line) >= 32", "WHERE length(line) >= 1").replace("WHERE levenshtein", "WHERE a.size >= 32 AND b.size >= 32 AND levenshtein")

WINDOWS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS win FROM (
       SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS win FROM (
       SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hits AS (SELECT doc_id, k, dw.m, item FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

GROUPS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * o >= 85 * (p.n + q.n - o)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT x, y FROM sym UNION SELECT reach.a, sym.y FROM reach JOIN sym ON reach.b = sym.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON d.doc_id = r.a
"""


#: Dense ranks of whole-number scores; both sides take logarithms in doubles.
RANKED = r"""
WITH term AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
item AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
hit AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
        FROM item JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit WHERE score > 0) WHERE rank <= 50
"""


def secrets(base: tuple, more: tuple) -> str:
    """Matches of each rule and what stands between them; starts are sums of lengths."""
    size = "length(coalesce({}, ''))"
    parts = []
    for k, rule in enumerate((*base, *more)):
        pattern = rule.pattern.replace("'", "''")
        parts.append(rf"""
SELECT doc_id, row, '{rule.kind}' AS kind, {k} AS k, start, start + length(match) AS stop FROM (
  SELECT doc_id, row, ms[i] AS match, gs[i] AS inner_part,
         CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, row, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, row, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {rule.group}) AS gs, string_split_regex(text, '{pattern}') AS ps FROM d)))
WHERE {size.format("inner_part")} >= {rule.least}""")
    names = ", ".join(f"'{rule.kind}'" for rule in base)
    counts = ", ".join(f"coalesce(count(kind) FILTER (kind = '{rule.kind}'), 0) AS n_{rule.kind}" for rule in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
told AS (SELECT *, kind || ':' || start || ':' || stop AS told FROM s)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(told, ',' ORDER BY start, k) FILTER (kind IN ({names})), '')) AS base_sha256, coalesce(string_agg(told, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN told ON d.row = told.row GROUP BY d.row, d.doc_id
"""


#: A walk over the rows of each conversation that keeps, for each state, the least (cost, audit, lines). No more than two turns are inserted at one place:
#: three would end where one does.
REPAIRED = r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295::BIGINT) % 20 AS code
        FROM conversations, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE code <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM damaged),
r AS (SELECT conv_id, k, turn, role, text, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2
        WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM ordered),
ins(a, b, cost, letters, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
        (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'),
        (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
        (3, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 10, 'II', chr(10) || 'assistant:' || chr(10) || 'user:')),
moves(letter, initial, a, b, cost) AS (VALUES ('D', NULL, 0, 0, 2), ('D', NULL, 1, 1, 2), ('D', NULL, 2, 2, 2), ('D', NULL, 3, 3, 2),
        ('R', NULL, 0, 2, 1), ('R', NULL, 1, 2, 1), ('R', NULL, 2, 3, 1), ('R', NULL, 3, 2, 1),
        ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0)),
walk AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS k, ins.b AS q, {'cost': CAST(ins.cost AS BIGINT), 'audit': CAST(letters AS VARCHAR), 'body': CAST(lines AS VARCHAR)} AS best FROM (SELECT DISTINCT conv_id FROM r) c, ins WHERE ins.a = 0
  UNION ALL
  SELECT walk.conv_id, walk.k + 1, ins.b, min({'cost': best.cost + moves.cost + ins.cost + CASE WHEN fault = 3 AND letter <> 'D' THEN 5 ELSE 0 END, 'audit': best.audit || letter || letters,
         'body': best.body || CASE letter WHEN 'K' THEN chr(10) || role || ':' || text WHEN 'R' THEN chr(10) || CASE moves.b WHEN 3 THEN 'assistant:' ELSE 'user:' END || text ELSE '' END || lines})
  FROM walk JOIN r ON walk.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = walk.k + 1
  JOIN moves ON moves.a = walk.q AND (moves.initial IS NULL OR moves.initial = r.initial) AND (letter = 'D' OR fault NOT IN (1, 2)) JOIN ins ON ins.a = moves.b
  GROUP BY walk.conv_id, walk.k, ins.b),
size AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated FROM r GROUP BY conv_id),
steps AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS two FROM r) WHERE two NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
done AS (SELECT walk.conv_id, min(best) AS best FROM walk JOIN size ON walk.conv_id IS NOT DISTINCT FROM size.conv_id AND walk.k = size.n WHERE q IN (0, 3) GROUP BY walk.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.body[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN size ON c.conv_id IS NOT DISTINCT FROM size.conv_id LEFT JOIN steps ON c.conv_id IS NOT DISTINCT FROM steps.conv_id
LEFT JOIN done ON c.conv_id IS NOT DISTINCT FROM done.conv_id
"""
