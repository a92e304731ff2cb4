"""SQL twins of the queries that SQL can express."""

#: Largest page of a payload of at least 1000 bytes is the response.
OP1_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
k AS (SELECT html, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html
"""

OP5_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### : </turn>') + 1 + length(regexp_replace(role, '\\|###|</turn>|:', 'x\0', 'g'))
    + length(regexp_replace(text, '\\|###|</turn>', 'x\0', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP4_DECONTAMINATION = r"""
WITH d AS (
  SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS w
  FROM documents WHERE doc_id IS NOT NULL),
b AS (
  SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
m(mask, ks) AS (VALUES (0, [0,1,2,4,7,9,10,11]), (1, [0,1,3,4,6,8,10,11]), (2, [0,2,3,5,6,7,9,11])),
dw AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 12),
bw AS (SELECT item_id, w AS bw, unnest(generate_series(0, len(w) - 12)) AS j FROM b WHERE len(w) >= 12),
ds AS (SELECT dw.*, mask, list_transform(ks, lambda k: w[i + k + 1]) AS seed FROM dw, m),
bs AS (SELECT bw.*, mask, list_transform(ks, lambda k: bw[j + k + 1]) AS seed FROM bw, m),
short AS (SELECT item_id, w AS bw, len(w) AS n FROM b WHERE len(w) < 12 AND w[1] <> ''),
sw AS (SELECT doc_id, w, n, unnest(generate_series(0, len(w) - n)) AS i FROM d, (SELECT DISTINCT n FROM short) WHERE len(w) >= n),
hits AS (
  SELECT DISTINCT doc_id, item_id, i - j AS diagonal, w, bw FROM ds JOIN bs USING (mask, seed)
  UNION SELECT doc_id, item_id, i, w, bw FROM sw JOIN short ON sw.n = short.n AND w[i + 1:i + sw.n] = bw),
cells AS (
  SELECT doc_id, item_id, diagonal, w, len(bw) AS n, pos, CASE WHEN w[pos + diagonal + 1] = bw[pos + 1] THEN 2 ELSE -3 END AS s
  FROM (SELECT *, unnest(generate_series(greatest(0, -diagonal), least(len(bw), len(w) - diagonal) - 1)) AS pos FROM hits)),
sums AS (
  SELECT *, sum(s) OVER (PARTITION BY doc_id, item_id, diagonal, w ORDER BY pos) AS upto FROM cells),
best AS (
  SELECT *, upto - least(0, min(upto) OVER (PARTITION BY doc_id, item_id, diagonal, w ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS score FROM sums)
SELECT doc_id, item_id, CAST(max(coalesce(score, s)) AS INTEGER) AS score
FROM best WHERE coalesce(score, s) >= 24 OR coalesce(score, s) * 100 >= n * 2 * 80 GROUP BY doc_id, item_id
"""

#: Leaves with a template of their own, then templates on lines of 20 documents or more.
OP8_LINES = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce(text, chr(0)) AS text, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
t AS (
  SELECT doc_id, text, line_no, list_transform(string_split_regex(trim(raw, e' \t\x0b\f\r'), '[ \t\x0B\f\r]+'),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM l),
line AS (
  SELECT *, list_concat([CAST(len(tokens) AS VARCHAR)], tokens[1:3]) AS leaf FROM t WHERE tokens[1] <> ''),
step AS (
  SELECT 0 AS round, leaf AS grp, tokens, CAST(count(*) AS HUGEINT) AS weight, false AS follows FROM line GROUP BY leaf, tokens
  UNION ALL
  (WITH groups AS (
    SELECT grp, count(*) FILTER (NOT follows) AS kinds, bool_or(follows OR round = 0) AS again FROM step
    GROUP BY grp HAVING count(*) FILTER (NOT follows) > 1 AND sum(weight) FILTER (NOT follows) >= 20),
  rest AS (SELECT s.*, kinds, again FROM step s JOIN groups USING (grp) WHERE NOT follows),
  place AS (SELECT grp, weight, kinds, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM rest WHERE NOT again),
  common AS (
    SELECT grp, place, token, count(*) AS n FROM place GROUP BY grp, place, token
    HAVING sum(weight) >= 20 AND count(*) < any_value(kinds) AND token <> '<*>'),
  best AS (SELECT grp, place AS spot FROM common QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, place) = 1),
  parted AS (
    SELECT round + 1 AS round, tokens, weight, CASE WHEN again THEN list_concat(r.grp, ['rest'])
      ELSE list_concat(r.grp, [CAST(spot AS VARCHAR), coalesce(c.token, ''), CAST(c.token IS NULL AS VARCHAR)]) END AS grp
    FROM rest r LEFT JOIN best b ON r.grp = b.grp
    LEFT JOIN common c ON r.grp = c.grp AND c.place = spot AND c.token = r.tokens[spot]
    WHERE again OR spot IS NOT NULL),
  sizes AS (SELECT grp, count(*) AS kinds FROM parted GROUP BY grp HAVING count(*) > 1 AND sum(weight) >= 20),
  now AS (SELECT p.*, kinds FROM parted p JOIN sizes USING (grp)),
  places AS (SELECT grp, tokens, kinds, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM now),
  counted AS (SELECT grp, place, token, any_value(kinds) AS kinds, count(*) AS n FROM places GROUP BY grp, place, token),
  constant AS (
    SELECT grp, place, token FROM counted
    QUALIFY row_number() OVER (PARTITION BY grp, place ORDER BY n DESC, token DESC) = 1 AND n * 2 >= kinds AND token <> '<*>'),
  agreeing AS (
    SELECT p.grp, p.tokens FROM places p LEFT JOIN constant c ON p.grp = c.grp AND p.place = c.place AND p.token = c.token
    GROUP BY p.grp, p.tokens
    HAVING count(c.place) > 0 AND (count(c.place) + count(*) FILTER (p.token = '<*>')) * 100 >= len(p.tokens) * 70)
  SELECT round, n.grp, n.tokens, weight, a.grp IS NOT NULL AS follows
  FROM now n LEFT JOIN agreeing a ON n.grp = a.grp AND n.tokens = a.tokens)),
following AS (SELECT grp, tokens FROM step WHERE follows),
own AS (
  SELECT doc_id, text, line_no, {'rule': 'leaf', 'grp': f.grp, 'tokens': CASE WHEN f.grp IS NULL THEN line.tokens END} AS template, 20 AS least
  FROM line LEFT JOIN following f ON line.tokens = f.tokens
  UNION ALL
  SELECT doc_id, text, line_no, {'rule': 'long', 'grp': NULL, 'tokens': tokens}, 2 FROM line WHERE len(tokens) >= 10),
recurring AS (
  SELECT template, min((doc_id, line_no)) AS first FROM own GROUP BY template, least HAVING count(DISTINCT doc_id) >= least),
gone AS (
  SELECT DISTINCT doc_id, text, line_no FROM own JOIN recurring ON own.template = recurring.template
  WHERE (doc_id, line_no) <> first),
per AS (SELECT doc_id, text, list(line_no) AS dropped FROM gone GROUP BY doc_id, text)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN dropped IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(
    list_zip(string_split(d.text, chr(10)), range(len(string_split(d.text, chr(10))))), lambda x: NOT list_contains(dropped, x[2])), lambda x: x[1]), chr(10)) END) AS kept_sha256
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id AND d.text = per.text
"""

#: Words that a 13-word window covers which also starts in a smaller document.
OP3_PASSAGES = r"""
WITH d AS (
  SELECT DISTINCT coalesce(doc_id, 9223372036854775807) AS doc, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc, text, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
win AS (SELECT doc, text, i, array_to_string(w[i:i + 12], ' ') AS win FROM n),
least_doc AS (SELECT win, min(doc) AS first FROM win GROUP BY win),
gone AS (
  SELECT DISTINCT doc, text, unnest(generate_series(i, i + 12)) AS spot
  FROM win JOIN least_doc ON win.win = least_doc.win AND first < doc),
per AS (SELECT doc, text, list(spot) AS gone FROM gone GROUP BY doc, text),
r AS (
  SELECT doc_id, coalesce(regexp_extract_all(x.text, '[^\x20\x09-\x0D]+'), []) AS w, coalesce(gone, []) AS gone
  FROM documents x LEFT JOIN per ON coalesce(doc_id, 9223372036854775807) = doc AND x.text = per.text)
SELECT doc_id, len(w) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
    lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), ' '), '')) AS kept_sha256
FROM r
"""

#: Coverage by repeated substrings of 6 words or more is coverage by repeated 6-word windows; a repeat
#: is longer than n words exactly if a window of n + 1 words repeats.
OP7_REPETITION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT *, len(w) AS n_words, greatest(50, (30 * len(w)) // 100) + 1 AS long FROM d),
k AS (SELECT r, w, n_words, unnest([3, 6, long]) AS k, unnest(['rep', 'cov', 'long']) AS what FROM p),
win AS (
  SELECT r, what, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, n_words - k + 1)) AS i FROM k WHERE n_words >= k)),
twice AS (SELECT * FROM win QUALIFY count(*) OVER (PARTITION BY r, what, win) > 1),
spots AS (SELECT DISTINCT r, what, unnest(generate_series(i, i + k - 1)) AS spot FROM twice WHERE what <> 'long'),
per AS (
  SELECT s.r, count(*) FILTER (what = 'rep') AS n_repeat,
    coalesce(sum(length(w[spot])) FILTER (what = 'cov'), 0) AS covered FROM spots s JOIN d ON d.r = s.r GROUP BY s.r),
long AS (SELECT DISTINCT r FROM twice WHERE what = 'long'),
line AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT doc_id, n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words, coalesce(covered, 0) AS covered, long.r IS NOT NULL AS too_long
  FROM p LEFT JOIN per ON p.r = per.r LEFT JOIN long ON p.r = long.r LEFT JOIN line ON p.r = line.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * covered > 50 * word_chars OR too_long) AS kept
FROM c
"""

#: All pairs of distinct sets that share a shingle, then the smallest document reachable.
OP9_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) END AS x FROM d),
c AS (SELECT list_sort(x) AS x, min(doc_id) AS node, len(any_value(x)) AS n FROM s WHERE len(x) > 0 AND doc_id IS NOT NULL GROUP BY list_sort(x)),
t AS (SELECT node, n, unnest(x) AS g FROM c),
l AS (
  SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.g = b.g AND a.node < b.node
    AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(node, root) AS (
  SELECT DISTINCT node, node FROM c UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles,
  CASE WHEN doc_id IS NOT NULL THEN coalesce(root, doc_id) END AS component_id
FROM s LEFT JOIN c ON list_sort(s.x) = c.x LEFT JOIN comp ON comp.node = c.node
"""

_VECTORS = """
sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))"""

#: All scores of all anchors.
OP11_HARD_NEGATIVES = f"""
WITH {_VECTORS},
e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(v, lambda x: floor(256 * x)) AS v
  FROM sound WHERE label IS NOT NULL),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

#: All distances of all queries: what the search gives where its window holds all rows.
OP13_NEAREST_NEIGHBOURS = f"""
WITH {_VECTORS},
e AS (SELECT vec_id, v FROM sound WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    sqrt(list_reduce(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_warc": OP1_WARC,
    "op3_repeated_passages": OP3_PASSAGES,
    "op7_repetition_rules": OP7_REPETITION,
    "op4_decontamination": OP4_DECONTAMINATION,
    "op5_chat_format": OP5_CHAT,
    "op9_near_duplicates": OP9_JACCARD,
    "op8_line_templates": OP8_LINES,
    "op11_hard_negatives": OP11_HARD_NEGATIVES,
    "op13_nearest_neighbours": OP13_NEAREST_NEIGHBOURS,
}
