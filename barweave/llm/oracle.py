"""The same results in DuckDB SQL, where SQL can express the operator."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id
), w(i, word, pattern) AS (
  SELECT i, word, '(?:^|[^A-Za-z0-9])' || word || '(?:[^A-Za-z0-9]|$)' FROM (
    SELECT unnest(range(10)) AS i, unnest(['login','signup','cart','checkout','adserver','doubleclick','casino','viagra','torrent','cgi']) AS word)
), d AS (
  SELECT p.page_id, min_by(w.word, w.i) AS word FROM p JOIN w ON regexp_matches(p.url, w.pattern) GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, m.rule,
  CASE WHEN m.verdict IS NOT NULL THEN m.verdict WHEN d.word IS NOT NULL THEN 'block'
    WHEN regexp_matches(p.host || p.path, '\.(?:zip|gz|exe|iso|rar)$') OR regexp_matches(p.host || p.path, '^[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?::[0-9]+)?/') THEN 'block'
    ELSE 'allow' END AS verdict,
  coalesce(m.rule, d.word, CASE WHEN regexp_matches(p.host || p.path, '\.(?:zip|gz|exe|iso|rar)$') THEN 'archive'
    WHEN regexp_matches(p.host || p.path, '^[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?::[0-9]+)?/') THEN 'address' END) AS matched
FROM p LEFT JOIN m USING (page_id) LEFT JOIN d USING (page_id)
"""

# Borders of units are marked by a private character that no text of the tables holds.
OP6 = rf"""
WITH t AS (
  SELECT doc_id, text, string_split(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(10), chr(10) || chr(63743)),
    '([.!?])([\x09-\x0D\x20])', '\1' || chr(63743) || '\2', 'g'), '([\x{{3002}}\x{{FF01}}\x{{FF1F}}])', '\1' || chr(63743), 'g'), chr(63743)) AS units FROM documents
), u AS (
  SELECT doc_id, unnest(units) AS body, unnest(range(1, len(units) + 1)) AS i FROM t
), l AS (
  SELECT doc_id, i, body, length(body) AS n, coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    trim(regexp_replace(translate(body, '{UPPER}', '{LOWER}'), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS plain FROM u WHERE body != ''
), f AS (
  SELECT *, CASE WHEN plain = '' THEN 0 ELSE length(plain) - length(replace(plain, ' ', '')) + 1 END AS words,
    plain != '' AND row_number() OVER (PARTITION BY plain ORDER BY doc_id, i) > 1 AS again FROM l
), r AS (
  SELECT *, sum((plain != '' AND NOT again)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f
), e AS (
  SELECT *, sum(words) FILTER (again) OVER (PARTITION BY doc_id, run) >= 30 AS enough,
    min(i) FILTER (again) OVER (PARTITION BY doc_id, run) AS low, max(i) FILTER (again) OVER (PARTITION BY doc_id, run) AS high FROM r
), g AS (SELECT *, coalesce(enough AND i BETWEEN low AND high, false) AS gone FROM e),
s AS (
  SELECT doc_id, run, min(i) AS i, min(start)::BIGINT || ':' || max(start + n)::BIGINT AS span FROM g WHERE gone GROUP BY doc_id, run
), k AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(body, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id
), w AS (SELECT doc_id, string_agg(span, ',' ORDER BY i) AS removed FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept, '')) AS text_sha256
FROM t LEFT JOIN k USING (doc_id) LEFT JOIN w USING (doc_id)
"""

OP8 = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS content FROM documents),
g AS (SELECT doc_id, content, max(doc_id) OVER (PARTITION BY content) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g
"""

OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), e AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
k AS (
  SELECT d.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text))::INT
    + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * (d.doc_id > e.first)::INT AS mask
  FROM d JOIN e USING (text) LEFT JOIN labels l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM k GROUP BY part, mask
), f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(prefix, filter, bit, before, step) AS (
  SELECT letter, letter, bit, 0, 1 FROM f
  UNION ALL
  SELECT prefix || letter, letter, f.bit, p.before | p.bit, step + 1 FROM p JOIN f ON ((p.before | p.bit) & f.bit) = 0
), m AS (
  SELECT part, prefix, any_value(filter) AS filter, any_value(step) AS step,
    coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) != 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & before) != 0 AND (mask & bit) != 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) != 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) != 0), 0)::BIGINT AS toxic_lost
  FROM p, c GROUP BY part, prefix
), o AS (SELECT prefix AS filter_order FROM p WHERE step = 5),
s AS (SELECT part, o.filter_order, m.* EXCLUDE (part) FROM o JOIN m ON starts_with(o.filter_order, m.prefix))
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM s
"""

OP12 = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents
), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs
), c AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) r(i, role)
), e AS (
  SELECT *, len(regexp_extract_all(text, '<\\*(?:s>|/s>|<SYS>>|</SYS>>|\|(?:im_start|im_end|endoftext|system|user|assistant|begin_of_text|start_header_id|end_header_id|eot_id)\|>)|\[\\*/?INST\]')) AS n_escaped FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(text) + n_escaped + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE = {"op2_url_filter": OP2, "op6_line_dedup": OP6, "op8_exact_dedup": OP8, "op11_filter_audit": OP11, "op12_lexical_search": OP12, "op13_chat_format": OP13}
