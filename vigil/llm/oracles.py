"""DuckDB statements for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

SQL["op1_decontaminate"] = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                             '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                              '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM phrases),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, b.item_id FROM places p JOIN phrases b ON p.phrase = b.phrase AND p.n = b.n),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1),
terms AS (
  SELECT phrase, term, min(off) AS off FROM (
    SELECT phrase, unnest(string_split(phrase, ' ')) AS term, unnest(range(n)) AS off FROM (SELECT DISTINCT phrase, n FROM phrases)) GROUP BY 1, 2),
tokens AS (
  SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d)
  WHERE word IN (SELECT term FROM terms)),
ranked AS (
  SELECT phrase, t.term, row_number() OVER (PARTITION BY phrase ORDER BY c.n, off) AS place, count(*) OVER (PARTITION BY phrase) AS need,
         count(c.n) OVER (PARTITION BY phrase) AS have
  FROM terms t LEFT JOIN (SELECT word, count(*) AS n FROM tokens GROUP BY 1) c ON c.word = t.term),
rare AS (SELECT phrase, term, need FROM ranked WHERE place = 1 AND need = have),
around AS (
  SELECT a.doc_id, r.phrase, a.pos FROM rare r JOIN tokens a ON a.word = r.term JOIN terms t ON t.phrase = r.phrase
  JOIN tokens k ON k.doc_id = a.doc_id AND k.word = t.term AND abs(k.pos - a.pos) <= 20
  GROUP BY 1, 2, 3, r.need HAVING count(DISTINCT t.term) = r.need),
near AS (SELECT doc_id, count(DISTINCT phrase) AS n_near FROM around GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

SQL["op2_minhash_dedup"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 5, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(node, other) AS (SELECT x, y FROM sym UNION SELECT r.node, s.y FROM reach r JOIN sym s ON r.other = s.x),
least_of AS (SELECT node, min(other) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON node = d.doc_id
"""

SQL["op4_url_filter"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '""" + _UPPER + "', '" + _LOWER + r"""'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest,
         regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme
  FROM pages),
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
nodes AS (SELECT *, CASE WHEN contains(url, '://') AND host <> '' THEN host || CASE WHEN rest = '' THEN '/' ELSE rest END END AS node FROM p),
tags AS (
  SELECT url, scheme, host, path, node, unnest(list_concat(
    regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
    regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'))) AS tag
  FROM nodes WHERE node IS NOT NULL),
links AS (
  SELECT *, replace(CASE WHEN lower(tag) LIKE '<link%' THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                         ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS link FROM tags),
targets AS (
  SELECT node AS a, CASE WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') THEN link
              WHEN link LIKE '//%' THEN scheme || ':' || link
              WHEN link LIKE '/%' THEN scheme || '://' || host || link
              ELSE scheme || '://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || link END AS target
  FROM links WHERE link <> ''),
edges AS (
  SELECT a, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), '""" + _UPPER + "', '" + _LOWER + r"""') ||
            coalesce(nullif(regexp_extract(target, '(?s)^.*?://[^/?#]*([^#]*)', 1), ''), '/') AS b
  FROM targets WHERE contains(target, '://')),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (
  SELECT a, b FROM sym
  UNION SELECT r.node, s.b FROM reach r JOIN sym s ON r.other = s.a),
members AS (
  SELECT node, other, regexp_extract(other, '^([^/?]*)', 1) AS host, regexp_extract(other, '(?s)^[^/?]*([^?]*)', 1) AS path FROM reach),
grp AS (
  SELECT node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' ELSE 'allow' END AS verdict
  FROM (SELECT m.node, m.other, arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM members m LEFT JOIN rules r ON (m.host = r.host OR m.host LIKE '%.' || r.host) AND starts_with(m.path, r.path) GROUP BY 1, 2)
  GROUP BY 1),
own AS (
  SELECT n.page_id, n.host, n.path, n.node, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM nodes n LEFT JOIN rules r ON (n.host = r.host OR n.host LIKE '%.' || r.host) AND starts_with(n.path, r.path)
  GROUP BY ALL)
SELECT o.page_id, o.host, o.path, o.rule, coalesce(o.verdict, g.verdict, 'allow') AS verdict
FROM own o LEFT JOIN grp g ON o.node = g.node
"""

SQL["op7_phrase_automata"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM windows JOIN repeated USING (h)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

#: CRC-32 by its table; ``_crc32`` gives the checksum of a list of bytes.
_CRC_TABLE = ("SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: "
              "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, x)) AS t")


def _crc32(data: str) -> str:
    return f"xor(4294967295, list_reduce({data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))"


# Bytes of letters up to U+00FF in UTF-8.
_BYTES = ("flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] "
          "ELSE [195, CAST(unicode(x) - 64 AS BIGINT)] END))")

SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (
  SELECT run, n, CASE WHEN doc_id IS NOT NULL THEN {_crc32(_BYTES.format("concat(CAST(doc_id AS VARCHAR), ':', run)"))} END AS h FROM runs, crc),
damaged AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
holes AS (SELECT word, i, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT h.word AS long_word, w.word AS short_word FROM holes h JOIN words w ON h.d = w.word),
pairs AS (
  SELECT a.word, b.word AS near FROM holes a JOIN holes b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT long_word, short_word FROM shorter UNION SELECT short_word, long_word FROM shorter),
ranked AS (
  SELECT p.word, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS place
  FROM pairs p JOIN words v ON v.word = p.near),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
chain(word, root) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN last USING (word)
"""

SQL["op13_prefix_trie"] = f"""
WITH crc AS ({_CRC_TABLE}),
turns AS (
  SELECT conv_id, md5(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         {_crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (
  SELECT c.conv_id, 0 AS part, pos, digest, words FROM convs c JOIN turns t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE pos > h),
deep AS (
  SELECT conv_id, row_number() OVER w AS depth, words, md5(string_agg(digest, ',') OVER w) AS key
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
prefixes AS (
  SELECT conv_id, 0 AS depth, 0 AS words, '' AS key, NULL AS above FROM convs
  UNION ALL SELECT conv_id, depth, words, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') FROM deep),
lengths AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY 1),
nodes AS (
  SELECT depth, key, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM prefixes GROUP BY 1, 2),
children AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key),
sums AS (
  SELECT p.depth, p.key, sum(n.saved) AS saved_tokens, count(*) FILTER (n.n_children = 0) AS n_leaves
  FROM counted n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1, 2),
ends AS (
  SELECT p.depth, p.key, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends_sha256
  FROM prefixes p JOIN lengths l ON l.conv_id = p.conv_id AND l.depth = p.depth GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted n LEFT JOIN counted u ON u.depth = n.depth - 1 AND u.key = n.above
JOIN sums s ON s.depth = n.depth AND s.key = n.key LEFT JOIN ends e ON e.depth = n.depth AND e.key = n.key
"""
