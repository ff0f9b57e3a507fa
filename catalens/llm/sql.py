"""SQL counterparts of the registered queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents
), grouped AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM grouped
), levels AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS ratio,
    (sum(source_size) OVER () * 1.0::DOUBLE
      - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, CASE WHEN ratio < common THEN (3 * source_size)::DOUBLE ELSE common * weight END AS target
  FROM (SELECT *, max(level) FILTER (WHERE level <= ratio) OVER () AS common FROM levels)
), drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), grouped AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN grouped ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

_DIGITS = "('0x' || substr(md5({0}), {1}, 7))::BIGINT"
_HOST = r"""nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)', 1), '\.$', ''), '')"""
_PATH = r"""coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"""

URL_FILTERS = f"""
WITH captured AS (
  SELECT page_id, url, {_HOST} AS host, {_PATH} AS path,
    DATE '2024-01-01' + ({_DIGITS.format("'fetch:' || page_id", 1)} % 366)::INTEGER AS fetched_on, count(*) AS captures
  FROM pages GROUP BY ALL
), rules AS (
  SELECT DISTINCT * FROM (
    SELECT 'hosts' AS list_name, 'd:' || host AS rule FROM captured
    UNION ALL SELECT 'paths', 'p:' || host || regexp_replace(path, '/+$', '') FROM captured)
  WHERE rule IS NOT NULL AND (list_name = 'hosts' OR rule LIKE '%/%')
), drawn AS (
  SELECT *, {_DIGITS.format("rule", 1)} AS a, {_DIGITS.format("rule", 8)} AS b, {_DIGITS.format("rule", 15)} AS c FROM rules
), listed AS (
  SELECT *, b % 200 AS added, b % 200 + 20 + c % 60 AS removed FROM drawn
  WHERE a % (CASE WHEN list_name = 'hosts' THEN 3 ELSE 5 END) = 0
), intervals AS (
  SELECT list_name, rule, DATE '2024-01-01' + added::INTEGER AS valid_from,
    CASE WHEN c % 3 > 0 THEN DATE '2024-01-01' + removed::INTEGER END AS valid_to FROM listed
  UNION ALL
  SELECT list_name, rule, DATE '2024-01-01' + (removed + 40)::INTEGER, NULL FROM listed WHERE c % 3 > 0 AND b % 2 = 0
), keyed AS (
  SELECT page_id, url, fetched_on, unnest(
    list_transform(range(1, CASE WHEN regexp_matches(host, '^([0-9]+([.][0-9]+){{3}}|[[].*)$') THEN 2 ELSE len(string_split(host, '.')) + 1 END), lambda i: 'd:' || array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1),
         lambda i: 'p:' || host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:i], '/'))) AS rule
  FROM captured WHERE host IS NOT NULL
), found AS (
  SELECT page_id, url, fetched_on, list_name, rule, valid_from, valid_to
  FROM keyed JOIN intervals USING (rule)
  WHERE valid_from <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to)
), best AS (
  SELECT page_id, url, fetched_on, count(*) AS n_active, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists,
    arg_max({{'rule': rule, 'valid_from': valid_from, 'valid_to': valid_to}}, (length(rule), rule)) AS top
  FROM found GROUP BY ALL
)
SELECT c.page_id, c.url, c.fetched_on::VARCHAR AS fetched_on, c.host, c.captures, coalesce(b.n_active, 0) AS n_active, coalesce(b.lists, '') AS lists,
  b.top.rule AS rule, b.top.valid_from::VARCHAR AS valid_from, b.top.valid_to::VARCHAR AS valid_to, b.top IS NOT NULL AS blocked
FROM captured c LEFT JOIN best b ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.url IS NOT DISTINCT FROM b.url
  AND c.fetched_on IS NOT DISTINCT FROM b.fetched_on
"""

#: Phrases of 2 to 5 words by grouping all n-grams.
COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
 g AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
   FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m)) GROUP BY 1, 2, 3),
 n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY 1),
 c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1 AND f >= 100),
 cut AS (SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
 s AS (SELECT cut.lang, cut.phrase, cut.m, cut.a, cut.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * cut.a * n.n) // (x.f::HUGEINT * y.f) AS score
   FROM cut JOIN g x ON x.lang = cut.lang AND x.phrase = cut.head AND x.m = cut.k JOIN g y ON y.lang = cut.lang AND y.phrase = cut.tail AND y.m = cut.m - cut.k JOIN n ON n.lang = cut.lang),
 one AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
 kept AS (SELECT * FROM one WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = one.lang AND c.m > one.m AND 100 * c.a >= 100 * one.a AND contains(' ' || c.phrase || ' ', ' ' || one.phrase || ' '))),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""
