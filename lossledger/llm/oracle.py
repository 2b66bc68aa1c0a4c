"""The results of the operators that SQL can express, written for DuckDB."""

SUBSTRINGS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT r, doc_id, p, array_to_string(words[p : p + 49], ' ') AS w
  FROM (SELECT r, doc_id, words, unnest(generate_series(1, len(words) - 49)) AS p FROM docs)
), first AS (
  SELECT w, min(doc_id) AS first FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT r, p + unnest(range(50)) AS p
  FROM windows JOIN first USING (w) WHERE windows.doc_id > first.first
), kept AS (
  SELECT r, count(g.p) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE g.p IS NULL), '') AS kept
  FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs) LEFT JOIN gone g USING (r, p)
  GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(lower_text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT doc_id, SMALL_D AS lower_text FROM documents)
), items AS (
  SELECT item_id, regexp_extract_all(lower_text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT item_id, SMALL_D AS lower_text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL)
), patterns AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[p : p + least(13, len(words)) - 1], ' ') AS w
  FROM (SELECT item_id, words, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) AS p
        FROM items WHERE len(words) > 0)
), found AS (
  SELECT DISTINCT r, p, s.n, item_id
  FROM (SELECT r, n, p, array_to_string(words[p : p + n - 1], ' ') AS w
        FROM (SELECT r, words, n, unnest(generate_series(1, len(words) - n + 1)) AS p
              FROM docs, (SELECT DISTINCT n FROM patterns))) s
  JOIN patterns q ON q.n = s.n AND q.w = s.w
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, p + unnest(range(n)) AS place FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""".replace("SMALL_D", _SMALL.format("coalesce(text, '')"))

JACCARD = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(SMALL_D, '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[p : p + 2], ' ') AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 2))) AS p FROM docs WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other)::BIGINT AS component_id
FROM docs d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id, n
""".replace("SMALL_D", _SMALL.format("coalesce(text, '')"))

PERSPECTIVES = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said, floor(turn / 64.0)::BIGINT AS chunk
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, who AS speaker FROM said WHERE who <> 'system'
), parts AS (
  SELECT s.conv_id, chunk, speaker, turn, who, said, who = speaker AS own,
         CASE WHEN who = 'system' THEN '<|system|>' WHEN who = speaker THEN '<|assistant|>'
              ELSE '<|user:' || who || '|>' END || chr(10) AS head
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), pieces AS (
  SELECT *, head || said || '<|end|>' || chr(10) AS piece FROM parts
), placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, chunk, speaker ORDER BY turn, who, said
                                     ROWS UNBOUNDED PRECEDING) AS until FROM pieces
)
SELECT conv_id, chunk, speaker, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE own)::BIGINT AS n_own,
       string_agg(piece, '' ORDER BY turn, who, said) AS text,
       coalesce(string_agg((until - length(piece) + length(head))::VARCHAR || ':' || (until - 1)::VARCHAR, ','
                           ORDER BY turn, who, said) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, chunk, speaker
"""

URLS = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), judged AS (
  SELECT page_id, rest, SMALL_H AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM judged
), verdicts AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict
  FROM ruled
), texts AS (
  SELECT rest, any_value(verdict) AS verdict, count(*) AS n,
         any_value(verdict) IS NOT NULL AND substr(md5(rest), 1, 1) NOT IN ('0', '1', '2', '3') AS learn
  FROM verdicts GROUP BY rest
), grams AS (
  SELECT rest, verdict, learn, CASE WHEN learn AND verdict = 'allow' THEN n ELSE 0 END AS a,
         CASE WHEN learn AND verdict = 'block' THEN n ELSE 0 END AS b,
         substr(repeat(chr(2), 3) || rest || chr(3), i, 4) AS gram
  FROM (SELECT *, unnest(generate_series(1, length(rest) + 1)) AS i FROM texts)
), n4 AS (SELECT gram, sum(a) AS a, sum(b) AS b FROM grams GROUP BY gram),
n3 AS (SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM n4 GROUP BY 1),
n2 AS (SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM n3 GROUP BY 1),
n1 AS (SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM n2 GROUP BY 1),
c4 AS (SELECT substr(gram, 1, 3) AS gram, sum(a) AS a, sum(b) AS b FROM n4 GROUP BY 1),
c3 AS (SELECT substr(gram, 1, 2) AS gram, sum(a) AS a, sum(b) AS b FROM n3 GROUP BY 1),
c2 AS (SELECT substr(gram, 1, 1) AS gram, sum(a) AS a, sum(b) AS b FROM n2 GROUP BY 1),
c1 AS (SELECT sum(a) AS a, sum(b) AS b FROM n1),
p1 AS (SELECT gram, (n1.a + 2.0::DOUBLE * (1.0::DOUBLE / 256)) / (c1.a + 2.0::DOUBLE) AS pa,
              (n1.b + 2.0::DOUBLE * (1.0::DOUBLE / 256)) / (c1.b + 2.0::DOUBLE) AS pb FROM n1, c1),
p2 AS (SELECT n.gram, (n.a + 2.0::DOUBLE * pa) / (c.a + 2.0::DOUBLE) AS pa, (n.b + 2.0::DOUBLE * pb) / (c.b + 2.0::DOUBLE) AS pb
       FROM n2 n JOIN c2 c ON c.gram = substr(n.gram, 1, 1) JOIN p1 p ON p.gram = substr(n.gram, 2)),
p3 AS (SELECT n.gram, (n.a + 2.0::DOUBLE * pa) / (c.a + 2.0::DOUBLE) AS pa, (n.b + 2.0::DOUBLE * pb) / (c.b + 2.0::DOUBLE) AS pb
       FROM n3 n JOIN c3 c ON c.gram = substr(n.gram, 1, 2) JOIN p2 p ON p.gram = substr(n.gram, 2)),
p4 AS (SELECT n.gram, (n.a + 2.0::DOUBLE * pa) / (c.a + 2.0::DOUBLE) AS pa, (n.b + 2.0::DOUBLE * pb) / (c.b + 2.0::DOUBLE) AS pb
       FROM n4 n JOIN c4 c ON c.gram = substr(n.gram, 1, 3) JOIN p3 p ON p.gram = substr(n.gram, 2)),
scores AS (
  SELECT rest, any_value(verdict) AS verdict, round(avg(ln(pa) - ln(pb)), 6) AS score
  FROM grams JOIN p4 USING (gram) WHERE NOT learn GROUP BY rest
), bins AS (
  SELECT floor(score * 100) AS bin, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS b
  FROM scores WHERE verdict IS NOT NULL GROUP BY 1
), quality AS (
  SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) AS gap, (sum(a) OVER (ORDER BY bin DESC)) / (sum(a) OVER ()) + (coalesce(sum(b) OVER (
    ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(b) OVER ()) AS q,
    sum(a) OVER () AS all_a, sum(b) OVER () AS all_b FROM bins
), threshold AS (
  SELECT coalesce((SELECT (gap + bin) / 2 / 100 FROM quality WHERE all_a > 0 AND all_b > 0 ORDER BY q DESC, bin LIMIT 1), 0) AS t
)
SELECT page_id, host, path, rule,
       coalesce(v.verdict, CASE WHEN s.score >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM verdicts v LEFT JOIN scores s ON s.rest = v.rest, threshold
""".replace("SMALL_H", _SMALL.format("regexp_extract(rest, '^[^/?#]*', 0)"))

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS place FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), filled AS (
  -- sources in the order in which they reach their limit; each gets what is left if all before it are full
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS left_over,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS sharing
  FROM sources WINDOW before AS (ORDER BY most::DOUBLE / weight, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT left_over, sharing FROM filled WHERE most * sharing >= weight * left_over
  ORDER BY most::DOUBLE / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN most * sharing < weight * left_over THEN most::DOUBLE
              ELSE (weight * left_over)::DOUBLE / sharing::DOUBLE END AS target
  FROM (SELECT source, source_size, most, weight FROM sources), level
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(least(target / source_size, 3.0::DOUBLE) * 1099511627776.0::DOUBLE)::BIGINT
                 ELSE 0 END AS expected,
         cast('0x' || left(md5('11:' || coalesce(source, '')), 10) AS BIGINT) AS start
  FROM targets
), summed AS (
  SELECT doc_id, size, source_size, target, start + sum(expected::HUGEINT) OVER (
    PARTITION BY s.source ORDER BY size, place ROWS UNBOUNDED PRECEDING) AS upto, expected
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
), taken AS (
  SELECT *, (upto // 1099511627776 - (upto - expected) // 1099511627776)::BIGINT AS copies FROM summed
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM taken
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(lower_text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, SMALL_D AS lower_text FROM documents)
  ) WHERE len(words) > 0
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), counts AS (
  SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM (
    SELECT lang, k, words[p : p + k - 1] AS phrase
    FROM (SELECT lang, words, k, unnest(generate_series(1, len(words) - k + 1)) AS p FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k)))
  GROUP BY lang, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, cut, (2000000 * c.f::HUGEINT) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM counts WHERE k > 1) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = c.phrase[1 : cut]
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.phrase[cut + 1 : c.k]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, phrase[1 : k - 1] AS phrase, f FROM counts WHERE k > 2
    UNION ALL SELECT lang, phrase[2 : k], f FROM counts WHERE k > 2
    UNION ALL SELECT lang, phrase[1 : 2], f FROM counts WHERE k = 4
    UNION ALL SELECT lang, phrase[2 : 3], f FROM counts WHERE k = 4
    UNION ALL SELECT lang, phrase[3 : 4], f FROM counts WHERE k = 4)
  GROUP BY lang, phrase
), kept AS (
  SELECT w.lang, array_to_string(w.phrase, ' ') AS phrase, a, l, r, score
  FROM lowest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase
  WHERE g.f IS NULL OR 100 * g.f < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000
""".replace("SMALL_D", _SMALL.format("coalesce(text, '')"))

TRIE = """
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, (4294967295 - list_reduce(
    [4294967295]::BIGINT[] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
    lambda crc, d: list_reduce([xor(crc, d)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), whole AS (
  SELECT c.conv_id, 0 AS part, t.place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= h
  UNION ALL SELECT c.conv_id, 1, t.place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > h
), steps AS (
  SELECT conv_id, text, row_number() OVER w AS depth,
         string_agg(md5(md5(role) || md5(text)), '') OVER (w ROWS UNBOUNDED PRECEDING) AS node
  FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
), paths AS (
  SELECT conv_id, depth, node, text FROM steps UNION ALL SELECT conv_id, 0, '', '' FROM convs
), lasts AS (
  SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), nodes AS (
  SELECT node, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(length(text)) AS len,
         coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE l.depth = p.depth), '') AS ends
  FROM paths p JOIN lasts l USING (conv_id) GROUP BY node
), linked AS (
  SELECT n.*, parent.conv_id AS parent_conv_id, parent.node AS parent
  FROM nodes n LEFT JOIN nodes parent ON n.depth > 0 AND parent.depth = n.depth - 1
    AND parent.node = left(n.node, (32 * (n.depth - 1))::BIGINT)
), children AS (
  SELECT parent, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent
), shaped AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.parent = l.node
), below AS (
  SELECT DISTINCT u.node AS above, d.node FROM paths u JOIN paths d ON u.conv_id = d.conv_id AND d.depth >= u.depth
), sums AS (
  SELECT above, count(*) FILTER (WHERE s.n_children = 0) AS n_leaves, sum((n_convs - 1) * len)::BIGINT AS saved_tokens
  FROM below b JOIN shaped s ON s.node = b.node GROUP BY above
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM shaped JOIN sums ON sums.above = shaped.node
"""
