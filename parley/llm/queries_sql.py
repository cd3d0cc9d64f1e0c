"""SQL that gives the rows of registered queries, for the comparison."""

from __future__ import annotations

#: CRC-32 by its rule: a table of 256 remainders, then byte by byte.
BYTE_SHARDS = r"""
WITH RECURSIVE bits AS (
  SELECT n::UINTEGER AS n, n::UINTEGER AS value, 0 AS step FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384::UINTEGER) ELSE value >> 1 END, step + 1 FROM bits WHERE step < 8
), lookup AS (SELECT list(value ORDER BY n) AS entries FROM bits WHERE step = 8),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UINTEGER) AS bytes
  FROM documents
), summed AS (
  SELECT doc_id, size, xor(list_reduce(bytes, lambda crc, x: xor(crc >> 8, entries[(xor(crc, x) & 255) + 1]), 4294967295::UINTEGER),
                           4294967295::UINTEGER)::BIGINT AS text_crc32
  FROM sized, lookup
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM summed
), cut AS (SELECT *, least(7, (16 * upto - 8 * size) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY upto) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut
"""

#: All pairs of documents that share a five-word shingle, and what their links reach.
NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(5, len(w)) - 1) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * common >= 8 * (x.n + y.n - common)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON e.a = r.b
)
SELECT doc_id, (SELECT min(b) FROM reached WHERE a = doc_id) AS class_id, (SELECT count(*) FROM both_ways WHERE a = doc_id)::BIGINT AS n_links
FROM documents
"""

#: All pairs of distinct lines that share a twelve-character shingle; the first line of each component stays.
FUZZY_LINES = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, place, trim(line, E' \t\r\x0b\x0c') AS line
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents))
  WHERE trim(line, E' \t\r\x0b\x0c') <> ''
), distinct_lines AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM lines)),
grams AS (
  SELECT DISTINCT id, hash(substr(line, i, 12)) AS g
  FROM (SELECT id, line, unnest(range(1, greatest(length(line) - 12, 0) + 2)) AS i FROM distinct_lines)
), sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 10 * common >= 8 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT id AS a, id AS b FROM distinct_lines UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON e.a = r.b),
classes AS (SELECT a AS id, min(b) AS class FROM reached GROUP BY a),
ranked AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY class ORDER BY doc_id, place) AS nth
  FROM lines JOIN distinct_lines USING (line) JOIN classes USING (id)
), drops AS (SELECT doc_id, list(place) AS places FROM ranked WHERE nth > 1 GROUP BY doc_id),
split AS (SELECT doc_id, string_split(text, E'\n') AS l, coalesce(places, []) AS places FROM documents LEFT JOIN drops USING (doc_id))
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: NOT list_contains(places, i)), E'\n') AS text,
       len(l)::INTEGER AS n_lines, len(places)::INTEGER AS n_dropped
FROM split
"""

#: All pairs of documents that share a four-word shingle; components of links by their least id.
NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(4, len(w)) - 1) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON e.a = r.b
), least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN least_id USING (doc_id)
"""

#: Words with every letter blanked or taken out in turn: two that are one edit apart meet in one such pattern.
SPELLING = r"""
WITH RECURSIVE bits AS (
  SELECT n::UINTEGER AS n, n::UINTEGER AS value, 0 AS step FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384::UINTEGER) ELSE value >> 1 END, step + 1 FROM bits WHERE step < 8
), lookup AS (SELECT list(value ORDER BY n) AS entries FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
  ) WHERE length(run) >= 6 GROUP BY ALL
), coded AS (
  SELECT run, n, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: ('0x' || x)::UINTEGER) AS bytes FROM runs
), drawn AS (
  SELECT run, n, xor(list_reduce(bytes, lambda crc, x: xor(crc >> 8, entries[(xor(crc, x) & 255) + 1]), 4294967295::UINTEGER),
                     4294967295::UINTEGER)::BIGINT AS h FROM coded, lookup
), kept AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM drawn
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
patterns AS (
  SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS blank, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM patterns a JOIN patterns b ON a.blank = b.blank AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM patterns a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM patterns a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS nth FROM near
), formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * words.n THEN near END AS form,
         CASE WHEN near_n >= 5 * words.n THEN near_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word AND nth = 1
), steps AS (
  SELECT word, coalesce(form, word) AS root, 0 AS step FROM formed
  UNION ALL SELECT steps.word, formed.form, step + 1 FROM steps JOIN formed ON formed.word = steps.root WHERE formed.form IS NOT NULL
)
SELECT word, form, (SELECT arg_max(root, step) FROM steps s WHERE s.word = formed.word) AS root, n, n_near, form_n FROM formed
"""

#: Every document scored for every item.
RANKED_SEARCH = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
