"""SQL twins of the registered queries, where SQL can express them."""

from __future__ import annotations

_TOPK = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""

_WORDS = r"[^\x20\x09-\x0D]+"

_RULES = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS w FROM texts
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + shift) AS n_repeat_words
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, phrase) AS n FROM windows), range(3) t(shift)
  WHERE n >= 2 GROUP BY doc_id
), lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '{_WORDS}')
), line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id
), measured AS (
  SELECT t.doc_id, len(w.w) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(t.text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w.w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words
  FROM texts t JOIN words w USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN line_counts USING (doc_id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 10 * n_dup_lines > 5 * n_lines
    OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words) OR 10 * n_letter_words < 6 * n_words) AS kept
FROM based
"""

_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_DECONTAMINATE = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '{_LETTERS}') AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_TEXT}, '{_LETTERS}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM item_words WHERE len(w) > 0))
), starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), occurrences AS (
  SELECT doc_id, i, s.n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM starts) s
  JOIN windows USING (n, phrase)
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM occurrences) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM occurrences) GROUP BY doc_id
), tokens AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term FROM docs
), counts AS (
  SELECT term, count(*) AS n FROM tokens GROUP BY term
), rarest AS (
  SELECT item, term, place, count(*) OVER (PARTITION BY item) AS asked FROM (
    SELECT item, term, row_number() OVER (PARTITION BY item ORDER BY n, term) AS place
    FROM (SELECT DISTINCT item, unnest(w) AS term FROM item_words) JOIN counts USING (term)
  ) WHERE place <= 3
), seen AS (
  SELECT doc_id, item, asked, pos,
    max(CASE WHEN place = 1 THEN pos END) OVER before AS a,
    max(CASE WHEN place = 2 THEN pos END) OVER before AS b,
    max(CASE WHEN place = 3 OR asked = 2 THEN pos END) OVER before AS c
  FROM tokens JOIN rarest USING (term) WHERE asked > 1
  WINDOW before AS (PARTITION BY doc_id, item ORDER BY pos)
), near AS (
  SELECT doc_id, count(DISTINCT item) AS n_near FROM seen WHERE pos - a < 20 AND pos - b < 20 AND pos - c < 20 GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

_NEGATIVES = """
WITH ints AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints a JOIN ints c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same
  ) WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
) WHERE rank <= 10
"""

_COLLOCATIONS = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(text, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_TEXT}, '[.,;:!?\\x0A-\\x0D]')) AS text FROM documents)
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, range(1, 4) t(size) WHERE len(w) >= size)
), f AS (
  SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10
), covering AS (
  SELECT lang, phrase, max(a) AS longest
  FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE size = 3)
  GROUP BY lang, phrase
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part
  FROM (SELECT c.*, unnest(range(1, size)) AS k FROM candidates c)
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r,
    CAST((c.a::HUGEINT * c.a::HUGEINT * 1000000) // (x.a::HUGEINT * y.a::HUGEINT) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = left_part JOIN f y ON y.lang = c.lang AND y.phrase = right_part
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b LEFT JOIN covering USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a
) JOIN totals USING (lang) WHERE rank <= 2000
"""

_JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '{_WORDS}') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sets a JOIN sets b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY x, y
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

# bytes are pairs of hexadecimal digits
_REPEATS = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, block, substr(h, 2 * block + 1, 1198) AS part
  FROM (SELECT *, unnest(range(0, len(h) // 2 - 99, 500)) AS block FROM bytes WHERE len(h) >= 200)
), strings AS (
  SELECT doc_id, block + o AS i, row_number() OVER (PARTITION BY md5_number(substr(part, 2 * o + 1, 200)) ORDER BY doc_id, block + o) > 1 AS again
  FROM (SELECT *, unnest(range(len(part) // 2 - 99)) AS o FROM blocks)
), starts AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM strings WHERE again
), numbered AS (
  SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts
), runs AS (
  SELECT doc_id, run, min(i) AS s, max(i) + 100 AS e FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS upto FROM runs
), cut AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS upto,
    string_agg(substr(h, 2 * upto + 1, 2 * (s - upto)), '' ORDER BY s) AS kept
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""

SQL: dict[str, str] = {
    "op1_topk": _TOPK,
    "op4_jaccard": _JACCARD,
    "op7_rules": _RULES,
    "op9_repeats": _REPEATS,
    "op11_collocations": _COLLOCATIONS,
    "op12_decontaminate": _DECONTAMINATE,
    "op13_negatives": _NEGATIVES,
}
