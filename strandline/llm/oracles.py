"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_of AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.v, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(l.v, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_of l ON l.u = s.doc_id
"""

#: Two to the power of 64, as a number of 128 bits.
WRAP = "18446744073709551616::UHUGEINT"

SHARDS = f"""
WITH RECURSIVE
remainders AS (
  SELECT i, 0 AS k, i::UINTEGER AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END FROM remainders WHERE k < 8),
by_byte AS (SELECT list(v ORDER BY i) AS t FROM remainders WHERE k = 8),
bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
         list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS UINTEGER))) AS b
  FROM documents),
summed AS (SELECT doc_id, size, CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::UINTEGER) AS BIGINT) AS text_crc32 FROM bytes, by_byte),
k0 AS (SELECT doc_id, CASE WHEN doc_id < 0 THEN ({WRAP} - (-(doc_id::HUGEINT))::UHUGEINT)::UBIGINT ELSE doc_id::UBIGINT END AS x FROM (SELECT DISTINCT coalesce(doc_id, 0) AS doc_id FROM documents)),
k1 AS (SELECT doc_id, (xor(x, x >> 30)::UHUGEINT * 13787848793156543929 % {WRAP})::UBIGINT AS x FROM k0),
k2 AS (SELECT doc_id, (xor(x, x >> 27)::UHUGEINT * 10723151780598845931 % {WRAP})::UBIGINT AS x FROM k1),
jumps AS (
  SELECT doc_id, xor(x, x >> 31) AS state, 0::DOUBLE AS here FROM k2
  UNION ALL
  SELECT doc_id, state, floor((here + 1) * (2147483648::DOUBLE / ((state >> 33) + 1)::DOUBLE))
  FROM (SELECT doc_id, here, ((state::UHUGEINT * 2862933555777941757 + 1) % {WRAP})::UBIGINT AS state FROM jumps WHERE here < 25)),
placed AS (SELECT doc_id, CAST(max(here) FILTER (here < 24) AS INTEGER) AS shard, CAST(max(here) FILTER (here < 25) AS INTEGER) AS grown_shard FROM jumps GROUP BY doc_id)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, p.shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1 AS slot, p.grown_shard
FROM summed s JOIN placed p ON p.doc_id = coalesce(s.doc_id, 0)
"""

COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]'),
                               lambda p: list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> ''))) AS w
  FROM documents),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM pieces, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM f WHERE f >= 100),
kept AS (
  SELECT * FROM frequent c WHERE k >= 2 AND NOT EXISTS (
    SELECT 1 FROM frequent d, range(1, 5) t(i) WHERE d.lang = c.lang AND d.k > c.k AND i <= d.k - c.k + 1 AND d.g[i:i + c.k - 1] = c.g AND 100 * d.f >= 100 * c.f)),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, n, CAST(1000 * c.f::HUGEINT * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM kept c JOIN range(1, 5) t(j) ON j < c.k JOIN total USING (lang)
  JOIN frequent l ON l.lang = c.lang AND l.g = c.g[:j] JOIN frequent r ON r.lang = c.lang AND r.g = c.g[j + 1:]),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS nth FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM worst WHERE nth = 1)
SELECT lang, rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLES = {"op9_minmax_near_dedup": NEAR_DUPLICATES, "op11_trie_collocations": COLLOCATIONS, "op12_jump_hash_sharding": SHARDS}
