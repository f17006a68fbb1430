"""SQL twins (DuckDB) of the operators that SQL can express on whole tables."""

#: 100-byte strings of every text by their first place; a byte is gone if such a string that starts earlier too covers it.
SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
b AS (SELECT doc_id, bytes, unnest(range(1, octet_length(bytes) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, bytes[pos:pos] AS byte, CASE WHEN pos + 99 <= octet_length(bytes) THEN bytes[pos:pos + 99] END AS string FROM b),
r AS (SELECT doc_id, pos, byte, string IS NOT NULL AND row_number() OVER (PARTITION BY string ORDER BY doc_id, pos) > 1 AS later FROM k),
m AS (SELECT doc_id, pos, byte, coalesce(max(CASE WHEN later THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) >= pos - 99, false) AS gone FROM r),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM m),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(hex(byte), '' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY 1)
SELECT d.doc_id, octet_length(bytes) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

#: The same with windows of 20 words.
RECOMPRESSION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, word, CASE WHEN pos + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS window_words FROM u),
r AS (SELECT doc_id, pos, word, window_words IS NOT NULL AND row_number() OVER (PARTITION BY md5(window_words) ORDER BY doc_id, pos) > 1 AS later FROM k),
m AS (SELECT doc_id, pos, word, coalesce(max(CASE WHEN later THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) >= pos - 19, false) AS gone FROM r),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

#: All scores of every anchor; positives by rank among its label, negatives by rank in each positive's window.
HARD_NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

#: CRC-32 by its table; near words share what is left when a letter is taken from one or from both.
SPELLING_VARIANTS = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
bytes AS (SELECT run, n, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table),
altered AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS near_n FROM pairs GROUP BY 1),
f AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

SQL = {"op1_suffix_dedup": SUFFIX_DEDUP, "op8_recompression": RECOMPRESSION, "op12_spelling_variants": SPELLING_VARIANTS, "op13_hard_negatives": HARD_NEGATIVES}
