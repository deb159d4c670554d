"""The same results in DuckDB SQL, where SQL can express them.

The other operators rest on compression, training, tokenizer ids, hashes or
match positions, which SQL has not; their tests use plain programs."""

from __future__ import annotations

from carledger.llm import linededup

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Five hexadecimal digits are four base32 ones.
_BASE32 = " || ".join(
    f"substr('{_ALPHABET}', 1 + ((CAST('0x' || substr(sha, {1 + 5 * g}, 5) AS INTEGER) >> {15 - 5 * k}) & 31), 1)"
    for g in range(8) for k in range(4))

WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_REACH = """
reach AS (
  SELECT a AS node, b AS other FROM both_ways
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other)"""

NGRAM = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
  WHERE 100 * s.k >= 80 * (x.n + y.n - s.k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_REACH}
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.node = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

VECTORS = rf"""
WITH RECURSIVE valid AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
norms AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM valid),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM norms a JOIN norms b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_REACH},
found AS (
  SELECT vec_id, CAST((SELECT count(*) FROM both_ways w WHERE w.a = e.vec_id) AS BIGINT) AS n_links,
         least(vec_id, coalesce((SELECT min(other) FROM reach r WHERE r.node = e.vec_id), vec_id)) AS component_id
  FROM embeddings e)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, w, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, c.cut,
         CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT c.*, unnest(range(1, k)) AS cut FROM candidates c) c
  JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
scored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS turn FROM cuts) x WHERE turn = 1),
inner_pairs AS (
  SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, (VALUES (1), (2)) t(s) WHERE k = 3 GROUP BY ALL),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, s.score
  FROM scored s LEFT JOIN inner_pairs i ON s.k = 2 AND i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

ORACLES = {
    "op2_line_dedup": linededup.SQL,
    "op5_warc": WARC,
    "op6_pq_near_dedup": VECTORS,
    "op10_ngram_join": NGRAM,
    "op13_collocations": PHRASES,
}
