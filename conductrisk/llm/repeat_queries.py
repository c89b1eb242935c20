"""Queries that remove repeated passages, and their SQL twins."""

from __future__ import annotations

from conductrisk.llm import minhash, phrases, suffixes
from conductrisk.llm.rows import load


def op2_substring_dedup(spark, sf_dir):
    docs = load(spark, sf_dir).select("doc_id", "text")
    return phrases.dedup(docs, with_text=False).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op8_suffix_dedup(spark, sf_dir):
    docs = load(spark, sf_dir).select("doc_id", "text")
    return suffixes.dedup(docs, with_bytes=False).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_minhash_dedup(spark, sf_dir):
    docs = load(spark, sf_dir).select("doc_id", "text")
    return minhash.near_duplicates(docs).select("row.doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op2_substring_dedup": op2_substring_dedup, "op3_minhash_dedup": op3_minhash_dedup,
           "op8_suffix_dedup": op8_suffix_dedup}

_OP2 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 20], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM words WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(20)) AS i FROM later),
kept AS (
  SELECT doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (g.i IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words) LEFT JOIN gone g USING (doc_id, i)
  GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept USING (doc_id)
"""
# bytes as hexadecimal digits: two characters a byte
_OP8 = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (
  SELECT doc_id, s, hash(substr(x, 2 * s + 1, 200)) AS h1, md5_number_lower(substr(x, 2 * s + 1, 200)) AS h2
  FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 99)) AS s FROM texts WHERE len(x) >= 200)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h1, h2 ORDER BY doc_id, s) AS n FROM windows)
  WHERE n > 1),
steps AS (  -- runs of windows that overlap or touch
  SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true)::INT AS fresh FROM later),
spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b
  FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM steps) GROUP BY doc_id, span),
cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
         string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id)
"""
# lower() would also lower letters outside A-Z
_OP3 = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[s + 1:s + 5], ' ')) AS x
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS s FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.x = q.x AND p.doc_id <> q.doc_id
    GROUP BY ALL) c JOIN sizes sa ON sa.doc_id = c.a JOIN sizes sb ON sb.doc_id = c.b
  WHERE 100 * c.n >= 75 * (sa.n + sb.n - c.n)),
reach AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""
ORACLES = {"op2_substring_dedup": _OP2, "op3_minhash_dedup": _OP3, "op8_suffix_dedup": _OP8}
