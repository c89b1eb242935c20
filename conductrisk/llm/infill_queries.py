"""Query of the fill-in-middle transformation and its SQL twin."""

from __future__ import annotations

from conductrisk.llm import infill
from conductrisk.llm.rows import load


def op12_fill_in_middle(spark, sf_dir):
    found = infill.rewrite(load(spark, sf_dir).select("doc_id", "text"), digests=True)
    return found.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}

_OP12 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(x, 1, 8))::BIGINT % (len(u) + 1) AS p,
         ('0x' || substr(x, 9, 8))::BIGINT % (len(u) + 1) AS q, ('0x' || substr(x, 17, 8))::BIGINT % 100 AS r,
         ('0x' || substr(x, 25, 8))::BIGINT % 100 AS s
  FROM units),
parts AS (
  SELECT doc_id, t, n, array_to_string(u[1:least(p, q)], '') AS a,
         array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS b, array_to_string(u[greatest(p, q) + 1:], '') AS c,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 100 THEN 'plain'
              WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
              ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
ORACLES = {"op12_fill_in_middle": _OP12}
