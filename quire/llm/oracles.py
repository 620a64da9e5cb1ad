"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

import math

from quire.llm.licenses import BASE, ENOUGH, TEMPLATES, index

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_duplicates() -> str:
    """Shingle sets, links by an equi-join on shingles, classes by recursion."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)
), reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
), class AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN class USING (doc_id)
"""


def license_scan() -> str:
    """Words with their places; phrases by places in a row; templates by votes on relative place."""
    postings, sizes = index()
    rows = ", ".join(f"('{w}', {t}, {k})" for w, found in sorted(postings.items()) for t, k in found)
    templates = ", ".join(f"({t}, '{label}', ' {key} ', {max(1, math.ceil(ENOUGH * sizes[t]))}, {sizes[t]})" for t, (label, key, _) in enumerate(TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w) WHERE "
        + " AND ".join(f"w[CAST(i AS INTEGER) + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split()))
        for phrase, label in BASE.items()
    )
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), base AS ({phrases}
), b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id
), postings(word, t, k) AS (VALUES {rows}
), templates(t, label, key, need, size) AS (VALUES {templates}
), places AS (SELECT doc_id, w[CAST(i AS INTEGER) + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w)
), votes AS (SELECT doc_id, t, count(*) AS n FROM places JOIN postings USING (word) GROUP BY doc_id, t, i - k
), accepted AS (
  SELECT v.doc_id, label, n / size AS share FROM votes v JOIN templates USING (t) JOIN w ON w.doc_id = v.doc_id WHERE n >= need AND contains(' ' || array_to_string(w.w, ' ') || ' ', key)
), labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM accepted UNION ALL SELECT doc_id, label FROM base) GROUP BY doc_id
), best AS (SELECT doc_id, max(share) AS share FROM accepted GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""
