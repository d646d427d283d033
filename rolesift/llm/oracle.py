"""The operators' results as SQL for the checking engine, where SQL can express them."""

from __future__ import annotations

from rolesift.llm.licenses import TEMPLATES

_FORM = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


def _shingles(source: str, key: str) -> str:
    """key, pos, gram of every five words (all words of a shorter text)."""
    return f"""
    SELECT {key}, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS gram
    FROM (SELECT {key}, w, unnest(range(0, greatest(len(w) - 4, 1))) AS pos
          FROM (SELECT {key}, string_split({_FORM}, ' ') AS w FROM {source} WHERE {_FORM} <> ''))"""


NGRAM_JOIN = f"""
WITH RECURSIVE grams AS (SELECT DISTINCT doc_id, gram FROM ({_shingles('documents', 'doc_id')})),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE common.n >= 0.8 * (x.n + y.n - common.n) - 1e-9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.low, d.doc_id)) AS class_id, coalesce(n.n, 0) AS n_links
FROM documents d LEFT JOIN classes c ON c.a = d.doc_id LEFT JOIN counts n ON n.a = d.doc_id
"""

DECONTAMINATION = f"""
WITH items AS (SELECT DISTINCT item_id, gram FROM ({_shingles('benchmark', 'item_id')})),
docs AS (SELECT DISTINCT doc_id, gram FROM ({_shingles('documents', 'doc_id')})),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n FROM docs JOIN items USING (gram) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(s.n AS INTEGER) AS n_item, CAST(shared.n AS INTEGER) AS n_shared, shared.n / s.n AS containment
FROM shared JOIN sizes s USING (item_id) WHERE shared.n >= 0.8 * s.n - 1e-9
"""

_LISTED = ", ".join("('{}', '{}', '{}')".format(*(v.replace("'", "''") for v in t)) for t in TEMPLATES)
LICENSES = f"""
WITH templates AS (SELECT * FROM (VALUES {_LISTED}) AS t(template, license, text)),
wanted AS (SELECT DISTINCT template, gram FROM ({_shingles('templates', 'template')})),
sizes AS (SELECT template, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS s FROM wanted GROUP BY template),
hits AS (SELECT doc_id, template, gram, pos, s FROM ({_shingles('documents', 'doc_id')}) JOIN wanted USING (gram) JOIN sizes USING (template)),
windows AS (
    SELECT doc_id, template, gram, pos, pos // s AS window_no FROM hits
    UNION ALL SELECT doc_id, template, gram, pos, pos // s - 1 FROM hits WHERE pos >= s),
found AS (SELECT doc_id, template, window_no, count(DISTINCT gram) AS n, min(pos) AS first_word FROM windows GROUP BY doc_id, template, window_no),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY n DESC, window_no) AS place FROM found)
SELECT doc_id, template, license, sizes.n AS n_shingles, best.n AS n_found, best.n / sizes.n AS containment, CAST(first_word AS BIGINT) AS first_word
FROM best JOIN sizes USING (template) JOIN templates USING (template) WHERE place = 1 AND best.n >= 0.8 * sizes.n - 1e-9
"""

ORACLE = {
    "op5_license_scan": LICENSES,
    "op7_ngram_join": NGRAM_JOIN,
    "op8_benchmark_decontamination": DECONTAMINATION,
}
