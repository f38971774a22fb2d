"""DuckDB SQL for those queries that SQL can express. Each statement works from the tables alone."""

from __future__ import annotations

from volumetra.llm.licenses import BASE, TEMPLATES
from volumetra.llm.quality import BOILERPLATE

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"


def quality_sql() -> str:
    visible = f"length(regexp_replace(x, '{_SPACE}', '', 'g'))"
    symbols = r"(length(x) - length(regexp_replace(x, '[#*$%&|<>!{}\[\]~^=\\]', '', 'g')))"
    words = f"len(regexp_extract_all(x, '{_WORD}'))"
    separators = "(length(x) - length(regexp_replace(x, '[|>»•·]', '', 'g')))"
    phrases = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    bad = f"({symbols} > 0.12 * {visible}) OR ({separators} >= 3 AND {words} <= 4 * ({separators} + 1)) OR ({words} <= 25 AND ({phrases}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY doc_id),
q AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 length(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT ({bad})), ' '), '{_SPACE}', '', 'g')) AS clean
 FROM w LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND clean >= 0.5 * word_chars AS kept FROM q"""


def license_sql(slack: int = 2, coverage: float = 0.8) -> str:
    rows = []
    for n, (phrase, label, base) in enumerate([(p, x, "true") for p, x in BASE] + [(p, x, "false") for p, x in TEMPLATES]):
        w = phrase.split()
        rows += [f"('{w[i]}', '{w[i + 1]}', {n}, '{label}', {base}, {len(w) - 1}, {i}, CAST({1 << i} AS BIGINT))" for i in range(len(w) - 1)]
    return f"""
WITH t(t0, t1, template, label, base, grams, place, bit) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x80-\\x{{10FFFF}}]+') AS ws FROM documents),
g AS (SELECT doc_id, i - 1 AS seen, ws[i] AS w0, ws[i + 1] AS w1 FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM d WHERE len(ws) > 1)),
v AS (SELECT doc_id, template, label, base, grams, seen - place AS diagonal, bit_or(bit) AS bits FROM g JOIN t ON w0 = t0 AND w1 = t1 GROUP BY ALL),
m AS (SELECT *, CASE WHEN base THEN bits ELSE bit_or(bits) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {slack} PRECEDING AND {slack} FOLLOWING) END AS merged FROM v),
c AS (SELECT *, bit_count(merged) / CAST(grams AS DOUBLE) AS covered FROM m),
e AS (SELECT * FROM c WHERE covered >= CASE WHEN base OR grams < 5 THEN 1.0 ELSE {coverage} END),
b AS (SELECT x.*, y.best FROM e x LEFT JOIN (SELECT p.doc_id, p.template, p.diagonal, max(q.covered) AS best FROM e p JOIN e q ON p.doc_id = q.doc_id AND NOT q.base AND q.diagonal <= p.diagonal + p.grams AND p.diagonal <= q.diagonal + q.grams WHERE NOT p.base GROUP BY 1, 2, 3) y ON x.doc_id = y.doc_id AND x.template = y.template AND x.diagonal = y.diagonal),
f AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(diagonal) FILTER (WHERE base) AS first_word, max(diagonal) FILTER (WHERE base) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM b WHERE base OR covered = best GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN f ON f.doc_id = d.doc_id"""


def neardup_sql() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""


def passages_sql() -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g),
c AS (SELECT DISTINCT g.doc_id, i + k AS pos FROM g JOIN f ON f.g = g.g AND f.lo < g.doc_id, (SELECT unnest(range(13)) AS k)),
u AS (SELECT doc_id, i AS pos, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) FILTER (WHERE c.pos IS NULL) AS kept, count(c.pos) AS n FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.pos = u.pos GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


ORACLES: dict[str, str] = {
    "op1_license_scan": license_sql(),
    "op7_minhash_neardup": neardup_sql(),
    "op8_fingerprint_index": passages_sql(),
    "op10_quality_rules": quality_sql(),
}
