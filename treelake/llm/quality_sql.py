"""SQL of the quality rules, made from the operator's own grids."""

from __future__ import annotations

import math

from treelake.llm.quality_rules import CUTOFFS, JOINT

RISK, LEVEL = 0.01, 0.05


def _steps() -> str:
    """(rule, step, cutoffs by rate) of all sequences; null is no cutoff."""
    rows = []
    for rule, grid in enumerate(CUTOFFS.values()):
        rows += [(rule, k, *[x if i == rule else None for i in range(3)]) for k, x in enumerate(grid)]
    rows += [(3, k, *[None if x == math.inf else x for x in step]) for k, step in enumerate(JOINT)]
    return ", ".join("(" + ", ".join("NULL" if v is None else f"{v}::DOUBLE" if i > 1 else str(v) for i, v in enumerate(r)) + ")" for r in rows)


def _risky(errors: str, n: str, risk: str, level: str) -> str:
    term = f"exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({risk}) + ({n} - k) * ln(1 - {risk}))"
    return f"list_sum(list_transform(range({errors} + 1), lambda k: {term})) > {level}"


SQL = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i : i + 4] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
rc AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT g.doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN r ON g.doc_id = r.doc_id AND g.gram = r.gram) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM w LEFT JOIN lc ON w.doc_id = lc.doc_id LEFT JOIN rc ON w.doc_id = rc.doc_id),
d AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS r0, n_dup_lines / greatest(n_lines, 1) AS r1, n_repeat_words / greatest(n_words, 1) AS r2 FROM c),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
e AS (SELECT DISTINCT lang, text, r0, r1, r2 FROM d WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
n AS (SELECT lang, count(*) AS n FROM e GROUP BY lang HAVING count(*) >= {math.ceil(math.log(LEVEL) / math.log1p(-RISK))}),
k AS (SELECT count(*) AS strata FROM n),
plan AS (SELECT lang, n, CASE WHEN {_risky("0", "n", str(RISK / 3), f"{LEVEL} / (3 * strata)")} THEN 3 ELSE 0 END AS joint FROM n, k),
s(rule, step, x0, x1, x2) AS (VALUES {_steps()}),
m AS (SELECT p.lang, rule, step, x0, x1, x2, any_value(n) AS n, count_if(coalesce(r0 > x0, false) OR coalesce(r1 > x1, false) OR coalesce(r2 > x2, false))::BIGINT AS errors FROM plan p JOIN s ON (rule = 3) = (joint = 3) JOIN e ON p.lang IS NOT DISTINCT FROM e.lang GROUP BY ALL),
f AS (SELECT m.*, {_risky("errors", "n", f"CASE WHEN rule = 3 THEN {RISK} ELSE {RISK / 3} END", f"CASE WHEN rule = 3 THEN {LEVEL} / strata ELSE {LEVEL} / (3 * strata) END")} AS risky FROM m, k),
ok AS (SELECT lang, rule, max(step) AS step FROM f WHERE step < (SELECT coalesce(min(step), 1000) FROM f z WHERE z.rule = f.rule AND z.lang IS NOT DISTINCT FROM f.lang AND z.risky) GROUP BY lang, rule),
limits AS (SELECT ok.lang, min(x0) AS x0, min(x1) AS x1, min(x2) AS x2 FROM ok JOIN s ON ok.rule = s.rule AND ok.step = s.step GROUP BY ok.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND coalesce(r0 <= x0, true) AND coalesce(r1 <= x1, true) AND coalesce(r2 <= x2, true) AS kept
FROM d LEFT JOIN limits ON d.lang IS NOT DISTINCT FROM limits.lang
"""
