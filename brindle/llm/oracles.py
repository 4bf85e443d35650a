"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from . import licenses, mixing, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _words(words) -> str:
    return "[" + ", ".join(_text(w) for w in words) + "]"


def license_sql() -> str:
    """All places of the phrases, and every template on every block."""
    phrases = [t for t in licenses.TEMPLATES if t.exact]
    notices = [(t.label, list(dict.fromkeys(t.words)), licenses.step_of(t)) for t in licenses.TEMPLATES if not t.exact]
    here = " OR ".join(f"({' AND '.join(f'w[i + {k}] = {_text(x)}' for k, x in enumerate(t.words))})" for t in phrases)
    each = " ".join(f"WHEN {' AND '.join(f'w[i + {k}] = {_text(x)}' for k, x in enumerate(t.words))} THEN {_text(t.label)}" for t in phrases)
    rows = ", ".join(f"({_text(label)}, {_words(words)}, {licenses.THRESHOLD} * {len(words)} - 1e-9, {step})" for label, words, step in notices)
    steps = ", ".join(f"({s})" for s in sorted({s for _, _, s in notices}))
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS place, CASE {each} END AS label FROM (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: {here})) AS i FROM d)),
b AS (SELECT doc_id, step, list_distinct(w[step * k + 1 : step * (k + 2)]) AS s FROM (SELECT doc_id, w, step, unnest(range(0, (len(w) + step - 1) // step)) AS k FROM d, (VALUES {steps}) z(step))),
t(label, ws, need, step) AS (VALUES {rows}),
m AS (SELECT doc_id, label, max(len(list_intersect(s, ws)) / len(ws)) AS c FROM b JOIN t USING (step) WHERE len(list_intersect(s, ws)) >= need GROUP BY ALL),
pa AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, array_to_string(list_sort(list_distinct(list(label))), ',') AS ls FROM p GROUP BY doc_id),
al AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS ls, max(c) AS c FROM (SELECT doc_id, label, c FROM m UNION ALL SELECT doc_id, label, 1.0 FROM p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(pa.ls, '') AS base_labels, coalesce(al.ls, '') AS labels, coalesce(c, 0)::DOUBLE AS score FROM d LEFT JOIN pa USING (doc_id) LEFT JOIN al USING (doc_id)"""


NEAR_DEDUP_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
e AS (SELECT doc_id, unnest(s) AS x FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
r AS (SELECT a, b FROM (SELECT a, b FROM l UNION SELECT b, a FROM l) UNION SELECT r.a, y.b FROM r JOIN (SELECT a, b FROM l UNION SELECT b, a FROM l) y ON r.b = y.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(lo, doc_id)) AS component_id, doc_id <= coalesce(lo, doc_id) AS kept FROM s LEFT JOIN (SELECT a, min(b) AS lo FROM r GROUP BY a) ON a = doc_id"""


def secret_sql() -> str:
    """Places of every rule's matches: gaps and matches alternate, as in the native form."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        at = "list_sum(list_transform(g[1 : k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: len(x))), 0)"
        own = f"regexp_extract_all(t, {_text(r.pattern)}, {r.value})"
        parts.append(f"SELECT doc_id, {i} AS rank, {_text(r.kind)} AS kind, ({at})::BIGINT AS lo, len(m[k])::BIGINT AS n FROM (SELECT doc_id, string_split_regex(t, {_text(r.pattern)}) AS g, regexp_extract_all(t, {_text(r.pattern)}, 0) AS m, {own} AS v, unnest(range(1, len(regexp_extract_all(t, {_text(r.pattern)}, 0)) + 1)) AS k FROM d) WHERE len(v[k]) >= {r.least}")
    base = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(CASE WHEN kind = {_text(r.kind)} THEN 1 END) AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(CASE WHEN rank < {base} THEN kind || ':' || lo || ':' || (lo + n) END, ',' ORDER BY lo, rank), '')) AS base_sha256,
coalesce(string_agg(kind || ':' || lo || ':' || (lo + n), ',' ORDER BY lo, rank), '') AS spans FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"""


_ORDER = "(ORDER BY cap / weight, weight, rk ROWS BETWEEN {})"
MIXING_SQL = f"""WITH d AS (SELECT doc_id, source, md5('{mixing.SEED}' || chr(31) || doc_id::VARCHAR) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
r AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rk - 1) % 3 + 1] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM r),
l AS (SELECT *, (total - coalesce(sum(cap) OVER {_ORDER.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0))::DOUBLE / sum(weight) OVER {_ORDER.format('CURRENT ROW AND UNBOUNDED FOLLOWING')} AS level FROM w),
f AS (SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER {_ORDER.format('UNBOUNDED PRECEDING AND CURRENT ROW')} AS own FROM l),
t AS (SELECT source, source_size, CASE WHEN own IS NULL THEN cap::DOUBLE ELSE own * weight END AS target FROM f),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
o AS (SELECT d.*, x.source_size, target, whole, (round(target)::BIGINT - whole * x.source_size) - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, (whole * size + least(greatest(room, 0), size))::BIGINT AS taken FROM o"""

ORACLE_SQL = {"op2_licenses": license_sql(), "op3_near_dedup": NEAR_DEDUP_SQL, "op6_secrets": secret_sql(), "op9_mixing": MIXING_SQL}
