"""Queries on numeric statements."""

from __future__ import annotations

from folioscope.operators import numeric as n
from folioscope.plans.registry import Registry

R = Registry()
FACTS = "f AS (SELECT DISTINCT * FROM numeric_facts)"
P = r"""p AS (SELECT fact_id, CASE o WHEN '≤' THEN '<=' WHEN '≥' THEN '>=' WHEN '' THEN '=' ELSE o END AS operator, coalesce(try_cast(v AS DOUBLE), value) AS value
FROM (SELECT fact_id, value, regexp_extract(raw, 'p\s*(<=|>=|≤|≥|<|>|=)', 1) AS o, regexp_extract(raw, 'p\s*(?:<=|>=|≤|≥|<|>|=)\s*(\d*\.?\d+)', 1) AS v FROM f WHERE kind = 'p_value'))"""
RANGE = "bad AS (SELECT fact_id, doc_id, kind, value FROM f WHERE (kind = 'p_value' AND NOT value BETWEEN 0 AND 1) OR (kind = 'sample_size' AND value < 1) OR (kind = 'ci' AND (ci_interval.low > ci_interval.high OR NOT confidence_level BETWEEN 0 AND 100)))"
CONFLICTS = r"""k AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(metric, '\s*[\[(,].*$', '')), '^(mean|median|average)\s+', '')) AS metric, lower(trim(coalesce(unit, ''))) AS unit, round(value, 10) AS value FROM f WHERE kind = 'value' AND value IS NOT NULL AND metric IS NOT NULL),
conflicts AS (SELECT doc_id, metric, unit, count(DISTINCT value) AS n_values, count(*) AS n_facts, min(value) AS low, max(value) AS high FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT value) >= 2)"""
INTERVALS = "iv AS (SELECT a.doc_id, a.fact_id, b.fact_id AS other, b.value BETWEEN a.ci_interval.low AND a.ci_interval.high AS inside FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.block_id = b.block_id AND lower(a.metric) = lower(b.metric) WHERE a.kind = 'ci' AND b.kind = 'value' AND b.value IS NOT NULL)"
CELLS = """t AS (SELECT DISTINCT doc_id, block_id, cell_rows FROM blocks WHERE len(cell_rows) > 1),
r AS (SELECT doc_id, block_id, cell_rows[1] AS head, unnest(cell_rows[2:]) AS rw, unnest(range(1, len(cell_rows))) AS row_no FROM t),
c0 AS (SELECT doc_id, block_id, head, rw[1] AS row_label, row_no, unnest(rw) AS cell, unnest(range(1, len(rw) + 1)) AS col_no FROM r),
cells AS (SELECT doc_id, block_id, CAST(row_no AS INT) AS row_no, CAST(col_no AS INT) AS col_no, head[col_no] AS header, row_label, cell, try_cast(replace(trim(cell), ',', '') AS DOUBLE) AS value FROM c0)"""
NUM = r"((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"

R.add("num_parse", "numeric_facts", n.parsed, rf"WITH {FACTS}, v AS (SELECT fact_id, value, try_cast(replace(regexp_extract(raw, '{NUM}', 1), ',', '') AS DOUBLE) AS parsed FROM f WHERE kind = 'value') SELECT fact_id, parsed, abs(parsed - value) <= 1e-9 * greatest(1.0, abs(value)) AS agrees FROM v")
R.add(
    "p_significance", "numeric_facts", n.significance,
    f"WITH {FACTS}, {P} SELECT fact_id, operator, value, CASE WHEN operator IN ('<', '<=') THEN CASE WHEN value > 0.05 THEN false WHEN operator = '<=' OR value < 0.05 THEN true END WHEN operator IN ('>', '>=') THEN CASE WHEN value >= 0.05 THEN false END ELSE value < 0.05 END AS significant FROM p",
)
R.add("p_range", "numeric_facts", n.out_of_range, f"WITH {FACTS}, {RANGE} SELECT fact_id, kind, value FROM bad")
R.add("sample_sizes", "numeric_facts", n.sample_sizes, f"WITH {FACTS} SELECT doc_id, count(*) AS n_facts, count(DISTINCT value) AS n_distinct, min(value) AS smallest, max(value) AS largest FROM f WHERE kind = 'sample_size' AND value IS NOT NULL GROUP BY 1")
R.add("metric_conflict", "numeric_facts", n.conflicts, f"WITH {FACTS}, {CONFLICTS} SELECT * FROM conflicts")
R.add(
    "metric_family", "numeric_facts", n.metric_families,
    rf"WITH {FACTS} SELECT CASE WHEN regexp_matches(lower(metric), 'precision|精确率') THEN 'precision' WHEN regexp_matches(lower(metric), 'recall|sensitivity|召回') THEN 'recall' WHEN regexp_matches(lower(metric), '\bf-?1\b|f值') THEN 'f1' WHEN regexp_matches(lower(metric), 'accura|准确') THEN 'accuracy' ELSE 'other' END AS family, count(*) AS n_facts, count(DISTINCT doc_id) AS n_docs FROM f WHERE kind = 'value' GROUP BY 1",
)
R.add("interval_check", "numeric_facts", n.interval_checks, f"WITH {FACTS}, {INTERVALS} SELECT fact_id, other, inside FROM iv")
R.add("table_unpivot", "blocks", n.cells, f"WITH {CELLS} SELECT * FROM cells")
R.add(
    "table_total", "blocks", n.table_totals,
    rf"""WITH {CELLS}, g AS (SELECT doc_id, block_id, header, round(sum(value) FILTER (NOT tot), 6) AS parts, max(value) FILTER (tot) AS stated FROM (SELECT *, coalesce(regexp_matches(row_label, '{n.TOTAL}'), false) AS tot FROM cells WHERE value IS NOT NULL AND col_no > 1) GROUP BY 1, 2, 3)
SELECT doc_id, block_id, header, parts, stated, abs(parts - stated) < 1e-6 AS right FROM g""",
)
R.add(
    "numerics", "blocks", n.body_numbers,
    rf"""WITH b AS (SELECT DISTINCT doc_id, block_id, text FROM blocks WHERE NOT is_bibliography AND text IS NOT NULL), x AS (SELECT doc_id, block_id, text, regexp_extract_all(text, '{NUM}', 1) AS v FROM b)
SELECT doc_id, block_id, CAST(len(v) AS INT) AS n_numbers, CAST(len(list_filter(v, lambda y: regexp_matches(y, '^(19\d\d|20\d\d|2100)$'))) AS INT) AS n_years, CAST(len(regexp_extract_all(text, '{NUM}\s*[%％]', 1)) AS INT) AS n_percent FROM x WHERE len(v) > 0""",
)
R.add(
    "det_numbers", "numeric_facts", n.statement_findings,
    f"WITH {FACTS}, {CONFLICTS}, {RANGE}, {INTERVALS} SELECT doc_id, issue, count(*) AS n FROM (SELECT doc_id, 'conflict' AS issue FROM conflicts UNION ALL SELECT doc_id, 'range' FROM bad UNION ALL SELECT doc_id, 'interval' FROM iv WHERE NOT inside) GROUP BY 1, 2",
)
PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
R.add("context_key", "numeric_facts", n.context_keys, rf"WITH {FACTS} SELECT fact_id, trim(regexp_replace(replace(regexp_replace({PLAIN.format('context')}, '\d+', ' ', 'g'), {PLAIN.format('metric')}, ' '), ' +', ' ', 'g')) AS context_key FROM f")

QUERIES, SQL = R.queries, R.sql
