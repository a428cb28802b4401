"""Queries on citations and reference lists."""

from __future__ import annotations

from folioscope.operators import citations as c
from folioscope.plans.registry import Registry

R = Registry()
ENTRIES = "e AS (SELECT DISTINCT doc_id, seq, entry_index AS number, key, raw, block_id FROM citation_records)"
NUMBERS = r"""m0 AS (SELECT DISTINCT doc_id, seq, key, block_id FROM marks WHERE key IS NOT NULL AND NOT contains(key, '|')),
m1 AS (SELECT doc_id, seq, block_id, unnest(string_split_regex(key, '[,;，；、]')) AS p FROM m0),
m2 AS (SELECT *, try_cast(regexp_extract(p, '^\s*(\d{1,9})\s*[-–—‑~～－]\s*(\d{1,9})\s*$', 1) AS INT) AS a, try_cast(regexp_extract(p, '^\s*(\d{1,9})\s*[-–—‑~～－]\s*(\d{1,9})\s*$', 2) AS INT) AS b FROM m1),
m AS (SELECT doc_id, seq, block_id, unnest(CASE WHEN a IS NOT NULL THEN range(least(a, b), greatest(a, b) + 1) ELSE list_transform(regexp_extract_all(p, '(\d{1,9})', 1), lambda x: CAST(x AS BIGINT)) END) AS number FROM m2)"""
WITH = f"WITH {ENTRIES}, {NUMBERS}"
UNUSED = "SELECT DISTINCT doc_id, number FROM e WHERE number IS NOT NULL AND (doc_id, number) NOT IN (SELECT (doc_id, number) FROM m)"
MISSING = "SELECT doc_id, CAST(number AS INT) AS number, count(DISTINCT seq) AS n_marks, arg_min(block_id, seq) AS first_block FROM m WHERE (doc_id, number) NOT IN (SELECT (doc_id, number) FROM e WHERE number IS NOT NULL) GROUP BY 1, 2"
DUPLICATES = "SELECT doc_id, number, count(*) AS n FROM e WHERE number IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"
GAPS = "SELECT doc_id, CAST(g AS INT) AS number FROM (SELECT doc_id, unnest(range(1, max(number) + 1)) AS g FROM e WHERE number > 0 GROUP BY 1) WHERE (doc_id, g) NOT IN (SELECT (doc_id, number) FROM e WHERE number IS NOT NULL)"
ORDER = "SELECT * FROM (SELECT doc_id, CAST(number AS INT) AS number, CAST(lag(number) OVER (PARTITION BY doc_id ORDER BY seq, number) AS INT) AS previous FROM (SELECT doc_id, number, min(seq) AS seq FROM m WHERE (doc_id, number) IN (SELECT (doc_id, number) FROM e WHERE number IS NOT NULL) GROUP BY 1, 2)) WHERE number < previous"
BLOCKS = "b AS (SELECT DISTINCT doc_id, pos, block_id, kind, text, heading_level, is_bibliography FROM blocks)"
TITLE = r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'))"
WORDS = r"list_sort(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '([\p{{L}}\p{{N}}]{{2,}}|[\x{{4e00}}-\x{{9fff}}])', 1)))"

R.add("cite_ranges", "marks", c.range_expand, f"WITH {NUMBERS} SELECT doc_id, seq, count(*) AS n, CAST(min(number) AS INT) AS lowest, CAST(max(number) AS INT) AS highest, CAST(sum(number) AS BIGINT) AS total FROM m GROUP BY 1, 2")
R.add("cite_unused", "citation_records marks", c.unused, f"{WITH} {UNUSED}")
R.add("cite_missing", "citation_records marks", c.missing, f"{WITH} {MISSING}")
R.add("cite_duplicates", "citation_records", c.duplicates, f"WITH {ENTRIES} {DUPLICATES}")
R.add("cite_gaps", "citation_records", c.gaps, f"WITH {ENTRIES} {GAPS}")
R.add("first_appearance", "citation_records marks", c.first_appearance, f"{WITH} {ORDER}")
R.add(
    "cite_author_year", "citation_records marks", c.author_year_status,
    f"""WITH {ENTRIES}, d AS (SELECT DISTINCT doc_id FROM e WHERE doc_id NOT IN (SELECT doc_id FROM e WHERE number IS NOT NULL)),
l AS (SELECT DISTINCT doc_id, lower(key) AS key FROM e WHERE number IS NULL AND key LIKE '%|%' AND doc_id IN (SELECT doc_id FROM d)),
k AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, trim(unnest(string_split_regex(lower(key), '[;；]'))) AS key FROM marks WHERE key LIKE '%|%') WHERE regexp_matches(key, '^[^|,]+\\|\\d{{4}}[a-z]?$') AND doc_id IN (SELECT doc_id FROM d))
SELECT doc_id, key, 'unused' AS status FROM l WHERE (doc_id, key) NOT IN (SELECT (doc_id, key) FROM k) UNION ALL SELECT doc_id, key, 'missing' FROM k WHERE (doc_id, key) NOT IN (SELECT (doc_id, key) FROM l)""",
)
R.add(
    "cite_sites", "citation_records marks", c.sites,
    f"""{WITH}, k AS (SELECT doc_id, mark, spot, trim(unnest(string_split_regex(lower(key), '[;；]'))) AS key FROM (SELECT DISTINCT doc_id, seq AS mark, block_id AS spot, key FROM marks WHERE key LIKE '%|%')),
s AS (SELECT e.doc_id, e.seq, m.seq AS mark, m.block_id AS spot FROM e JOIN m ON e.doc_id = m.doc_id AND e.number = m.number UNION ALL SELECT e.doc_id, e.seq, k.mark, k.spot FROM e JOIN k ON e.doc_id = k.doc_id AND lower(e.key) = k.key WHERE e.number IS NULL),
n AS (SELECT doc_id, seq, count(DISTINCT mark) AS n_marks, count(DISTINCT spot) AS n_blocks FROM s GROUP BY 1, 2)
SELECT e.doc_id, e.seq, coalesce(n_marks, 0) AS n_marks, coalesce(n_blocks, 0) AS n_blocks FROM e LEFT JOIN n ON e.doc_id = n.doc_id AND e.seq = n.seq""",
)
R.add(
    "det_citations", "citation_records marks", c.citation_findings,
    f"""{WITH}, u AS (SELECT doc_id, 'duplicate' AS issue, number FROM ({DUPLICATES}) UNION ALL SELECT doc_id, 'gap', number FROM ({GAPS}) UNION ALL SELECT doc_id, 'unused', number FROM ({UNUSED})
UNION ALL SELECT doc_id, 'missing', number FROM ({MISSING}) UNION ALL SELECT doc_id, 'order', number FROM ({ORDER}))
SELECT doc_id, issue, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT number)), 1, 20), ',') AS sample FROM u GROUP BY 1, 2""",
)
R.add(
    "cite_marks", "blocks", c.bracket_marks,
    rf"""WITH {BLOCKS}, x AS (SELECT doc_id, block_id, regexp_extract_all(text, '\[(\d[\d\s,;–—\-]*)\]', 1) AS keys FROM b WHERE NOT is_bibliography AND kind IN ('heading', 'paragraph', 'table')),
y AS (SELECT doc_id, block_id, unnest(keys) AS key, unnest(range(1, len(keys) + 1)) AS place FROM x) SELECT doc_id, block_id, CAST(place AS INT) AS place, key FROM y WHERE NOT regexp_matches(key, '^(19|20)\d\d$')""",
)
AY = r"(\p{Lu}[\p{L}\-]+)(?: et al\.| & \p{Lu}[\p{L}\-]+)?,? \(?((?:19|20)\d{2}[a-z]?)\b"
R.add(
    "author_year_marks", "blocks", c.author_year_marks,
    rf"""WITH {BLOCKS}, x AS (SELECT doc_id, block_id, regexp_extract_all(text, '{AY}', 1) AS names, regexp_extract_all(text, '{AY}', 2) AS years FROM b WHERE NOT is_bibliography AND kind <> 'biblio_entry'),
y AS (SELECT doc_id, block_id, unnest(names) AS a, unnest(years) AS z FROM x) SELECT doc_id, block_id, lower(a) || '|' || z AS key, count(*) AS n FROM y GROUP BY 1, 2, 3""",
)
R.add(
    "bib_entries", "blocks", c.bibliography,
    rf"""WITH {BLOCKS}, x AS (SELECT doc_id, block_id, try_cast(regexp_extract(text, '^\s*\[(\d{{1,9}})\]', 1) AS INT) AS number, regexp_extract(text, '^\s*([\p{{L}}\-]+)', 1) AS author, regexp_extract(text, '\b((?:19|20)\d{{2}}[a-z]?)\b', 1) AS year FROM b WHERE kind = 'biblio_entry' AND text IS NOT NULL)
SELECT doc_id, block_id, number, CASE WHEN number IS NOT NULL THEN '[' || number || ']' WHEN author <> '' AND year <> '' THEN lower(author) || '|' || year END AS key FROM x""",
)
IDENTIFIERS = {"doi": r"(?i)(10\.\d{4,9}/[^\s\"<>]+)", "arxiv": r"(?i)(?:arxiv:\s*)?\b(\d{4}\.\d{4,5})(?:v\d+)?\b", "pmid": r"(?i)\bpmid:?\s*(\d{4,9})"}
R.add(
    "identifiers", "citation_records resolver_metadata", c.identifiers,
    "WITH s AS (SELECT DISTINCT 'record' AS source, CAST(rec_id AS VARCHAR) AS id, raw FROM citation_records UNION ALL SELECT DISTINCT 'work', identifier, 'doi:' || doi FROM resolver_metadata) SELECT * FROM ("
    + " UNION ALL ".join(rf"SELECT source, id, '{k}' AS kind, lower(regexp_replace(regexp_extract(raw, '{p}', 1), '[.,;)\]]+$', '')) AS value FROM s" for k, p in IDENTIFIERS.items()) + ") WHERE value <> ''",
)
R.add(
    "cite_style", "citation_records", c.styles,
    r"""SELECT DISTINCT rec_id, CASE WHEN entry_index IS NOT NULL OR regexp_matches(raw, '^\s*\[\d+\]') THEN 'numeric' WHEN regexp_matches(raw, '[\x{4e00}-\x{9fff}]') THEN 'gbt7714'
WHEN regexp_matches(raw, '(?i)(?:\bet\s+al\b|&)') AND regexp_matches(raw, '\(\s*\d{4}[a-z]?\s*\)') THEN 'apa' WHEN regexp_matches(raw, '\(\s*\d{4}[a-z]?\s*\)') THEN 'harvard' WHEN regexp_matches(raw, '\b(?:19|20|21)\d{2}\b') THEN 'author_year' ELSE 'unknown' END AS found_style FROM citation_records""",
)
R.add(
    "parse_ref", "citation_records", c.parsed_references,
    r"""SELECT DISTINCT rec_id, try_cast(regexp_extract(raw, '\b((?:18|19|20|21)\d{2})\b', 1) AS INT) AS year, lower(regexp_extract(regexp_replace(raw, '^\s*\[\d+\]\s*', ''), '^([\p{L}\-]+)', 1)) AS first_author, regexp_extract(raw, '[“"]([^”"]+?),?[”"]', 1) AS quoted_title FROM citation_records WHERE raw IS NOT NULL""",
)
R.add(
    "metadata_mismatch", "citation_records resolver_metadata", c.metadata_mismatch,
    f"""WITH r AS (SELECT DISTINCT rec_id, {TITLE} AS k, year, authors FROM citation_records), w AS (SELECT DISTINCT identifier, {TITLE} AS k, year, authors FROM resolver_metadata)
SELECT rec_id, identifier, coalesce(r.year <> w.year, false) AS year_differs, coalesce(len(r.authors) > 0 AND len(w.authors) > 0 AND NOT list_has_any({WORDS.format('r.authors[1]')}, flatten(list_transform(w.authors, lambda a: {WORDS.format('a')}))), false) AS author_differs FROM r JOIN w ON r.k = w.k WHERE r.k <> ''""",
)
R.add(
    "publication_status", "resolver_metadata", c.publication_status,
    r"""WITH w AS (SELECT DISTINCT identifier, lower(concat_ws(' ', status, work_type, title, update_to)) AS t FROM resolver_metadata)
SELECT identifier, CASE WHEN regexp_matches(t, '\bretract(ed|ion)?\b|withdrawn') THEN 'retracted' WHEN regexp_matches(t, 'expression\s+of\s+concern|\bconcern\b') THEN 'concern' WHEN regexp_matches(t, 'correct(ed|ion)|erratum|corrigendum') THEN 'corrected' ELSE 'normal' END AS publication_status FROM w""",
)
R.add(
    "audit_summary", "citation_records", c.audit_summary,
    "WITH r AS (SELECT DISTINCT rec_id, metadata_status, publication_status, style FROM citation_records) " + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {k} AS value, count(*) AS n FROM r GROUP BY {k}" for k in ("metadata_status", "publication_status", "style")),
)
R.add(
    "evidence_topk", "citation_records resolver_metadata", c.support,
    f"""WITH r AS (SELECT DISTINCT rec_id, title, {TITLE} AS k FROM citation_records), w0 AS (SELECT DISTINCT identifier, {TITLE} AS k, string_split_regex(abstract, '[.!?。]+\\s*') AS ps FROM resolver_metadata WHERE abstract IS NOT NULL),
w AS (SELECT identifier, k, unnest(ps) AS passage, unnest(range(1, len(ps) + 1)) AS passage_no FROM w0),
j AS (SELECT rec_id, identifier, CAST(passage_no AS INT) AS passage_no, round(len(list_intersect({WORDS.format('title')}, {WORDS.format('passage')})) / len({WORDS.format('title')}), 6) AS overlap FROM r JOIN w ON r.k = w.k WHERE r.k <> '' AND trim(passage) <> '')
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY rec_id, identifier ORDER BY overlap DESC, passage_no) <= 3""",
)

QUERIES, SQL = R.queries, R.sql
