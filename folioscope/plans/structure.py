"""Queries on headings, sections, captions, references and terms."""

from __future__ import annotations

from folioscope.functions.text import WS
from folioscope.operators import structure as s
from folioscope.plans.registry import Registry

R = Registry()
B = "b AS (SELECT DISTINCT doc_id, pos, block_id, kind, text, heading_level, is_bibliography FROM blocks)"
H = "h AS (SELECT doc_id, pos, block_id, text, heading_level FROM b WHERE kind = 'heading' AND text IS NOT NULL)"

NORM = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"
WORDS = r"list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{N}]{2,}|[\x{4e00}-\x{9fff}])', 1)))"
KIND = "CASE WHEN lower({}) IN ('表', 'table', 'tabelle', 'tableau') THEN 'table' ELSE 'figure' END"
NUMBER = r"^\s*(\d{1,18}(?:[.\-]\d{1,18})*)[\s、.]+"
CHAPTER = rf"^\s*第([{s.CHAPTERS}])[章节部分]"
GAPS = f"""n AS (SELECT doc_id, block_id, pos, CASE WHEN regexp_matches(text, '{NUMBER}') THEN string_split(replace(regexp_extract(text, '{NUMBER}', 1), '-', '.'), '.') ELSE [CAST(strpos('{s.CHAPTERS}', regexp_extract(text, '{CHAPTER}', 1)) AS VARCHAR)] END AS p FROM h WHERE regexp_matches(text, '{NUMBER}') OR regexp_matches(text, '{CHAPTER}')),
many AS (SELECT doc_id FROM h WHERE heading_level > 0 AND trim(text) <> '' GROUP BY 1 HAVING count(*) >= 3),
g AS (SELECT doc_id, array_to_string(p[1:len(p) - 1], '.') AS parent, arg_min(CAST(p[-1] AS BIGINT), pos) AS first, max(CAST(p[-1] AS BIGINT)) AS top, list(CAST(p[-1] AS BIGINT)) AS have, count(*) AS k FROM n WHERE doc_id IN (SELECT doc_id FROM many) GROUP BY 1, 2),
gaps AS (SELECT doc_id, parent, m AS missing FROM (SELECT *, unnest(range(first, top + 1)) AS m FROM g WHERE k >= 2 AND first < top) WHERE NOT list_contains(have, m))"""
MISSING = "missing AS (SELECT * FROM (SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce(bool_or(kind = 'heading' AND regexp_matches(text, '{p}')), false) THEN '{n}' END" for n, p in s.REQUIRED.items()) + ") AS missing FROM b GROUP BY 1) WHERE missing <> '')"
CAPTIONS = f"captions AS (SELECT doc_id, block_id, {KIND.format(f"regexp_extract(text, '{s.CAPTION}', 1)")} AS kind, replace(regexp_extract(text, '{s.CAPTION}', 2), '.', '-') AS label, trim(regexp_extract(text, '{s.CAPTION}', 3)) <> '' AS described FROM b WHERE kind IN ('paragraph', 'caption') AND regexp_matches(text, '{s.CAPTION}'))"
REFS = f"""r0 AS (SELECT doc_id, block_id, unnest(regexp_extract_all(text, '{s.REFERENCE}', 1)) AS w, unnest(regexp_extract_all(text, '{s.REFERENCE}', 2)) AS x FROM b WHERE NOT is_bibliography AND kind IN ('paragraph', 'list_item', 'table')),
refs AS (SELECT doc_id, block_id, {KIND.format('w')} AS kind, replace(x, '.', '-') AS label, count(*) AS n FROM r0 GROUP BY 1, 2, 3, 4)"""
BROKEN = "broken AS (SELECT doc_id, kind, label, count(DISTINCT block_id) AS n_blocks FROM refs WHERE (doc_id, kind, label) NOT IN (SELECT (doc_id, kind, label) FROM captions WHERE described) GROUP BY 1, 2, 3)"
STOP = ", ".join(f"'{w}'" for w in s.NO_ACRONYMS)
ACRONYMS = rf"""a0 AS (SELECT doc_id, pos, block_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}\p{{M}}_\-.])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}\p{{M}}_\-])([A-Z][A-Z0-9]{{1,5}}(?:\.[0-9]+)?)(?:[^A-Za-z0-9/]|$)', 1))) AS acronym FROM b WHERE kind = 'paragraph' AND NOT is_bibliography),
acr AS (SELECT doc_id, acronym, arg_min(block_id, pos) AS first_block, count(*) AS n_blocks FROM a0 WHERE acronym NOT IN ({STOP}) GROUP BY 1, 2)"""
UNDEFINED = r"""spelt AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '[（(][^（）()]*?\b([A-Z][A-Z0-9]{1,5}(?:\.[0-9]+)?)\b[^（）()]*[）)]', 1), regexp_extract_all(text, '\b([A-Z][A-Z0-9]{1,5}(?:\.[0-9]+)?)\s*[（(]\s*[\x{4e00}-\x{9fff}A-Za-z]', 1))) AS acronym FROM b WHERE NOT is_bibliography AND text IS NOT NULL),
undef AS (SELECT * FROM acr WHERE (doc_id, acronym) NOT IN (SELECT (doc_id, acronym) FROM spelt))"""

R.add("norm_ws", "blocks", s.normalised, rf"WITH {B} SELECT doc_id, block_id, {NORM} AS norm, left(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug FROM b")
R.add("tokens", "blocks", s.tokens, f"WITH {B} SELECT doc_id, block_id, CAST(len({WORDS}) AS INT) AS n_tokens, array_to_string({WORDS}, ' ') AS tokens FROM b")
R.add(
    "doc_stats", "blocks", s.statistics,
    rf"WITH {B} SELECT doc_id, count(*) AS n_blocks, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '([A-Za-z]+|[\x{{4e00}}-\x{{9fff}}])', 1))) AS BIGINT) AS n_words, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("heading", "table", "caption", "biblio_entry", "list_item")) + " FROM b GROUP BY 1",
)
R.add(
    "passage_split", "documents", s.passages,
    r"WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(text, '(?:\r?\n){2,}'), lambda x: length(trim(x)) > 0) AS ps FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(unnest(range(1, len(ps) + 1)) AS INT) AS passage_no, CAST(length(unnest(ps)) AS INT) AS n_chars FROM d",
)
R.add(
    "heading_levels", "blocks", s.heading_levels,
    rf"""WITH {B}, {H}, x AS (SELECT *, regexp_extract(text, '^\s*(\d+(?:[.\-]\d+)*)[\s、.]+', 1) AS numbering FROM h)
SELECT doc_id, block_id, CAST(CASE WHEN regexp_matches(text, '{s.BIBLIOGRAPHY}') THEN 1 WHEN numbering <> '' THEN length(numbering) - length(regexp_replace(numbering, '[.\-]', '', 'g')) + 1 WHEN length(text) <= 90 AND regexp_matches(text, '[A-Z]{{2}}') AND upper(text) = text THEN 1 ELSE 0 END AS INT) AS level, numbering FROM x""",
)
R.add(
    "heading_fallback", "blocks", s.heading_like,
    rf"WITH {B} SELECT doc_id, block_id FROM b WHERE kind IN ('paragraph', 'list_item') AND length(text) <= 180 AND (regexp_matches(text, '{s.BIBLIOGRAPHY}') OR (regexp_matches(trim(text), '^\d+(?:\.\d+)*[\s、.]+\S') AND NOT regexp_matches(trim(text), '[.。;；:：,，!?！？]$')))",
)
R.add("heading_numbers", "blocks", s.heading_numbers, f"WITH {B}, {H}, {GAPS} SELECT doc_id, block_id, pos, array_to_string(p[1:len(p) - 1], '.') AS parent, CAST(p[-1] AS BIGINT) AS n FROM n")
R.add("heading_gaps", "blocks", s.heading_gaps, f"WITH {B}, {H}, {GAPS} SELECT * FROM gaps")
R.add(
    "bib_region", "blocks", s.bibliography_region,
    f"""WITH {B}, e AS (SELECT *, last_value(CASE WHEN kind = 'heading' AND heading_level <= 3 THEN coalesce(regexp_matches(text, '{s.BIBLIOGRAPHY}'), false) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM b)
SELECT doc_id, block_id, kind <> 'heading' AND coalesce(st, false) AS in_region FROM e""",
)
R.add(
    "sections", "blocks", s.sections,
    f"""WITH {B}, e AS (SELECT *, count(*) FILTER (kind = 'heading' AND heading_level <= 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM b)
SELECT doc_id, CAST(k AS INT) AS section_no, min(pos) AS first_pos, count(*) AS n_blocks, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM e GROUP BY 1, 2""",
)
R.add("outline", "blocks", s.outline, f"WITH {B}, {H} SELECT doc_id, count(*) AS n_headings, string_agg(repeat('  ', greatest(heading_level - 1, 0)) || {NORM}, chr(10) ORDER BY pos) AS outline FROM h GROUP BY 1")
R.add("struct_required", "blocks", s.required_sections, f"WITH {B}, {MISSING} SELECT * FROM missing")
R.add("captions", "blocks", s.captions, f"WITH {B}, {CAPTIONS} SELECT * FROM captions")
R.add("xref_refs", "blocks", s.references, f"WITH {B}, {REFS} SELECT * FROM refs")
R.add("xref_broken", "blocks", s.broken_references, f"WITH {B}, {CAPTIONS}, {REFS}, {BROKEN} SELECT * FROM broken")
R.add("acronyms", "blocks", s.acronyms, f"WITH {B}, {ACRONYMS} SELECT * FROM acr")
R.add("undefined_acronyms", "blocks", s.undefined_acronyms, f"WITH {B}, {ACRONYMS}, {UNDEFINED} SELECT * FROM undef")
R.add("det_privacy_body", "blocks", s.identity_hints, f"WITH {B} SELECT doc_id, block_id, regexp_matches(text, '{s.EMAIL}') AS email, regexp_matches(text, '{s.IDENTITY}') AS label FROM b WHERE regexp_matches(text, '{s.EMAIL}') OR regexp_matches(text, '{s.IDENTITY}')")
R.add(
    "det_structure", "blocks", s.structure_findings,
    f"""WITH {B}, {H}, {GAPS}, {MISSING}, {CAPTIONS}, {REFS}, {BROKEN}, {ACRONYMS}, {UNDEFINED}
SELECT doc_id, issue, count(*) AS n FROM (SELECT doc_id, 'numbering' AS issue FROM gaps UNION ALL SELECT doc_id, 'section' FROM missing UNION ALL SELECT doc_id, 'reference' FROM broken UNION ALL SELECT doc_id, 'term' FROM undef) GROUP BY 1, 2""",
)

QUERIES, SQL = R.queries, R.sql
