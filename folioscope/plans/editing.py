"""Queries on text spans, edits and matches."""

from __future__ import annotations

from folioscope.functions.text import WS
from folioscope.operators import editing as e
from folioscope.operators.structure import BIBLIOGRAPHY
from folioscope.plans.registry import Registry

R = Registry()
NORM = lambda x: f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"
WORDS = r"list_sort(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '([\p{{L}}\p{{N}}]{{2,}}|[\x{{4e00}}-\x{{9fff}}])', 1)))"
TITLE = r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'))"

R.add("sentence_claim", "marks blocks", e.claims)
R.add("chunks", "blocks", e.chunks)
PROPOSALS = """f AS (SELECT DISTINCT id, doc_id, block_ids[1] AS block_id, coalesce(verbatim_quote, '') AS quote, suggested_fix FROM findings WHERE trim(suggested_fix) <> ''),
j AS (SELECT f.*, b.text, (length(text) - length(replace(text, quote, ''))) / nullif(length(quote), 0) AS times, count(*) OVER (PARTITION BY f.doc_id, f.block_id) AS owners FROM f LEFT JOIN (SELECT DISTINCT doc_id, block_id, text FROM blocks) b ON b.doc_id = f.doc_id AND b.block_id = f.block_id),
s AS (SELECT *, CASE WHEN text IS NULL THEN 'unknown block' WHEN quote = '' THEN 'no quote' WHEN times = 0 THEN 'stale' WHEN times > 1 THEN 'ambiguous' WHEN owners > 1 THEN 'conflict' ELSE 'ready' END AS status FROM j)"""
R.add(
    "edit_proposals", "findings blocks", e.proposals,
    f"WITH {PROPOSALS} SELECT id, block_id, status, CASE WHEN status = 'ready' THEN CAST(strpos(text, quote) - 1 AS INT) END AS start, CASE WHEN status = 'ready' THEN text[:strpos(text, quote) - 1] || '[' || suggested_fix || ']' || text[strpos(text, quote) + length(quote):] END AS new_text FROM s",
)
R.add("edit_diff", "findings blocks", lambda f, b: e.differences(e.proposals(f, b), b, f))
R.add("best_title", "citation_records resolver_metadata", e.best_titles)
R.add("normal_text", "findings", e.normal_texts)
R.add(
    "support_status", "citation_records resolver_metadata", e.supports,
    f"""WITH r AS (SELECT DISTINCT rec_id, title, {TITLE} AS k FROM citation_records), w AS (SELECT DISTINCT identifier, abstract, {TITLE} AS k FROM resolver_metadata),
j AS (SELECT rec_id, identifier, abstract, round(len(list_intersect({WORDS.format('r.title')}, {WORDS.format('abstract')})) / len({WORDS.format('r.title')}), 6) AS overlap FROM r JOIN w ON r.k = w.k WHERE r.k <> '')
SELECT rec_id, identifier, overlap, CASE WHEN abstract IS NULL THEN 'uncertain' WHEN overlap >= 0.55 THEN 'supported' WHEN overlap >= 0.2 THEN 'partly' ELSE 'unsupported' END AS status FROM j""",
)
R.add(
    "match_tp", "findings", e.matched_labels,
    "WITH f AS (SELECT DISTINCT id, doc_id, issue_type, list_min(block_ids) AS anchor, source FROM findings), g AS (SELECT doc_id, issue_type, anchor, count(*) FILTER (source = 'deterministic') AS n_gold, count(*) FILTER (source <> 'deterministic') AS n_found FROM f GROUP BY 1, 2, 3) SELECT *, least(n_gold, n_found) AS n_matched FROM g",
)
R.add("match_gold", "findings", e.matched_gold)
R.add("prf_matched", "findings", e.matched_scores)
R.add(
    "distinct_ordered", "blocks", e.distinct_words,
    r"""WITH b AS (SELECT DISTINCT doc_id, block_id, text FROM blocks), w AS (SELECT doc_id, block_id, regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{N}]+)', 1) AS ws FROM b),
u AS (SELECT doc_id, block_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM w), f AS (SELECT doc_id, block_id, word, min(place) AS place FROM u GROUP BY 1, 2, 3), g AS (SELECT doc_id, block_id, string_agg(word, ' ' ORDER BY place) AS words FROM f GROUP BY 1, 2)
SELECT b.doc_id, b.block_id, coalesce(g.words, '') AS words FROM b LEFT JOIN g ON g.doc_id = b.doc_id AND g.block_id = b.block_id""",
)
R.add(
    "section_path", "blocks", e.section_paths,
    rf"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (SELECT DISTINCT doc_id, pos, block_id, trim(text) AS title, heading_level, coalesce(regexp_matches(trim(text), '{BIBLIOGRAPHY}'), false) AS bib FROM blocks WHERE kind = 'heading' AND heading_level BETWEEN 1 AND 3)),
s AS (SELECT doc_id, block_id, k, bib, title, CASE WHEN bib THEN [] ELSE [title] END AS stack FROM h WHERE k = 1
UNION ALL SELECT h.doc_id, h.block_id, h.k, h.bib, h.title, CASE WHEN h.bib THEN s.stack ELSE list_append(s.stack[:h.heading_level - 1], h.title) END FROM s JOIN h ON h.doc_id = s.doc_id AND h.k = s.k + 1)
SELECT doc_id, block_id, array_to_string(CASE WHEN bib THEN list_append(stack, title) ELSE stack END, ' > ') AS path FROM s""",
)
R.add(
    "author_token", "citation_records", e.author_tokens,
    r"WITH r AS (SELECT DISTINCT rec_id, authors[1] AS first FROM citation_records WHERE len(authors) > 0), w AS (SELECT rec_id, regexp_extract_all(lower(CASE WHEN contains(first, ',') THEN split_part(first, ',', 1) ELSE first END), '([\p{L}]+)', 1) AS ws FROM r) SELECT rec_id, ws[-1] AS token FROM w",
)

QUERIES, SQL = R.queries, R.sql
