"""Queries on the graph of findings, the full quote gate, comparisons of runs and lookups; numeric statements read from blocks."""

from __future__ import annotations

from folioscope.operators import extraction as x
from folioscope.operators import gate as g
from folioscope.operators import graph as q
from folioscope.operators import reading as d
from folioscope.plans.findings import DET, FI, NORM, PLAIN
from folioscope.plans.registry import Registry

R = Registry()
R.add("finding_edges", "findings", q.edges)
R.add("finding_components", "findings", q.components)
R.add("finding_clusters", "findings", q.collapsed)
R.add(
    "gate_finding", "findings blocks", g.gated,
    f"""WITH {FI}, q AS (SELECT id, doc_id, confidence, coalesce(verbatim_quote, '') AS quote, coalesce(quote_mode, '') = 'disjoint_parts' AS parted, coalesce(block_ids, []) AS ids FROM f),
b AS (SELECT DISTINCT doc_id, block_id, {NORM.format("coalesce(text, '')")} AS text FROM blocks),
p AS (SELECT *, CASE WHEN parted THEN list_filter(list_transform(string_split_regex(quote, '[、,]'), lambda y: {NORM.format('y')}), lambda y: y <> '') ELSE [{NORM.format('quote')}] END AS parts FROM q),
u AS (SELECT id, doc_id, ids, unnest(parts) AS part FROM p),
h AS (SELECT u.id, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.doc_id = u.doc_id AND (len(u.ids) = 0 OR list_contains(u.ids, b.block_id)) AND contains(b.text, u.part))) AS hits FROM u GROUP BY 1),
k AS (SELECT p.*, len(parts) AS n, coalesce(h.hits, 0) AS hits, len(list_filter(ids, lambda i: i IS NOT NULL)) < len(ids) OR EXISTS (SELECT 1 FROM (SELECT unnest(ids) AS i) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = p.doc_id AND b.block_id = i)) AS unknown FROM p LEFT JOIN h ON h.id = p.id),
r AS (SELECT *, CASE WHEN quote = '' THEN 'no-quote' WHEN unknown THEN 'block-not-found' WHEN parted AND n > 0 AND hits = n THEN 'all-parts-match ' || hits || '/' || n WHEN parted THEN 'partial-match ' || hits || '/' || n WHEN hits = n THEN 'exact-match' ELSE 'quote-not-found' END AS reason FROM k)
SELECT id, reason IN ('no-quote', 'exact-match') OR starts_with(reason, 'all-parts') AS passed, reason, CASE WHEN reason IN ('no-quote', 'exact-match') OR starts_with(reason, 'all-parts') THEN confidence ELSE least(confidence, 0.3) END AS confidence FROM r""",
)
R.add(
    "run_difference", "findings", g.compared_runs,
    f"""WITH {FI}, a AS (SELECT *, lower(trim(coalesce(nullif(issue_type, ''), 'other'))) AS i FROM f WHERE coalesce(gate_passed, true) AND coalesce(verdict, 'confirmed') <> 'unverifiable'),
d AS (SELECT doc_id, source IS NOT DISTINCT FROM 'deterministic' AS old, i, coalesce({DET.split("coalesce(", 1)[1].rsplit(", lower(", 1)[0]}, lower(trim(coalesce(nullif(source, ''), nullif(checklist_id, ''), 'other')))) AS det, array_to_string(list_sort(coalesce(block_ids, [])), ',') AS bl, {PLAIN.format("coalesce(verbatim_quote, '')")} AS q, left({PLAIN.format("coalesce(rationale, '')")}, 240) AS s, CASE severity WHEN 'major' THEN 0 WHEN 'nit' THEN 2 ELSE 1 END AS sev FROM a),
k AS (SELECT doc_id, concat_ws('|', det, i, bl, q, s) AS fingerprint, concat_ws('|', det, i, s) AS family, count(*) FILTER (old) AS n_before, count(*) FILTER (NOT old) AS n_after, min(sev) FILTER (old) AS s_before, min(sev) FILTER (NOT old) AS s_after FROM d GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, family, n_before > 0 ORDER BY fingerprint) AS turn FROM k WHERE n_before = 0 OR n_after = 0),
m AS (SELECT x.doc_id, x.fingerprint, y.fingerprint AS moved_to, x.n_before, y.n_after, x.family, x.turn FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.family = y.family AND x.turn = y.turn WHERE x.n_before > 0 AND y.n_after > 0)
SELECT doc_id, fingerprint, NULL AS moved_to, n_before, n_after, CASE WHEN n_after > n_before THEN 'worsened' WHEN n_after < n_before THEN 'resolved' WHEN s_after < s_before THEN 'worsened' ELSE 'unchanged' END AS status FROM k WHERE n_before > 0 AND n_after > 0
UNION ALL SELECT doc_id, fingerprint, moved_to, n_before, n_after, 'moved' FROM m
UNION ALL SELECT doc_id, fingerprint, NULL, n_before, n_after, CASE WHEN n_before > 0 THEN 'resolved' ELSE 'new' END FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = o.doc_id AND m.family = o.family AND m.turn = o.turn)""",
)
VARIANTS = r"""list_filter(list_distinct([lower(trim({0})), regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[.,;)\]}}]+$', ''), '^https?://(?:dx\.)?doi\.org/', ''), '^(?:doi:|arxiv:|pmid:)\s*', '')]), lambda x: x <> '')"""
R.add(
    "metadata_lookup", "citation_records resolver_metadata", g.looked_up,
    rf"""WITH r AS (SELECT DISTINCT rec_id, coalesce(nullif(doi, ''), nullif(regexp_extract(raw, '(?i)(10\.\d{{4,9}}/[^\s"<>]+)', 1), '')) AS v0, nullif(regexp_extract(raw, '(?i)(?:arxiv:\s*)?\b(\d{{4}}\.\d{{4,5}})(?:v\d+)?\b', 1), '') AS v1, nullif(regexp_extract(raw, '(?i)\bpmid:?\s*(\d{{4,9}})', 1), '') AS v2 FROM citation_records),
a AS (SELECT rec_id, 0 AS turn, 'doi' AS found_by, v0 AS v FROM r UNION ALL SELECT rec_id, 1, 'arxiv', v1 FROM r UNION ALL SELECT rec_id, 2, 'pmid', v2 FROM r), k AS (SELECT rec_id, turn, found_by, unnest({VARIANTS.format('v')}) AS key FROM a WHERE v IS NOT NULL),
w AS (SELECT DISTINCT identifier, unnest(list_concat({VARIANTS.format("coalesce(identifier, '')")}, {VARIANTS.format("coalesce(doi, '')")})) AS key FROM resolver_metadata)
SELECT rec_id, arg_min(identifier, (turn, identifier)) AS identifier, arg_min(found_by, (turn, identifier)) AS found_by FROM k JOIN w USING (key) GROUP BY 1""",
)
ONE = lambda name, pattern: f"""SELECT doc_id, block_id, '{name}' AS pattern, unnest(regexp_extract_all(text, '{pattern}', 1)) AS author, unnest(regexp_extract_all(text, '{pattern}', 2)) AS year, unnest(range(1, len(regexp_extract_all(text, '{pattern}', 1)) + 1)) AS place FROM b"""
R.add(
    "author_year_citations", "blocks", d.author_year_citations,
    f"""WITH b AS (SELECT DISTINCT doc_id, block_id, text FROM blocks WHERE NOT is_bibliography AND kind <> 'biblio_entry' AND text IS NOT NULL), m AS ({" UNION ALL ".join(ONE(n, p.replace("'", "''")) for n, p in d.AUTHOR_YEAR.items())})
SELECT doc_id, block_id, pattern, CAST(place AS INT) AS place, lower(trim(regexp_replace(string_split_regex(author, '{d.FIRST_AUTHOR}')[1], '{d.ET_AL}', ''), ' .') || '|' || year) AS key FROM m""",
)
R.add(
    "headings_by_look", "blocks", d.headings_by_look,
    rf"""WITH b AS (SELECT DISTINCT doc_id, block_id, trim(text) AS t FROM blocks WHERE kind IN ('paragraph', 'list_item') AND trim(text) <> ''), n AS (SELECT *, regexp_extract(t, '^(\d+(?:[.\-]\d+)*)', 1) AS num FROM b),
l AS (SELECT doc_id, block_id, CAST(CASE WHEN length(t) > 180 THEN NULL WHEN regexp_matches(t, '{d.NAMED}') THEN 1 WHEN regexp_matches(t, '{d.NUMBERED}') THEN CASE WHEN NOT regexp_matches(t, '{d.SENTENCE_END}') THEN length(num) - length(regexp_replace(num, '[.\-]', '', 'g')) + 1 END WHEN length(t) <= 90 AND regexp_matches(t, '{d.CAPITALS}') THEN 1 END AS INT) AS level FROM n) SELECT * FROM l WHERE level IS NOT NULL""",
)
R.add(
    "id_variants", "resolver_metadata", d.work_identifiers,
    f"""WITH w AS (SELECT DISTINCT identifier, doi FROM resolver_metadata) SELECT identifier, unnest(list_distinct(list_concat({VARIANTS.format("coalesce(identifier, '')")}, {VARIANTS.format("coalesce(doi, '')")}))) AS variant FROM w""",
)
R.add("reference_fields", "citation_records", d.reference_fields)
R.add("numeric_facts", "blocks", x.facts)
R.add("value_conflicts", "blocks", lambda b: x.value_conflicts(x.facts(b)))
R.add("f1_check", "blocks", lambda b: x.f1_conflicts(x.facts(b)))
R.add("p_claim", "blocks", lambda b: x.claim_conflicts(x.facts(b)))
R.add("total_check", "blocks", lambda b: x.total_conflicts(x.facts(b)))
R.add("numeric_issues", "blocks", x.numeric_issues)

QUERIES, SQL = R.queries, R.sql
