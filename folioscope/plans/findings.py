"""Queries on findings."""

from __future__ import annotations

from folioscope.functions.text import WS
from folioscope.operators import findings as f
from folioscope.plans.registry import Registry
from folioscope.sources.reports import markdown

R = Registry()
FI = "f AS (SELECT DISTINCT * FROM findings)"
NORM = f"trim(regexp_replace({{}}, '{WS.replace('{', '{{').replace('}', '}}')}+', ' ', 'g'))"
WORDS = r"list_sort(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '([\p{{L}}\p{{N}}]{{2,}}|[\x{{4e00}}-\x{{9fff}}])', 1)))"
PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
SEV = "CASE severity WHEN 'major' THEN 0 WHEN 'minor' THEN 1 WHEN 'nit' THEN 2 ELSE 3 END"
GATE = f"""x AS (SELECT f.id, coalesce(f.verbatim_quote, '') AS quote, f.quote_mode, u.block_id, b.text, b.block_id IS NOT NULL AS known FROM f LEFT JOIN (SELECT id, unnest(block_ids) AS block_id FROM f) u ON f.id = u.id LEFT JOIN (SELECT DISTINCT doc_id, block_id, {NORM.format("coalesce(text, '')")} AS text FROM blocks) b ON b.doc_id = f.doc_id AND b.block_id = u.block_id),
gate AS (SELECT id, CASE WHEN any_value(quote) = '' THEN 'empty' WHEN count(block_id) = 0 THEN 'unanchored' WHEN bool_or(block_id IS NOT NULL AND NOT known) THEN 'block-not-found' WHEN bool_or(contains(text, {NORM.format('quote')})) THEN 'match' ELSE 'quote-not-found' END AS reason FROM x GROUP BY 1)"""
ERRORS = f"""err AS (SELECT id, CASE WHEN coalesce(trim(doc_id), '') = '' THEN 'no document' WHEN coalesce(len(block_ids), 0) < 1 THEN 'no block' WHEN coalesce({NORM.format('verbatim_quote')}, '') = '' THEN 'blank quote' WHEN severity IS NULL OR severity NOT IN ('major', 'minor', 'nit') THEN 'unknown severity'
WHEN confidence IS NULL OR confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' WHEN rationale IS NULL THEN 'no rationale' WHEN received_at < recorded_at THEN 'received before recorded' END AS error FROM f)"""
EXACT = f"""k AS (SELECT id, doc_id, issue_type, {NORM.format("coalesce(verbatim_quote, '')")} AS quote, array_to_string(list_sort(block_ids), ',') AS blocks, source, confidence FROM f),
exact AS (SELECT id, first_value(id) OVER (PARTITION BY doc_id, issue_type, quote, blocks ORDER BY CASE WHEN source <> 'deterministic' THEN 1 ELSE 0 END, -coalesce(confidence, 0), id) AS kept, count(*) OVER (PARTITION BY doc_id, issue_type, quote, blocks) AS n FROM k)"""

R.add("evidence_gate", "findings blocks", f.gate, f"WITH {FI}, {GATE} SELECT id, reason IN ('empty', 'match') AS passed, reason FROM gate")
R.add("schema_errors", "findings", f.schema_errors, f"WITH {FI}, {ERRORS} SELECT id, error FROM err WHERE error IS NOT NULL")
R.add("severity_counts", "findings", f.severity_counts, f"WITH {FI} SELECT severity, verdict, count(*) AS n FROM f GROUP BY CUBE (severity, verdict)")
R.add("coverage", "findings", f.coverage, f"WITH {FI}, c AS (SELECT doc_id, string_split(checklist_id, '/')[-1] AS chk FROM f) SELECT doc_id, count(DISTINCT chk) AS n_checks, round(count(DISTINCT chk) / (SELECT count(DISTINCT chk) FROM c), 6) AS share, count(*) AS n_findings FROM c GROUP BY 1")
R.add("finding_rank", "findings", f.ranks, f"WITH {FI}, r AS (SELECT id, row_number() OVER (PARTITION BY doc_id ORDER BY {SEV}, coalesce(confidence, 0) DESC, seq) AS rank FROM f) SELECT id, rank, 'F' || CASE WHEN rank < 1000 THEN lpad(CAST(rank AS VARCHAR), 3, '0') ELSE CAST(rank AS VARCHAR) END AS display FROM r")
DET = "coalesce(" + ", ".join(f"CASE WHEN starts_with(i, '{k}') THEN '{v}' END" for k, v in f.DETECTORS.items()) + ", lower(coalesce(source, '')))"
R.add(
    "stable_uid", "findings", f.uids,
    f"""WITH {FI}, p AS (SELECT *, lower(trim(coalesce(issue_type, ''))) AS i, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(block_ids, []), lambda b: trim(b)), lambda b: b <> ''))), ',') AS bl FROM f)
SELECT id, 'fd_' || left(sha256(concat_ws(chr(31), i, lower({NORM.format("coalesce(checklist_id, '')")}), bl, '', '', {NORM.format("coalesce(verbatim_quote, '')")}, CASE WHEN bl = '' THEN {NORM.format("coalesce(rationale, '')")} ELSE '' END)), 24) AS uid,
left(sha256(concat_ws('|', {DET}, i, bl, {PLAIN.format("coalesce(verbatim_quote, '')")}, left({PLAIN.format("coalesce(rationale, '')")}, 240))), 24) AS fingerprint FROM p""",
)
R.add("exact_dedupe", "findings", f.exact_duplicates, f"WITH {FI}, {EXACT} SELECT id, kept, n FROM exact")
POL = lambda t: f"CASE WHEN list_has_any({WORDS.format(t)}, {f.NEGATIVE}) THEN -1 WHEN list_has_any({WORDS.format(t)}, {f.POSITIVE}) THEN 1 ELSE 0 END"
JAC = lambda a, b: f"round(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 6)"
R.add(
    "edge_relation", "findings", f.relations,
    f"""WITH {FI}, u AS (SELECT doc_id, id, seq, unnest(list_distinct(block_ids)) AS block_id FROM f), pr AS (SELECT DISTINCT a.id AS a, b.id AS b FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.block_id = b.block_id AND a.seq < b.seq),
s AS (SELECT id, issue_type, list_distinct(block_ids) AS bl, concat_ws(' ', verbatim_quote, rationale) AS said FROM f),
t AS (SELECT a, b, {JAC('l.bl', 'r.bl')} AS location, coalesce({JAC(WORDS.format('l.said'), WORDS.format('r.said'))}, 0.0) AS text, {POL('l.said')} * {POL('r.said')} < 0 AS opposed, l.issue_type = r.issue_type AS same FROM pr JOIN s l ON l.id = a JOIN s r ON r.id = b WHERE l.said <> r.said)
SELECT a, b, location, text, CASE WHEN opposed AND text >= 0.38 THEN 'contradicts' WHEN same AND text >= 0.55 THEN 'duplicate' WHEN text >= 0.45 THEN 'supports' WHEN same THEN 'same_root_cause' ELSE 'co_located' END AS relation FROM t""",
)
R.add(
    "components", "findings", f.anchor_classes,
    f"""WITH RECURSIVE {FI}, u AS (SELECT DISTINCT id, doc_id || '/' || unnest(block_ids) AS spot FROM f), e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM u a JOIN u b USING (spot)),
reach AS (SELECT id AS x, id AS y FROM f UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x) SELECT x AS id, min(y) AS class_id FROM reach GROUP BY 1""",
)
R.add(
    "cluster_collapse", "findings", f.collapsed,
    f"WITH {FI} SELECT arg_min(id, (-coalesce(confidence, 0), {SEV}, seq, id)) AS representative, count(*) AS n, count(DISTINCT reviewer_id) AS n_reviewers, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max(confidence) AS top_confidence FROM (SELECT *, list_min(block_ids) AS anchor FROM f) GROUP BY doc_id, issue_type, anchor",
)
R.add("duplicate_collapse", "findings", f.collapsed_duplicates)
R.add("edit_conflicts", "findings", f.edit_conflicts, f"WITH {FI}, u AS (SELECT doc_id, id, unnest(list_distinct(block_ids)) AS block_id FROM f WHERE trim(suggested_fix) <> '') SELECT doc_id, block_id, count(*) AS n_findings, min(id) AS first_id FROM u GROUP BY 1, 2 HAVING count(*) > 1")
R.add(
    "regression_diff", "findings", f.set_difference,
    f"""WITH {FI}, g AS (SELECT doc_id, issue_type, checklist_id, count(*) FILTER (source = 'deterministic') AS n_before, count(*) FILTER (source <> 'deterministic') AS n_after FROM f GROUP BY 1, 2, 3)
SELECT *, CASE WHEN n_after = 0 THEN 'resolved' WHEN n_before = 0 THEN 'new' WHEN n_after > n_before THEN 'worsened' WHEN n_after < n_before THEN 'improved' ELSE 'unchanged' END AS status FROM g""",
)
R.add(
    "role_status", "findings", f.reviewer_status,
    f"WITH {FI} SELECT reviewer_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (gate_passed) AS n_passed, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (floor(epoch(received_at)) - floor(epoch(recorded_at)) > 86400) AS late FROM f GROUP BY 1",
)
R.add(
    "prf_by_type", "findings", f.scores,
    f"""WITH {FI}, g AS (SELECT issue_type, coalesce(gate_passed, false) AS p, coalesce(verdict = 'confirmed', false) AS g FROM f), s AS (SELECT issue_type, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM g GROUP BY ROLLUP (issue_type)),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn > 0 THEN 0.0 ELSE 1.0 END AS p0, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r0 FROM s)
SELECT issue_type, tp, fp, fn, round(p0, 4) AS precision, round(r0, 4) AS recall, round(CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END, 4) AS f1 FROM q""",
)
R.add(
    "gold_compat", "findings", f.gold_compatible,
    f"""WITH {FI}, g AS (SELECT * FROM f WHERE source = 'deterministic' AND verdict = 'confirmed'), p AS (SELECT * FROM f WHERE source <> 'deterministic'), k AS (SELECT doc_id, issue_type FROM g UNION SELECT doc_id, issue_type FROM p)
SELECT k.doc_id, k.issue_type, (SELECT count(*) FROM g WHERE g.doc_id = k.doc_id AND g.issue_type = k.issue_type) AS n_gold, (SELECT count(*) FROM p WHERE p.doc_id = k.doc_id AND p.issue_type = k.issue_type) AS n_predicted,
(SELECT count(*) FROM g WHERE g.doc_id = k.doc_id AND g.issue_type = k.issue_type AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = g.doc_id AND p.issue_type = g.issue_type AND list_has_any(p.block_ids, g.block_ids))) AS n_compatible FROM k""",
)
R.add(
    "verify_pipeline", "findings blocks", f.verified,
    f"""WITH {FI}, {GATE}, {EXACT}, {ERRORS} SELECT f.doc_id, f.severity, count(*) AS n, count(*) FILTER (reason IN ('empty', 'match')) AS n_passed, count(*) FILTER (reason IN ('empty', 'match') AND kept = f.id) AS n_kept, count(*) FILTER (error IS NOT NULL) AS n_unsound
FROM f JOIN gate ON f.id = gate.id JOIN exact ON f.id = exact.id JOIN err ON f.id = err.id GROUP BY 1, 2""",
)
R.add("verify_findings", "findings blocks", f.verified_findings)

R.add(
    "report", "findings", markdown,
    f"""WITH {FI}, l AS (SELECT doc_id, {SEV} AS s, -coalesce(confidence, 0) AS c, seq, '- **' || coalesce(severity, '?') || '** ' || coalesce(issue_type, 'other') || ' (' || coalesce(array_to_string(block_ids, ', '), '?') || '): ' || {NORM.format("coalesce(rationale, verbatim_quote, '')")} AS line FROM f)
SELECT doc_id, count(*) AS n, '# ' || doc_id || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY s, c, seq, line) AS report FROM l GROUP BY 1""",
)

QUERIES, SQL = R.queries, R.sql
