"""Queries on panel votes."""

from __future__ import annotations

from folioscope.operators import panel as p
from folioscope.plans.registry import Registry

R = Registry()
J = r"""j AS (SELECT DISTINCT doc_id, seq, finding_id, lower(trim(judge_model)) AS judge, regexp_replace(lower(trim(position)), '[\s-]+', '_', 'g') AS position, regexp_replace(lower(trim(verdict)), '[\s-]+', '_', 'g') AS vote, judged_at, arrived_at FROM judgments)"""
E = """t AS (SELECT *, finding_id IN (SELECT id FROM findings) AS known, row_number() OVER (PARTITION BY finding_id, judge, position ORDER BY doc_id, seq) AS turn FROM j),
c AS (SELECT *, CASE WHEN NOT coalesce(known, false) THEN 'unknown finding' WHEN coalesce(judge, '') = '' THEN 'no judge' WHEN NOT coalesce(position IN ('claim_first', 'evidence_first'), false) THEN 'unknown position' WHEN NOT coalesce(vote IN ('yes', 'no', 'cannot_assess'), false) THEN 'unknown vote' WHEN turn > 1 THEN 'repeated' END AS error FROM t),
s AS (SELECT * FROM c WHERE error IS NULL)"""
V = """v AS (SELECT i.id AS finding_id, count(DISTINCT judge) AS n_judges, count(judge) AS n_votes, count(*) FILTER (vote = 'yes') AS n_yes, count(*) FILTER (vote = 'no') AS n_no, count(*) FILTER (vote = 'cannot_assess') AS n_ca FROM (SELECT DISTINCT id FROM findings) i LEFT JOIN s ON s.finding_id = i.id GROUP BY 1),
verdicts AS (SELECT finding_id, CASE WHEN n_judges < 2 OR n_votes < 2 * n_judges OR n_ca = n_votes THEN 'unverifiable' WHEN n_ca > 0 THEN 'contested' WHEN n_yes = n_votes THEN 'confirmed' WHEN n_no = n_votes THEN 'refuted' ELSE 'contested' END AS verdict, n_judges, n_votes, n_yes, n_no FROM v)"""
R.add("judgment_errors", "judgments findings", p.errors, f"WITH {J}, {E} SELECT doc_id, seq, error FROM c WHERE error IS NOT NULL")
R.add("panel_verdict", "judgments findings", p.verdicts, f"WITH {J}, {E}, {V} SELECT * FROM verdicts")
R.add("panel_summary", "judgments findings", p.summary, f"WITH {J}, {E}, {V} SELECT a.verdict, count(b.verdict) AS n FROM (SELECT unnest(['confirmed', 'contested', 'refuted', 'unverifiable']) AS verdict) a LEFT JOIN verdicts b ON a.verdict = b.verdict GROUP BY 1")
R.add("resume_pending", "judgments findings", p.open_votes, f"WITH {J}, {E} SELECT finding_id, judge, position FROM (SELECT DISTINCT finding_id, judge, unnest(['claim_first', 'evidence_first']) AS position FROM s) EXCEPT SELECT finding_id, judge, position FROM s")
R.add("latest_judgment", "judgments", p.latest, f"WITH {J} SELECT finding_id, judge, position, arg_max_null(vote, (judged_at, seq)) AS vote, count(*) AS n FROM j WHERE finding_id IS NOT NULL AND judge IS NOT NULL AND position IS NOT NULL GROUP BY 1, 2, 3")
R.add(
    "judge_rates", "judgments findings", p.judge_rates,
    f"WITH {J}, {E} SELECT judge, position, count(*) AS n, round(avg(CASE WHEN vote = 'yes' THEN 1.0 ELSE 0.0 END), 6) AS share_yes, round(avg(CASE WHEN vote = 'cannot_assess' THEN 1.0 ELSE 0.0 END), 6) AS share_abstained, round(avg(floor(epoch(arrived_at)) - floor(epoch(judged_at))), 3) AS mean_delay FROM s GROUP BY 1, 2",
)
R.add(
    "position_flips", "judgments findings", p.position_flips,
    f"WITH {J}, {E}, w AS (SELECT finding_id, judge, any_value(vote) FILTER (position = 'claim_first') AS a, any_value(vote) FILTER (position = 'evidence_first') AS b FROM s WHERE vote IN ('yes', 'no') GROUP BY 1, 2) SELECT judge, count(*) AS n_both, count(*) FILTER (a <> b) AS n_flipped FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
)

QUERIES, SQL = R.queries, R.sql
