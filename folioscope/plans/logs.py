"""Queries on logs, sets and tables at large."""

from __future__ import annotations

from folioscope.operators import logs as g
from folioscope.plans.registry import Registry

R = Registry()
R.add(
    "line_sessionize", "events", g.sessions,
    """WITH a AS (SELECT *, coalesce(CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END, 1) AS s0, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(CASE WHEN before IS NULL THEN 1 ELSE s0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM a)
SELECT user_id, session_no, count(*) AS n, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS seconds FROM b GROUP BY 1, 2""",
)
R.add("event_windows", "events", g.hourly, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
R.add("latest_decision", "events", g.last_rows, "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY 1")
R.add("json_recover", "events", g.recovered_json, r"SELECT event_type, try_cast(json_extract_string(regexp_extract(props, '(?s)(\{.*\})', 1), '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
R.add(
    "late_rows", "citation_records findings", g.late_rows,
    """WITH r AS (SELECT DISTINCT rec_id, doc_id, ingested_at FROM citation_records), s AS (SELECT *, min(ingested_at) OVER (PARTITION BY doc_id) AS start FROM r),
a AS (SELECT doc_id, count(*) AS n_records, count(*) FILTER (epoch_us(ingested_at) - epoch_us(start) > 604800000000) AS n_late FROM s GROUP BY 1), f AS (SELECT doc_id, count(DISTINCT id) AS n_findings FROM findings GROUP BY 1)
SELECT a.doc_id, n_records, coalesce(n_findings, 0) AS n_findings, n_late FROM a LEFT JOIN f ON a.doc_id = f.doc_id""",
)
R.add("set_except", "blocks marks", g.only_in_body, r"SELECT DISTINCT doc_id, block_id FROM blocks WHERE NOT is_bibliography AND regexp_matches(text, '\[\d') EXCEPT SELECT doc_id, block_id FROM marks")
R.add("set_intersect", "blocks findings documents", g.shared_manuscripts, "SELECT doc_id FROM blocks INTERSECT SELECT doc_id FROM findings INTERSECT SELECT ms_id FROM documents WHERE ms_id IS NOT NULL")
R.add(
    "document_profile", "documents", g.document_profile,
    "WITH d AS (SELECT DISTINCT doc_id, doc_kind, text FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY text) AS k FROM d) SELECT doc_kind, count(*) AS n, count(*) FILTER (text IS NULL) AS n_null, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars, count(*) FILTER (text IS NOT NULL AND k > 1) AS n_equal FROM c GROUP BY 1",
)
R.add("order_summary", "lineitem orders", g.order_summary, "SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")

QUERIES, SQL = R.queries, R.sql
