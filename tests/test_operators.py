"""Operators on small rows: nulls, blanks, repeats, empty tables."""

import datetime as dt

from folioscope.operators import citations, findings, logs, numeric, panel, structure

B = "doc_id string, pos int, block_id string, kind string, text string, heading_level int, is_bibliography boolean, cell_rows array<array<string>>"
R = "rec_id bigint, doc_id string, seq int, entry_index int, key string, raw string, block_id string, title string, authors array<string>, year int, style string, metadata_status string, publication_status string"
M = "doc_id string, seq int, raw string, key string, block_id string"
FI = "id string, doc_id string, seq int, issue_type string, severity string, confidence double, block_ids array<string>, verbatim_quote string, quote_mode string, rationale string, checklist_id string, reviewer_id string, source string, suggested_fix string, verdict string, gate_passed boolean, recorded_at timestamp, received_at timestamp"
T = dt.datetime(2026, 1, 1)


def block(doc, pos, text, kind="paragraph", level=0, bib=False, cells=None):
    return (doc, pos, f"p{pos}", kind, text, level, bib, cells)


def finding(i, quote="q", blocks=("p1",), doc="d", seq=None, issue="clarity", sev="minor", conf=0.5, mode="contiguous", why="why", source="llm", fix="", verdict="confirmed", gate=True):
    return (f"F{i}", doc, seq if seq is not None else i, issue, sev, conf, list(blocks) if blocks is not None else None, quote, mode, why, "pre/claims", "r1", source, fix, verdict, gate, T, T)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_gate(spark):
    blocks = spark.createDataFrame([block("d", 1, "alpha  beta\tgamma"), block("d", 2, None), block("d", 2, None), block("d", 3, "delta, beta")], B)
    f = [
        finding(1, "alpha beta"), finding(2, "alpha betas"), finding(3, ""), finding(4, None), finding(5, "beta", ("p1", "p9")), finding(6, "beta", ()), finding(7, "beta", None), finding(8, "gamma, delta", ("p1", "p3"), mode="disjoint_parts"),
        finding(9, "gamma、omega", ("p1", "p3"), mode="disjoint_parts"), finding(10, "，", ("p1",), mode="disjoint_parts"), finding(11, "x", ("p2",)), finding(12, ",、", ("p1",), mode="disjoint_parts"), finding(12, ",、", ("p1",), mode="disjoint_parts"),
    ]
    got = {r.id: r.reason for r in findings.gate(spark.createDataFrame(f, FI), blocks).collect()}
    assert got == {"F1": "match", "F2": "quote-not-found", "F3": "empty", "F4": "empty", "F5": "block-not-found", "F6": "unanchored", "F7": "unanchored", "F8": "match", "F9": "quote-not-found", "F10": "quote-not-found", "F11": "quote-not-found", "F12": "no-part"}


def test_ranks_and_classes(spark):
    f = spark.createDataFrame([finding(1, conf=0.2), finding(2, conf=0.9), finding(3, sev="major", conf=0.1), finding(4, sev=None, conf=None), finding(5, conf=0.9, blocks=("p2", "p1")), finding(6, blocks=("p2",), doc="e"), finding(7, blocks=None)], FI)
    r = {x.id: x["rank"] for x in findings.ranks(f).collect()}
    assert sorted((r[k], k) for k in ("F1", "F2", "F3", "F4", "F5")) == sorted([(1, "F3"), (2, "F2"), (3, "F5"), (5, "F1"), (6, "F4")]) and r["F7"] == 4
    c = {x.id: x.class_id for x in findings.anchor_classes(f).collect()}
    assert c == {"F1": "F1", "F2": "F1", "F3": "F1", "F4": "F1", "F5": "F1", "F6": "F6", "F7": "F7"}
    chain = spark.createDataFrame([finding(i, blocks=(f"p{i}", f"p{i + 1}")) for i in range(10, 40)], FI)
    assert {x.class_id for x in findings.anchor_classes(chain).collect()} == {"F10"}


def test_findings_empty(spark):
    none, blocks = spark.createDataFrame([], FI), spark.createDataFrame([], B)
    for op in (findings.schema_errors, findings.ranks, findings.uids, findings.exact_duplicates, findings.relations, findings.anchor_classes, findings.collapsed, findings.edit_conflicts, findings.reviewer_status, findings.set_difference):
        assert op(none).count() == 0
    assert findings.gate(none, blocks).count() == 0 and findings.verified(none, blocks).count() == 0
    assert [(r.tp, r.precision, r.recall) for r in findings.scores(none).collect()] in ([], [(0, 1.0, 1.0)])


def test_citations(spark):
    entry = lambda i, n, key=None, doc="d": (i, doc, i, n, key or f"[{n}]", "raw", "b", None, None, None, None, None, None)
    records = spark.createDataFrame([entry(1, 1), entry(1, 1), entry(2, 3), entry(3, 3), entry(4, None, "noor|2001", "a"), entry(5, None, "Vos|1999", "a"), entry(6, None, None, "x")], R)
    marks = spark.createDataFrame([("d", 1, None, "3", "p1"), ("d", 2, None, "1, 5–4", "p2"), ("d", 3, None, None, None), ("a", 1, None, "noor|2001; abe|2002", "p1"), ("d", 2, None, "1, 5–4", "p2")], M)
    assert rows(citations.mark_numbers(marks).select("doc_id", "number")) == [("d", 1), ("d", 3), ("d", 4), ("d", 5)]
    assert rows(citations.unused(records, marks)) == [] and rows(citations.gaps(records)) == [("d", 2)] and rows(citations.duplicates(records)) == [("d", 3, 2)]
    assert rows(citations.missing(records, marks)) == [("d", 4, 1, "p2"), ("d", 5, 1, "p2")] and rows(citations.first_appearance(records, marks)) == [("d", 1, 3)]
    assert rows(citations.author_year_status(records, marks)) == [("a", "abe|2002", "missing"), ("a", "vos|1999", "unused")]
    assert rows(citations.citation_findings(spark.createDataFrame([], R), spark.createDataFrame([], M))) == []


def test_structure(spark):
    b = spark.createDataFrame(
        [
            block("d", 1, "1 Introduction", "heading", 1), block("d", 2, "See figure 2 and Table 1.1 by the XYZ."), block("d", 3, "3 Methods", "heading", 1), block("d", 4, "Figure 2. Described", "caption"), block("d", 5, "Table 1-1", "caption"),
            block("d", 6, "References", "heading", 1), block("d", 7, "[1] Some entry", "biblio_entry", bib=True), block("d", 8, None), block("d", 8, None), block("e", 1, "no headings", "paragraph"),
        ], B,
    )
    assert rows(structure.heading_gaps(b)) == [("d", "", 2)] and rows(structure.broken_references(b)) == [("d", "table", "1-1", 1)]
    assert rows(structure.required_sections(b)) == [("d", "related work"), ("e", "background,related work,methods,references")]
    assert rows(structure.undefined_acronyms(b).select("doc_id", "acronym")) == [("d", "XYZ")]
    assert {r.block_id for r in structure.bibliography_region(b).where("in_region").collect()} == {"p7", "p8"}
    assert rows(structure.sections(b).select("doc_id", "section_no", "n_blocks")) == [("d", 1, 2), ("d", 2, 3), ("d", 3, 3), ("e", 0, 1)]
    none = spark.createDataFrame([], B)
    for op in (structure.statistics, structure.sections, structure.outline, structure.captions, structure.references, structure.structure_findings, structure.tokens, structure.bibliography_region, numeric.cells, numeric.table_totals):
        assert op(none).count() == 0


def test_tables(spark):
    cells = [["group", "n"], ["a", "1,000"], ["b", "x"], ["Total", "1000"], [], ["c"]]
    b = spark.createDataFrame([block("d", 1, "t", "table", cells=cells), block("d", 2, "t", "table", cells=[]), block("d", 3, "t", "table")], B)
    assert rows(numeric.table_totals(b)) == [("d", "p1", "n", 1000.0, 1000.0, True)] and numeric.cells(b).count() == 7


def test_panel(spark):
    schema = "doc_id string, seq int, finding_id string, judge_model string, position string, verdict string, judged_at timestamp, arrived_at timestamp"
    votes = [("F1", "a", "claim_first", "yes"), ("F1", "a", "evidence first", "YES"), ("F1", "b ", "claim_first", "yes"), ("F1", "B", "evidence_first", "Yes"), ("F2", "a", "claim_first", "no"), ("F3", "a", "claim_first", "yes"), ("F3", "a", "claim_first", "no"), (None, None, None, None), ("F9", "a", "claim_first", "yes")]
    j = spark.createDataFrame([("d", i, *v, T, T) for i, v in enumerate(votes)], schema)
    f = spark.createDataFrame([finding(1), finding(2), finding(3), finding(4)], FI)
    assert {r.finding_id: r.verdict for r in panel.verdicts(j, f).collect()} == {"F1": "confirmed", "F2": "unverifiable", "F3": "unverifiable", "F4": "unverifiable"}
    assert rows(panel.errors(j, f)) == [("d", 6, "repeated"), ("d", 7, "unknown finding"), ("d", 8, "unknown finding")]
    assert {r.verdict: r.n for r in panel.summary(j, f).collect()} == {"confirmed": 1, "contested": 0, "refuted": 0, "unverifiable": 3}
    assert rows(panel.open_votes(j, f)) == [("F2", "a", "evidence_first"), ("F3", "a", "evidence_first")]


def test_sessions_over_midnight(spark):
    at = lambda h, m: dt.datetime(2026, 1, 1 + h // 24, h % 24, m)
    e = spark.createDataFrame([(1, at(23, 50), 7, "x", 1.0, ""), (2, at(24, 10), 7, "x", 1.0, ""), (3, at(26, 0), 7, "x", 1.0, ""), (4, at(1, 0), 8, "x", 1.0, "")], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    assert rows(logs.sessions(e).select("user_id", "session_no", "n")) == [(7, 1, 2), (7, 2, 1), (8, 1, 1)]


def test_running_values_over_stretches(spark):
    from pyspark.sql import functions as F

    from folioscope.operators.running import running_last, running_sum

    data = [("a", i, None if i % 5 else i) for i in range(40)] + [("b", 3, None), ("b", 9, 1)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    got = {(r.k, r.i): (r.last, r.total) for r in running_sum(running_last(df, "k", "i", F.col("v"), "last", 7), "k", "i", F.coalesce("v", F.lit(0)), "total", 7).collect()}
    assert got == {("a", i): (i - i % 5, sum(range(0, i + 1, 5))) for i in range(40)} | {("b", 3): (None, 0), ("b", 9): (1, 1)}


def test_duplicates_collapse_by_edges(spark):
    alike, other, akin = "the sample of seventeen patients stays unclear here", "figure labels overlap badly", "the sample of seventeen patients was never described anywhere"
    f = [
        finding(1, alike, ("p1", "p2"), conf=0.6), finding(2, alike + " indeed", ("p0", "p2"), conf=0.9), finding(3, other, ("p1",)), finding(4, akin, ("p2",), conf=0.7),
        finding(5, "same words", ("p7", "p8")), finding(6, "same words", ("p8", "p9"), source="deterministic"), finding(7, "same words", ("p5",)), finding(8, "alone", None), finding(8, "alone", None),
    ]
    got = {r.representative: r for r in findings.collapsed_duplicates(spark.createDataFrame(f, FI)).collect()}
    assert {k: r.n for k, r in got.items()} == {"F2": 2, "F3": 1, "F4": 1, "F5": 2, "F7": 1, "F8": 1}
    relation = {(r.a, r.b): r.relation for r in findings.relations(spark.createDataFrame(f, FI)).collect()}
    touched = sum(relation.get(p) == "supports" for p in (("F1", "F4"), ("F2", "F4")))
    assert touched and relation["F1", "F2"] == "duplicate" and got["F2"].support == 2 + touched and got["F2"].related == ["F2", "F3", "F4"]
    assert got["F2"].relation == "duplicate" and got["F5"].sources == "deterministic,llm" and got["F5"].related == ["F6"] and got["F8"].related == [] and got["F8"].relation is None
    assert findings.collapsed_duplicates(spark.createDataFrame([], FI)).count() == 0


def test_verify_gives_every_finding_its_representative(spark):
    blocks = spark.createDataFrame([block("d", 1, "alpha beta gamma delta epsilon zeta eta theta")], B)
    words = "alpha beta gamma delta epsilon zeta eta"
    f = [
        finding(1, words, conf=0.6), finding(2, words + " theta", conf=0.9), finding(3, "not there", conf=0.8), finding(4, "alpha", sev="other", conf=0.3), finding(5, "alpha", source="deterministic", gate=True, sev="major"),
        finding(6, "", conf=0.7), finding(7, words, conf=0.2), finding(8, "alpha", source="deterministic", gate=False, conf=0.1, why="x"),
    ]
    got = {r.id: (r.representative, r["rank"], r.status, r.error) for r in findings.verified_findings(spark.createDataFrame(f, FI), blocks).collect()}
    assert got == {
        "F1": ("F2", 2, "confirmed", None), "F2": ("F2", 2, "confirmed", None), "F3": ("F3", 3, "rejected", None), "F4": ("F4", 6, "rejected", "unknown severity"), "F5": ("F5", 1, "confirmed", None),
        "F6": ("F6", 7, "rejected", "blank quote"), "F7": ("F7", 4, "confirmed", None), "F8": ("F8", 5, "rejected", None),
    }
    assert findings.verified_findings(spark.createDataFrame([], FI), spark.createDataFrame([], B)).count() == 0


def test_ranks_of_a_thousand_and_more_show_in_full(spark):
    shown = {r["rank"]: r.display for r in findings.ranks(spark.createDataFrame([finding(i) for i in range(1, 1013)], FI)).collect()}
    assert shown == {k: f"F{k:03d}" for k in range(1, 1013)}
