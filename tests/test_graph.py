import random

import duckdb

from folioscope.operators import extraction as x
from folioscope.operators import gate as g
from folioscope.operators import graph as q
from folioscope.operators.citations import gaps, mark_numbers
from folioscope.operators.editing import section_paths
from folioscope.operators.findings import ranks
from folioscope.operators.structure import heading_gaps, heading_numbers
from folioscope.plans import editing as editing_plans
from folioscope.plans import findings as finding_plans
from folioscope.plans import graph as plans
from folioscope.plans import structure as structure_plans

F = "id string, doc_id string, seq int, issue_type string, severity string, confidence double, block_ids array<string>, verbatim_quote string, rationale string, evidence_refs array<string>, reviewer_id string, reviewer_ids array<string>, source string, quote_mode string, checklist_id string, gate_passed boolean, verdict string, text string"
B = "doc_id string, pos int, block_id string, kind string, text string, heading_level int, is_bibliography boolean, cell_rows array<array<string>>"


def finding(i, doc="d", issue="numeric_x", severity="minor", conf=0.8, blocks=("p1",), quote="", why="", refs=(), reviewer="r1", source="reviewer", mode=None, passed=True, verdict="confirmed"):
    return (f"F{i:04d}", doc, i, issue, severity, conf, None if blocks is None else list(blocks), quote, why, list(refs), reviewer, [], source, mode, None, passed, verdict, "clash")


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    want = con.execute(sql).df()
    got = df.toPandas()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda d: sorted(repr([None if v != v else v for v in r]) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
    return got


def naive_edge(a, b):
    """One pair by the rules as the survey states them, from the rows."""
    la, lb = {z for z in a[6] or [] if z}, {z for z in b[6] or [] if z}
    loc = len(la & lb) / len(la | lb) if la and lb else 0.0
    if not loc:
        return None
    parts = lambda r: [z for z in (r[7], r[8], *r[9]) if q.normal(z)]
    pa, pb = parts(a), parts(b)
    like = lambda s, t: q.likeness(q.normal(s), q.normal(t))
    text = max([w * like(s, t) for w, s, t in zip((1, 0.85), pa, pb)] + ([0.75 * like(" ".join(pa[2:]), " ".join(pb[2:]))] if len(pa) > 2 and len(pb) > 2 else []) + [0.0])
    ra, rb = {q.normal(z) for z in a[9]} - {""}, {q.normal(z) for z in b[9]} - {""}
    ev = len(ra & rb) / len(ra | rb) if ra and rb else 0.0
    (ya, na), (yb, nb) = q.polarity(" ".join(pa)), q.polarity(" ".join(pb))
    ma, mb = ({n.replace(" ", "") for n in q.NUMBER.findall(" ".join(p))} for p in (pa, pb))
    same, sure = a[3] == b[3], min(a[5], b[5]) >= 0.55
    against = (ya and nb or na and yb or bool(ma and mb and not ma & mb and text >= 0.38)) and not (text < 0.28 and ev < 0.25)
    if against and (same or text >= 0.45 or ev >= 0.4):
        return "contradicts"
    equal = lambda k: q.normal(a[k]) and q.normal(a[k]) == q.normal(b[k])
    if same and (equal(7) or text >= 0.93 and sure or equal(8) and ev >= 0.25):
        return "duplicate"
    if same and sure and 0.45 <= max(text, ev) < 0.93:
        return "supports"
    return "same_root_cause" if not same and (text >= 0.42 or ev >= 0.5) else None


def test_edges_against_all_pairs(spark):
    r = random.Random(3)
    said = ["the effect is significant", "the effect is not significant", "the effect is significant here", "mean 4.2 was reported", "mean 5.1 was reported", "缺失 说明", "", None, "rows disagree with the total", "rows agree with the total"]
    rows = [finding(i, doc=r.choice("de"), issue=r.choice(["numeric_x", "stats_y"]), conf=r.choice([0.3, 0.6, 0.9]), blocks=r.choice([["p1"], ["p1", "p2"], ["p2"], [], None, ["p3"]]), quote=r.choice(said), why=r.choice(said), refs=r.choice([[], ["Table 1"], ["Table 1", "Fig 2"], [""]])) for i in range(160)]
    df = spark.createDataFrame(rows + rows[:5], F)
    firsts = {n.id: n.first for n in q.nodes(df).collect()}
    got = {(e.a, e.b): e.relation for e in q.edges(df).collect()}
    want = {(a[0], b[0]): rel for k, a in enumerate(rows) for b in rows[k + 1 :] if a[1] == b[1] and (rel := naive_edge(a, b))}
    for (a, b), rel in want.items():
        fa, fb = firsts[a], firsts[b]
        if fa != fb:
            assert got[min(fa, fb), max(fa, fb)] == rel
        elif fa == a:
            assert got[a, b] == rel
    assert all((a, b) in want for a, b in got) and len(set(got.values())) == 4

    parent = {f[0]: f[0] for f in rows}

    def find(z):
        while parent[z] != z:
            z = parent[z]
        return z

    for (a, b), rel in want.items():
        if rel == "duplicate":
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {c.id: c.class_id for c in q.components(df).collect()} == {z: find(z) for z in parent}
    c = q.collapsed(df).collect()
    assert sum(z.n for z in c) == len(rows) and len(c) == len({find(z) for z in parent})


def test_many_copies_on_one_block(spark):
    rows = [finding(i, quote="copied words on one block") for i in range(400)]
    df = spark.createDataFrame(rows, F)
    assert q.edges(df).count() == 399 and {c.n for c in q.collapsed(df).collect()} == {400}


def test_empty_graph(spark):
    none = spark.createDataFrame([], F)
    assert q.edges(none).count() == 0 and q.components(none).count() == 0 and q.collapsed(none).count() == 0


def test_gate_and_sql(spark):
    blocks = spark.createDataFrame([("d", 1, "p1", "paragraph", "Alpha  beta\tgamma", 0, False, None), ("d", 2, "p2", "paragraph", None, 0, False, None), ("d", 3, "p3", "paragraph", "delta", 0, False, None), ("d", 3, "p3", "paragraph", "delta", 0, False, None)], B)
    f = [
        finding(1, quote="beta gamma"), finding(2, quote="gamma beta"), finding(3, quote=None), finding(4, quote="x", blocks=["p9"]), finding(5, quote="delta", blocks=[]), finding(6, quote="elt", blocks=None), finding(7, quote="no such words", blocks=[]),
        finding(8, quote="Alpha, gamma、delta", blocks=["p1", "p3"], mode="disjoint_parts"), finding(9, quote="Alpha, omega", mode="disjoint_parts"), finding(10, quote=", 、", mode="disjoint_parts"), finding(11, quote="alpha", blocks=["p1", "p9"]), finding(12, quote="  ", blocks=["p2"]), finding(13, quote="ta, de", blocks=[], mode="disjoint_parts"), finding(14, quote="d", blocks=[], doc="e"),
    ]
    df = spark.createDataFrame(f + f[:2], F)
    got = same_as_sql(g.gated(df, blocks), plans.SQL["gate_finding"], findings=df, blocks=blocks).set_index("id")
    assert got.loc["F0001", "reason"] == "exact-match" and got.loc["F0008", "reason"] == "all-parts-match 3/3" and got.loc["F0009", "reason"] == "partial-match 1/2" and got.loc["F0005", "passed"] and not got.loc["F0007", "passed"] and got.loc["F0002", "confidence"] == 0.3
    assert g.gated(spark.createDataFrame([], F), blocks).count() == 0


def test_runs(spark):
    before = dict(source="deterministic")
    f = [finding(1, quote="a", why="s", **before), finding(2, quote="a", why="s"), finding(3, quote="a", why="s"), finding(4, quote="b", why="t", **before), finding(5, quote="c", why="t"), finding(6, quote="d", why="u", **before), finding(7, quote="e", why="v"), finding(8, quote="f", why="w", severity="nit", **before), finding(9, quote="f", why="w", severity="major"), finding(10, quote="g", passed=False), finding(11, quote="h", verdict="unverifiable"), finding(12, quote="k", why="y", **before), finding(13, quote="k", why="y")]
    df = spark.createDataFrame(f, F)
    got = same_as_sql(g.compared_runs(df), plans.SQL["run_difference"], findings=df)
    assert sorted(got["status"]) == ["moved", "new", "resolved", "unchanged", "worsened", "worsened"]


def test_lookup(spark):
    records = spark.createDataFrame([(1, "doi:10.1234/AB.", None), (2, None, "X. arXiv:2101.00001v2"), (3, "", "PMID: 12345"), (4, None, None), (5, None, "https://doi.org/10.1234/ab; arXiv:2101.00001"), (5, None, "https://doi.org/10.1234/ab; arXiv:2101.00001")], "rec_id bigint, doi string, raw string")
    works = spark.createDataFrame([("w1", "https://doi.org/10.1234/ab"), ("arXiv:2101.00001", None), ("pmid:12345", ""), ("w4", None)], "identifier string, doi string")
    got = same_as_sql(g.looked_up(records, works), plans.SQL["metadata_lookup"], citation_records=records, resolver_metadata=works)
    assert dict(zip(got["rec_id"], got["identifier"])) == {1: "w1", 2: "arXiv:2101.00001", 3: "pmid:12345", 5: "w1"}


def prose(text):
    return [(s[0], s[1], s[2], s[5]) for s in x.Prose(text).out]


def test_prose():
    assert prose("p < 0.05 and P 0.2 with n = 40") == [("p-value", 0.05, "p-value", "p_value"), ("p-value", 0.2, "p-value", "p_value"), ("sample size", 40.0, "count", "sample_size")]
    assert prose("The accuracy was 91.5% in 2019 [3, 4].")[0][1:] == (91.5, "%", "value") and len(prose("The accuracy was 91.5% in 2019 [3, 4].")) == 1
    assert prose("mean age 54.2 ± 3.1 years")[0][1:] == (54.2, "", "value") and prose("risk 95% CI [0.8, 1.2]")[0][1:] == (1.0, "CI", "ci")
    assert prose("[1, 2]") == [] and prose("") == [] and prose("row 17 of 30") == [] and prose("样本量为120") == [("sample size", 120.0, "count", "sample_size")]
    assert len(prose("score 4.5 " * 5000)) == 5000


def test_statements_and_checks(spark):
    text = "On the held-out clinical corpus the model precision 90%, on the held-out clinical corpus the model recall 80%, on the held-out clinical corpus the model f1 70%"
    table = [["group", "n", "share"], ["a", "10", "20%"], ["b", "15", "30%"], ["Total", "26", "50%"]]
    rows = [
        ("d", 1, "p1", "paragraph", text, 0, False, None), ("d", 2, "p2", "paragraph", "The difference was not significant (p = 0.01)", 0, False, None), ("d", 3, "p3", "paragraph", "p = 1.5", 0, False, None), ("d", 4, "t1", "table", None, 0, False, table),
        ("d", 5, "r1", "biblio_entry", "accuracy 3%", 0, True, None), ("d", 6, "p4", "paragraph", "mean score of the pilot 3.1 points", 0, False, None), ("d", 7, "p5", "paragraph", "mean score of the pilot 3.4 points", 0, False, None), ("d", 8, "e", "paragraph", None, 0, False, None),
    ]
    f = x.facts(spark.createDataFrame(rows + rows[:1], B)).cache()
    assert {(z.value, z.kind) for z in f.where("block_id = 't1'").collect()} == {(10.0, "sample_size"), (15.0, "sample_size"), (26.0, "value"), (20.0, "value"), (30.0, "value"), (50.0, "value")}
    assert [(z.block_id, round(z.expected, 4)) for z in x.f1_conflicts(f).collect()] == [("p1", 0.8471)]
    assert [(z.block_id, z.claim) for z in x.claim_conflicts(f).collect()] == [("p2", "not significant")]
    assert [(z.total, z.expected) for z in x.total_conflicts(f).collect()] == [(26.0, 25.0)]
    issues = {z.issue for z in x.numeric_issues(spark.createDataFrame(rows, B)).collect()}
    assert {"f1", "p claim", "p range", "total"} <= issues
    assert x.facts(spark.createDataFrame([], B)).count() == 0


def test_section_stack_and_sql(spark):
    heads = [(1, "A", 1), (2, "B", 3), (3, "C", 3), (4, "D", 2), (5, "References", 1), (6, "X", 2), (7, "E", 1), (8, "F", 2)]
    rows = [("d", p, f"h{p}", "heading", t, lv, False, None) for p, t, lv in heads] + [("e", 1, "h1", "heading", "Z", 3, False, None)]
    df = spark.createDataFrame(rows + rows[:2], B)
    got = same_as_sql(section_paths(df), editing_plans.SQL["section_path"], blocks=df)
    paths = {(z.doc_id, z.block_id): z.path for z in got.itertuples()}
    assert paths["d", "h3"] == "A > B > C" and paths["d", "h6"] == "A > X" and paths["d", "h5"] == "A > D > References" and paths["d", "h8"] == "E > F" and paths["e", "h1"] == "Z"


def test_numbers_of_any_size(spark):
    rows = [("d", 1, "h1", "heading", "1 One", 1, False, None), ("d", 2, "h2", "heading", "20003 Two", 1, False, None), ("d", 3, "h3", "heading", "第三章 Drei", 1, False, None), ("e", 1, "h1", "heading", "1 One", 1, False, None), ("e", 2, "h2", "heading", "3 Three", 1, False, None)]
    df = spark.createDataFrame(rows, B)
    got = same_as_sql(heading_gaps(df), structure_plans.SQL["heading_gaps"], blocks=df)
    assert len(got) == 20_000 and set(got["doc_id"]) == {"d"}
    assert {z.block_id: z.n for z in heading_numbers(df).where("doc_id = 'd'").collect()} == {"h1": 1, "h2": 20003, "h3": 3}
    marks = spark.createDataFrame([("d", 1, "1-20001", "b")], "doc_id string, seq int, key string, block_id string")
    assert mark_numbers(marks).count() == 20_001
    records = spark.createDataFrame([("d", 1, 30_000, None, None, None), ("d", 2, 1, None, None, None)], "doc_id string, seq int, entry_index int, key string, raw string, block_id string")
    assert gaps(records).count() == 29_998


def test_rank_display(spark):
    df = spark.createDataFrame([finding(i) for i in range(1, 1011)], F)
    got = same_as_sql(ranks(df), finding_plans.SQL["finding_rank"], findings=df)
    assert got.set_index("rank")["display"].loc[[7, 999, 1000, 1010]].tolist() == ["F007", "F999", "F1000", "F1010"]
