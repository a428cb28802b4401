import datetime as dt
import random

from folioscope.llm.consensus import consensus, finding_votes, readable_votes, spectral_reliability

J = "doc_id string, seq int, finding_id string, judge_model string, position string, verdict string, judged_at timestamp, v string"
T = dt.datetime(2026, 1, 1)


def judgments(spark, rows):
    return spark.createDataFrame([("d", i, f, j, p, v, T, "x") for i, (f, j, p, v) in enumerate(rows)], J)


def test_votes_are_read(spark):
    rows = [("F1", "Judge ", "claim_first", " YES"), ("F1", "judge", "claim first", "no"), ("F1", "judge", "unordered", "yes"), ("F1", "b", "evidence_first", None), (None, "b", "claim_first", "yes"), ("F2", None, "claim_first", "yes"), ("F2", "c", None, "no"), ("F3", "c", "evidence-first", "No"), ("F3", "c", "evidence_first", "cannot_assess")]
    got = {(r.item, r.annotator): r.v for r in readable_votes(judgments(spark, rows)).collect()}
    assert got == {("F1", "judge:claim_first"): -1.0, ("F3", "c:evidence_first"): -1.0}  # the later vote of one judge stands


def test_only_findings_count(spark):
    f = spark.createDataFrame([("F1", 1), ("F1", 1), (None, 2)], "id string, item int")
    assert [r.item for r in finding_votes(f, judgments(spark, [("F1", "a", "claim_first", "yes"), ("X9", "a", "claim_first", "yes")])).collect()] == ["F1"]


def test_reliability_beats_majority(spark):
    """Few good judges, many weak and some contrary ones: the consensus finds the truth where the majority doesn't."""
    r = random.Random(5)
    judges = [(0.95, 0.93), (0.92, 0.9), (0.9, 0.95)] + [(0.55, 0.55)] * 5 + [(0.2, 0.15)] * 2 + [(0.95, 0.3)] * 2
    truth = {f"F{i}": r.random() < 0.6 for i in range(400)}
    rows = []
    for f, t in truth.items():
        for k in r.sample(range(len(judges)), 9):
            right = r.random() < judges[k][0 if t else 1]
            rows.append((f, f"j{k}:claim_first", 1.0 if t == right else -1.0))
    votes = spark.createDataFrame(rows, "item string, annotator string, v double")
    items, model = consensus(votes)
    items = {x.item: x for x in items.collect()}
    right = sum((items[f].verdict == "yes") == t for f, t in truth.items()) / len(truth)
    majority = sum((sum(v for i, _, v in rows if i == f) > 0) == t for f, t in truth.items()) / len(truth)
    assert right > 0.93 and right > majority + 0.03
    assert all(0.5 <= x.confidence <= 1 and 0 <= x.agreement <= 1 for x in items.values())
    g = {x.annotator: x.reliability for x in model.collect()}
    assert min(g[f"j{k}:claim_first"] for k in range(3)) > max(g[f"j{k}:claim_first"] for k in range(3, 8)) and max(g["j8:claim_first"], g["j9:claim_first"]) < 0


def test_small_cases(spark):
    none = spark.createDataFrame([], "item string, annotator string, v double")
    items, model = consensus(none)
    assert items.count() == 0 and model.count() == 0
    one = spark.createDataFrame([("F1", "a", 1.0)], "item string, annotator string, v double")
    assert consensus(one)[0].count() == 1
    tie = spark.createDataFrame([("F1", "a", 1.0), ("F1", "b", -1.0), ("F2", "a", 1.0), ("F2", "b", -1.0)], "item string, annotator string, v double")
    assert {r.item for r in consensus(tie)[0].collect()} == {"F1", "F2"}
    assert spectral_reliability(none).count() == 0
