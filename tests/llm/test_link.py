import random

from folioscope.llm.link import link, title_of, title_similarity, title_tokens, year_similarity

R = "rec_id bigint, title string, authors array<string>, year int, raw string, identifier string, confidence double"
W = "identifier string, title string, authors array<string>, year int, rec_id bigint"
ADJ = "adaptive bayesian remote sparse early passive".split()
ACT = "detection retrieval annotation triage scheduling screening".split()
TOPIC = ["gait asymmetry", "soil moisture", "speech fatigue", "battery ageing", "wound healing"]
WHERE = ["rural clinics", "small archives", "coastal regions", "adult cohorts"]
NAMES = [f"{g} {f}" for g in ("Daniel", "Rosa", "Henrik", "Tereza") for f in ("Abelmond", "Brokwist", "Corlanes", "Dusmorwe", "Elbrintu")]


def works(n=200, seed=1):
    r = random.Random(seed)
    titles = r.sample([f"{a} {b} of {t} in {w}" for a in ADJ for b in ACT for t in TOPIC for w in WHERE], n - 2)
    rows = [(f"w{i}", t.capitalize(), r.sample(NAMES, 3), r.randint(1990, 2020), None) for i, t in enumerate(titles)]
    base = ("Longitudinal dosing of drug interactions in paediatric wards, Part ", r.sample(NAMES, 2))
    return rows + [("p1", base[0] + "I", base[1], 2001, None), ("p2", base[0] + "II", base[1], 2003, None)]


def test_link(spark):
    r, w = random.Random(2), works()
    rows, truth = [], {}
    for i in range(300):
        ident, title, authors, year, _ = r.choice(w)
        t = list(title.split())
        if r.random() < 0.4:
            k = r.randrange(len(t))
            t[k] = t[k][:1] + t[k][2:] if len(t[k]) > 4 else t[k]
        text = ("On " if r.random() < 0.2 else "") + " ".join(t)
        raw = f"[3] Someone, A. ({year}). {title}. Journal, 1, 2."
        rows.append((i, text if r.random() < 0.9 else None, [a.split()[1] + ", " + a[0] + "." for a in authors[: r.randint(1, 3)]] if r.random() < 0.9 else None, year + r.choice([0, 0, 0, 1]) if r.random() < 0.9 else None, raw, "x", 0.0))
        truth[i] = ident
    rows += [(900, "Completely different words that nobody wrote", ["A B"], 2000, None, "x", 0.0), (901, None, None, None, None, "x", 0.0), (902, "", [], 2000, "", "x", 0.0), (903, "word " * 5000, ["A B"], 1999, None, "x", 0.0), (None, "x", None, 1, None, "x", 0.0)]
    got = link(spark.createDataFrame(rows + rows[:2], R), spark.createDataFrame(w + w[:1], W)).collect()
    found = {x.rec_id: x.identifier for x in got}
    assert len(found) == len(got) and not {900, 901, 902, 903} & set(found) and all(0.5 <= x.confidence <= 1 for x in got)
    right = sum(found.get(i) == t for i, t in truth.items())
    assert right / len(truth) > 0.95 and right / len(found) > 0.98


def test_similarities():
    a, b = title_tokens("Remote triage of soil moisture, Part II"), title_tokens("Remote triage of soil moisture, Part I")
    assert title_similarity(a[0], a[0], a[1], a[1]) == 1 and title_similarity(a[0], b[0], a[1], b[1]) < 0.5
    assert title_tokens("针对Lökwost稀疏标注的土壤")[0] == title_tokens("针对Lökwost稀疏标注土壤")[0]
    assert year_similarity(2000, 2001) > 0.6 and year_similarity(None, 1) is None and year_similarity(1, 9) == 0
    assert title_of("[1] A, B. 1998. “The title, here”, in: J") == "The title, here" and title_of("[2] Noor, D. (1989). The other title. J, 6.") == "The other title" and title_of(None) == ""


def test_empty(spark):
    none, some = spark.createDataFrame([], R), spark.createDataFrame(works(), W)
    assert link(none, some).count() == 0 and link(none, spark.createDataFrame([], W)).count() == 0


def test_records_of_one_work_agree(spark):
    """A work without authors and year: records of its title that contradict its other records are of another work; without the second side they are linked."""
    w = works()
    rows, k = [], 0
    for ident, title, authors, year, _ in w:
        for _ in range(2):
            rows.append((k, title, authors, year, None, None, None))
            k += 1
    w.append(("bare", "Sparse forecasting of tidal erosion in alpine valleys", None, None, None))
    rows += [(1000 + i, "Sparse forecasting of tidal erosion in alpine valleys", ["Rosa Abelmond", "Henrik Corlanes"], 2011, None, None, None) for i in range(6)]
    rows += [(2000, "Sparse forecasting of tidal erosion in alpine valleys", ["Milan Fostwurm", "Ravi Gronkel"], 1991, None, None, None)]
    r, ws = spark.createDataFrame(rows, R), spark.createDataFrame(w, W)
    found = {both: {x.rec_id for x in link(r, ws, both_sides=both).where("identifier = 'bare'").collect()} for both in (True, False)}
    assert found[False] == {*range(1000, 1006), 2000} and found[True] == set(range(1000, 1006))


def test_blocking_recall(spark):
    """Pairs that the whole comparison of all records with all works would link are candidates."""
    from folioscope.llm import link as m

    r, w = random.Random(4), works(120, 3)
    rows = []
    for i in range(150):
        ident, title, authors, year, _ = r.choice(w)
        t = title.split()
        for _ in range(r.randint(0, 2)):
            j = r.randrange(len(t))
            t[j] = t[j][:1] + t[j][2:] if len(t[j]) > 4 else t[j]
        rows.append((i, " ".join(t), r.choice([authors, authors[:1], None]), r.choice([year, year + 1, None]), None, None, None))
    left = m.described(spark.createDataFrame(rows, R), "rec_id", "raw")
    right = m.described(spark.createDataFrame(w, W), "identifier")
    got = {(x.rec_id, x.identifier) for x in m.candidates(left, right, "rec_id", "identifier").collect()}
    a, b = [x.asDict() for x in left.collect()], [x.asDict() for x in right.collect()]
    like = {(x["rec_id"], y["identifier"]) for x in a for y in b if m.title_similarity(m.cut(x["tokens"]), m.cut(y["tokens"]), m.cut(x["numbers"]), m.cut(y["numbers"])) >= 0.9}
    assert len(like) > 100 and len(like & got) >= 0.99 * len(like)


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Spark's threshold is far above its estimate of these tables, which leaves out how many keys a title has."""
    from folioscope.llm import link as m

    plans, real = [], m.written

    def written(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(m, "written", written)
    rows = [(i, title, authors, year, None, None, None) for i, (_, title, authors, year, _) in enumerate(works())]
    assert link(spark.createDataFrame(rows, R), spark.createDataFrame(works(), W)).count() > 150
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
