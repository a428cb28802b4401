from folioscope.operators import editing
from tests.test_operators import FI, B, R, block, finding, rows

MARK = "doc_id string, seq int, raw string, key string, block_id string, char_range struct<start_pos: int, end_pos: int>"
WORK = "identifier string, title string, abstract string, authors array<string>, year int"


def test_claims(spark):
    text = "First one. The 数据 claim [3] holds 1.5 times. Last."
    at = text.index("[3]")
    marks = [("d", 1, "[3]", "3", "p1", (at, at + 3)), ("d", 1, "[3]", "3", "p1", (at, at + 3)), ("d", 2, "x", "1", "p9", (0, 1)), ("d", 3, "x", "1", "p1", (5, 900)), ("d", 4, "x", "1", "p2", (0, 0)), ("d", 5, None, None, None, None)]
    got = rows(editing.claims(spark.createDataFrame(marks, MARK), spark.createDataFrame([block("d", 1, text), block("d", 2, None)], B)))
    assert got == [("d", 1, "The 数据 claim holds 1.5 times")]


def test_chunks(spark):
    b = [block("d", 1, "x" * 10), block("d", 2, "1 Head", "heading", 1)] + [block("d", i, "y" * 40) for i in range(3, 9)] + [block("d", 9, "z" * 500), block("d", 10, "w"), block("e", 1, None), block("e", 2, "v")]
    got = rows(editing.chunks(spark.createDataFrame(b + b[:2], B), 100))
    assert got == [("d", 0, 1, 1, 1, 10), ("d", 1, 1, 2, 3, 86), ("d", 1, 2, 5, 2, 80), ("d", 1, 3, 7, 2, 80), ("d", 1, 4, 9, 1, 500), ("d", 1, 5, 10, 1, 1), ("e", 0, 1, 2, 1, 1)]
    assert editing.chunks(spark.createDataFrame([], B)).count() == 0


def test_proposals(spark):
    blocks = spark.createDataFrame([block("d", 1, "alpha beta alpha"), block("d", 2, "one\ntwo"), block("d", 3, "gamma")], B)
    f = [finding(1, "alpha", fix="F"), finding(2, "two", ("p2",), fix="F"), finding(3, "x", ("p9",), fix="F"), finding(4, "gamma", ("p3",), fix="F"), finding(5, "gamma", ("p3",), fix="F"), finding(6, "beta", fix=" "), finding(7, "", ("p2",), doc="e", fix="F"), finding(2, "two", ("p2",), fix="F")]
    df = spark.createDataFrame(f, FI)
    got = {r.id: (r.status, r.start, r.new_text) for r in editing.proposals(df, blocks).collect()}
    assert got == {"F1": ("ambiguous", None, None), "F2": ("ready", 4, "one\n[F]"), "F3": ("unknown block", None, None), "F4": ("conflict", None, None), "F5": ("conflict", None, None), "F7": ("unknown block", None, None)}
    assert rows(editing.differences(editing.proposals(df, blocks), blocks, df)) == [("F2", 1, 1)]


def test_titles(spark):
    rec = lambda i, t, y: (i, "d", i, None, None, None, None, t, None, y, None, None, None)
    records = spark.createDataFrame([rec(1, "Adaptive retrieval of gait asymmetry in clinics", 2001), rec(2, "Adaptive retrieval of gait asymetry in clinics", 1999), rec(3, None, 1), rec(4, "Something else altogether here", 2001)], R)
    works = spark.createDataFrame([("w1", "Adaptive Retrieval of Gait Asymmetry in Clinics", "About gait.", None, 2001), ("w2", "Adaptive retrieval of speech fatigue in clinics", None, None, 2001)], WORK)
    assert [(r.rec_id, r.identifier) for r in editing.best_titles(records, works).collect()] == [(1, "w1")]
    assert rows(editing.supports(records, works).select("rec_id", "status")) == [(1, "unsupported")]


def test_titles_as_brute_force(spark):
    import difflib
    import random
    import re

    draw = random.Random(7)
    words = ["gait", "analysis", "of", "sparse", "records", "trial", "ageing", "流行病学", "病灶", "增长", "分析", "队列", "a", "x"]
    base = ["".join(draw.choice(words) + draw.choice(["", " ", " ", ": "]) for _ in range(draw.randint(1, 9))) for _ in range(60)]

    def altered(t):
        for _ in range(draw.randint(0, 1 + len(t) // 6)):
            i = draw.randrange(len(t) + 1)
            t = t[:i] + draw.choice(["", "e", " ", "学"]) + t[i + draw.randint(0, 1) :]
        return t

    years = [2000, 2000, 2001, None]
    records = [(i, altered(base[i % 60]), draw.choice(years)) for i in range(180)] + [(900, "", 2000), (901, None, 2000), (902, "?!", None)]
    works = [(f"w{i}", altered(t), draw.choice(years)) for i, t in enumerate(base)] + [("w900", "", 2000), ("w901", None, 2000)]
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    r, w = spark.createDataFrame(records, "rec_id bigint, title string, year int"), spark.createDataFrame(works, "identifier string, title string, year int")
    for least in (0.84, 0.7):
        want = {}
        for i, t, y in records:
            for k, u, v in works:
                if plain(t) and plain(u):
                    score = difflib.SequenceMatcher(None, plain(t), plain(u)).ratio() - (0.2 if y and v and y != v else 0.0)
                    if score >= least:
                        want[i] = max(want.get(i, (0.0, "")), (score, k))
        assert len(want) > 30 and any("一" <= records[i][1][0] <= "鿿" for i in want)
        assert {x.rec_id: x.identifier for x in editing.best_titles(r, w, least).collect()} == {i: k for i, (_, k) in want.items()}


def test_titles_are_not_broadcast(spark, tmp_path):
    """Spark's threshold is far above its estimate of these works, which leaves out that each is listed many times with its bits."""
    r = spark.createDataFrame([(1, "Adaptive retrieval of gait", 2001)], "rec_id bigint, title string, year int")
    w = spark.createDataFrame([("w1", "Adaptive retrieval of gait", 2001)], "identifier string, title string, year int")
    r.write.parquet(f"{tmp_path}/r")
    w.write.parquet(f"{tmp_path}/w")
    plan = editing.best_titles(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/w"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_titles_meet_in_tiles(spark, monkeypatch):
    """Years, titles and works without year in several tiles each give what one tile gives; a title of many pairs is matched in few."""
    import difflib
    import random

    from folioscope.operators import titles

    draw = random.Random(11)
    words = ["adaptive", "retrieval", "gait", "asymmetry", "clinics", "sparse", "records", "for", "of", "in", "ageing", "pilot"]
    base = [" ".join(draw.choice(words) for _ in range(9)) for _ in range(40)]
    altered = lambda t, n: "".join(c for i, c in enumerate(t) if i % n) or t
    years = [2000, 2000, 2001, None]
    records = [(i, altered(base[i % 40], 9 + i % 5) if i % 3 else base[i % 40], draw.choice(years)) for i in range(120)]
    works = [(f"w{i}", t, draw.choice(years)) for i, t in enumerate(base * 2)] + [(f"x{i}", altered(t, 30), 2000) for i, t in enumerate(base)]
    want, matched = {}, []
    for i, t, y in records:
        for k, u, v in works:
            score = difflib.SequenceMatcher(None, t, u).ratio() - (0.2 if y and v and y != v else 0.0)
            if score >= 0.84:
                want[i] = max(want.get(i, (0.0, "")), (score, k))
    monkeypatch.setattr(editing, "TITLES", 25)
    monkeypatch.setattr(editing, "WORKS", 20)
    r, w = spark.createDataFrame(records, "rec_id bigint, title string, year int"), spark.createDataFrame(works, "identifier string, title string, year int")
    assert {x.rec_id: (x.score, x.identifier) for x in editing.best_titles(r, w).collect()} == {i: (round(s, 6), k) for i, (s, k) in want.items()}
    assert len(want) > 60
    one = titles.similarity
    monkeypatch.setattr(titles, "similarity", lambda a, b: matched.append(1) or one(a, b))
    found = titles.Tile([t for _, t, _ in records], [None] * 120, [t for _, t, _ in works], [None] * 120, [k for k, _, _ in works], 0.84, 0.2).best()
    near = sum(difflib.SequenceMatcher(None, t, u).ratio() >= 0.84 for _, t, _ in records for _, u, _ in works)
    assert len(found) > 60 and len(matched) < 0.8 * near


def test_title_similarity_as_sequence_matcher():
    import difflib
    import random

    from folioscope.operators import titles

    draw = random.Random(2)
    for n in range(600):
        a = "".join(draw.choice("abc 学"[: 2 + n % 4]) for _ in range(draw.randint(1, 260 if n % 20 == 0 else 70)))
        b = "".join(draw.choice(["", c, c, c, c + "b"]) for c in a) or "c"
        assert titles.similarity(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
    # windows: characters as far apart as the score allows, texts of one to three words of 64, works shorter and longer than titles
    for n in (5, 30, 64, 65, 128, 150):
        a = "".join(draw.choice("abcdefghijklmnop") for _ in range(n))
        works = [a[k:] + "z" * j for k in range(0, n // 6 + 1) for j in (0, 1, n // 12)] + ["z" * j + a[: n - k] for k in range(0, n // 6 + 1) for j in (0, 1, n // 12)]
        scores = [difflib.SequenceMatcher(None, a, b).ratio() for b in works]
        for least in (0.84, 0.9):
            for b, s in zip(works, scores):
                found = titles.Tile([a], [None], [b], [None], ["k"], least, 0.2).best()
                assert found == ([(0, "k", s)] if s >= least else [])


def test_small(spark):
    f = spark.createDataFrame([finding(1, "Ｓtraße  ﬁ!"), finding(2, None)], FI)
    assert {r.id: r.normal for r in editing.normal_texts(f).collect()} == {"F1": "strasse fi", "F2": None}
    assert rows(editing.distinct_words(spark.createDataFrame([block("d", 1, "b A b"), block("d", 2, None)], B))) == [("d", "p1", "b a"), ("d", "p2", "")]


def test_largest_matching_as_brute_force(spark):
    import random

    draw = random.Random(3)
    data = [(i, tuple(sorted(draw.sample([f"p{k}" for k in range(7)], draw.randint(0, 3)))), draw.choice("de"), draw.choice(["deterministic", "llm"])) for i in range(60)]
    # both must leave the other one their least block
    data += [(90, ("p1", "p2"), "f", "deterministic"), (91, ("p2",), "f", "llm"), (92, ("p2", "p3"), "f", "deterministic"), (93, ("p0", "p3"), "f", "llm"), (94, ("p9",), "f", "llm")]

    def best(golds, founds):
        if not golds:
            return 0
        skip = best(golds[1:], founds)
        return max([skip] + [1 + best(golds[1:], founds[:k] + founds[k + 1 :]) for k, b in enumerate(founds) if not golds[0] or set(golds[0]) & set(b)]) if skip < min(len(golds), len(founds)) else skip

    for n in (5, 9, 13, 16, 65):
        rows_ = [x for x in data[:n]] if n < 65 else data[60:]
        df = spark.createDataFrame([finding(i, blocks=b, doc=d, source=s) for i, b, d, s in rows_], FI)
        want = {}
        for d in {x[2] for x in rows_}:
            g, f = [x[1] for x in rows_ if x[2] == d and x[3] == "deterministic"], [x[1] for x in rows_ if x[2] == d and x[3] == "llm"]
            want[d] = (len(g), len(f), best(g, f))
        assert {r.doc_id: (r.n_gold, r.n_found, r.n_matched) for r in editing.matched_gold(df).collect()} == want
    assert want["f"] == (2, 3, 2)
    assert [(r.tp, r.fp, r.fn) for r in editing.matched_scores(df).where("issue_type is null").collect()] == [(2, 1, 0)]
    assert editing.matched_gold(spark.createDataFrame([], FI)).count() == 0
