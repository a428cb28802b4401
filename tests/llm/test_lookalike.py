import unicodedata

from folioscope.llm.lookalike import Trie, canonical, canonical_texts, classes, consistent, fold, hidden_quotes

F = "id string, doc_id string, verbatim_quote string, block_ids array<string>, text string"
B = "doc_id string, block_id string, text string, form string"


def test_fold():
    assert fold("ｅｘ​clusiοn сriteria") == "exclusion criteria"
    assert fold("conﬁdence") == "confidence" and fold(unicodedata.normalize("NFD", "Über")) == "Über"
    assert fold("é") != fold("e") and fold("A") != fold("a") and fold("–") != fold("-") and fold("first‑pass") == "first-pass"
    assert fold("x²") == "x²" and fold("一⼀") == "一一" and fold("") == ""


def test_consistent():
    assert consistent("word") and consistent("naïve") and consistent("привет") and consistent("中文，")
    assert not consistent("wоrd") and not consistent("ｗｏｒｄ") and not consistent("wo​rd") and not consistent("А")


def test_trie():
    t = Trie([("word", 5), ("ward", 2), ("мост", 3), ("wordy", 1)])
    assert t.reach("wοrd") == [(0, "word", 5)] and canonical("ｗοrd‍", t) == "word"
    assert [(c, w) for c, w, _ in t.reach("wοrd", 1)] == [(0, "word"), (1, "ward"), (1, "wordy")]
    assert canonical("мoст", t) == "мост" and canonical("unknοwn", t) == "unknown"
    assert Trie([]).reach("x") == [] and all(k == v[0] for k, v in classes().items())


def test_texts(spark):
    vocab = spark.createDataFrame([("the exclusion criteria hold",), (None,), ("",)], "text string")
    texts = spark.createDataFrame([(1, "ｅｘclusiοn criteria", 0), (2, None, 0), (3, "", 0), (4, "plain", 0), (5, "​", 0), (6, "сriteria " * 20_000, 0)], "id int, text string, token int")
    got = {r.id: (r.canonical, r.form) for r in canonical_texts(texts, vocab).collect()}
    assert got[1] == ("exclusion criteria", "exclusion criteria") and got[2] == (None, None) and got[3] == ("", "") and got[4] == ("plain", "plain") and got[5] == ("", "") and got[6][1] == "criteria " * 20_000


def test_quotes(spark):
    blocks = [("d", "p1", "The exclusion criteria hold at the café.", "x"), ("d", "p1", "The exclusion criteria hold at the café.", "x"), ("d", "p2", None, "x"), ("d", "p3", "Тhe main table", "x")]
    findings = [
        ("F1", "d", "exclusiοn criteria", ["p1", "p1"], "x"), ("F2", "d", "exclusion criteria", ["p1"], "x"), ("F3", "d", "cafe", ["p1"], "x"), ("F4", "d", "Exclusiοn", ["p1"], "x"), ("F5", "d", None, ["p1"], "x"), ("F6", "d", "", ["p1"], "x"),
        ("F7", "d", "ex­clusion", ["p2", "p9", None], "x"), ("F8", "d", "The main", ["p3"], "x"), ("F9", "d", "clusi​on", ["p1"], "x"), ("F10", "e", "exclusiοn", ["p1"], "x"), ("F11", "d", "exclusiοn", None, "x"), ("F12", "d", "​", ["p1"], "x"),
    ]
    got = hidden_quotes(spark.createDataFrame(findings, F), spark.createDataFrame(blocks, B)).collect()
    assert {(r.finding_id, r.block_id) for r in got} == {("F1", "p1"), ("F8", "p3"), ("F9", "p1")} and len(got) == 3


def test_empty(spark):
    assert hidden_quotes(spark.createDataFrame([], F), spark.createDataFrame([], B)).count() == 0
