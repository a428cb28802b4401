import random

from folioscope.llm.language import best_path, identify, known_labels, label_code, letters, relabelled, sentences

LANGS = [("en", "English"), ("es", "Spanish"), ("zh", "Chinese")]
WORDS = {
    "en": "the report shows that a small sample was used and the results were not clear enough for this journal".split(),
    "es": "el informe muestra que una muestra pequeña fue usada y los resultados no eran claros para esta revista".split(),
    "zh": ["本文提出的模型", "没有说明样本量", "各中心之间的差异", "补充了置信区间", "参考文献列表"],
}


def sentence(r, lang):
    w = [r.choice(WORDS[lang]) for _ in range(12 if lang != "zh" else 4)]
    return ("".join(w) + "。") if lang == "zh" else " ".join(w).capitalize() + "."


def text(r, lang, n=5):
    return ("" if lang == "zh" else " ").join(sentence(r, lang) for _ in range(n))


def frames(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0) for i, t, lang in rows], "doc_id bigint, text string, lang string, seg_no int"), spark.createDataFrame(LANGS, "lang_code string, lang_name string")


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["en", " EN ", "English", "eng", "en_US", "zh-Hans", "spa", "mul", "", None, "xx", "englisch"]], "lang string")
    assert [r[0] for r in df.select(label_code(df.lang, known_labels(LANGS))).collect()] == ["en", "en", "en", "en", "en", "zh", "es", None, None, None, None, None]


def test_documents_and_segments(spark):
    r = random.Random(7)
    rows, truth = [], {}
    for i in range(120):
        lang = r.choice(["en", "es", "zh"])
        label = lang if r.random() < 0.85 else r.choice(["mul", None, "en", "es"])
        rows.append((i, text(r, lang), label))
        truth[i] = [] if label == lang else [(0, lang)]
    for i in range(200, 230):
        order = r.sample(["en", "es", "zh"], r.choice([2, 3]))
        rows.append((i, "\n".join(text(r, x, 3) for x in order), r.choice(["en", "es", "zh", None, "mul"])))
        truth[i] = list(enumerate(order, 1))
    rows += [(300, None, "en"), (301, "", "en"), (302, "--- 12 %", None), (303, text(r, "en").upper() * 300, None), (304, text(r, "es", 3) + " (“" + WORDS["zh"][0] + "”).", "es")]
    truth |= {300: [], 301: [], 302: [], 303: [(0, "en")], 304: []}
    docs, langs = frames(spark, rows + rows[:3])
    got = {}
    for x in relabelled(docs, langs).collect():
        got.setdefault(x.doc_id, []).append((x.seg_no, x.lang))
    wrong = [i for i in truth if sorted(got.get(i, [])) != truth[i]]
    assert len(wrong) <= 2 and not {300, 301, 302, 303} & set(wrong)
    full = identify(docs, langs).collect()
    assert all(0.5 <= x.confidence <= 1 for x in full)


def test_parts():
    assert sentences("One. Two! 三。四？\n---\n5.") == ["One.", " Two!", " 三。", "四？"]
    assert letters("Café  N° 12!\nx") == [" cafe n ", " x "] and letters("") == ["  "]
    assert list(best_path(__import__("numpy").array([[9.0, 0], [0, 3], [9, 0], [0, 40]]))) == [0, 0, 0, 1]


def test_without_training_rows(spark):
    docs, langs = frames(spark, [(1, "Some text without any label at all in it.", None)])
    assert identify(docs, langs).count() == 0
    assert identify(spark.createDataFrame([], "doc_id bigint, text string, lang string"), langs).count() == 0


def test_copies_of_a_text_train_once(spark):
    from folioscope.llm.language import fit_filters

    texts = [f"text number {i} speaks of {w} and of {v} at some length, as texts of this kind do" for i in range(12) for w in ("gait", "speech") for v in ("trials", "archives")]
    other = [f"ein Satz der Nummer {i} handelt von Versuchen und von Archiven in aller gebotenen Ausführlichkeit" for i in range(30)]
    once = [(t, "en") for t in texts] + [(t, "de") for t in other]
    copies = once + [(texts[5], "en")] * 900
    fit = lambda data: fit_filters(spark.createDataFrame(data, "text string, lang string"), ["de", "en"], {"de": "de", "en": "en"}, 20)
    assert (fit(copies) == fit(once)).all() and fit(once).any()
