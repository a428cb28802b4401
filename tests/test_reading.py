import duckdb

from folioscope.operators import reading as d
from folioscope.plans import graph as plans

B = "doc_id string, pos int, block_id string, kind string, text string, is_bibliography boolean, key string"


def block(i, text, kind="paragraph", bib=False):
    return ("d", i, f"p{i}", kind, text, bib, "clash")


def sql(query, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    return con.execute(query).fetchall()


def test_author_years(spark):
    rows = [block(1, "As said (Smith and Lee, 2020; x) and (Wu et al., 2019b), Brown (2001) too."), block(2, "张三丰（2018）指出 (王五等 某某，2017)"), block(3, None), block(4, "Lee (2000)", "biblio_entry"), block(5, "(x, 1850)"), block(6, "O'Neil et al. (2011) " * 300)]
    df = spark.createDataFrame(rows + rows[:1], B)
    got = d.author_year_citations(df).collect()
    keys = {(r.block_id, r.pattern): r.key for r in got}
    assert keys["p1", "bracket"] == "wu|2019b" and keys["p1", "narrative"] == "brown|2001" and keys["p2", "chinese"] == "张三丰|2018" and keys["p6", "narrative"] == "o'neil|2011"
    assert {r.block_id for r in got} == {"p1", "p2", "p6"} and sum(r.block_id == "p6" for r in got) == 300
    assert sorted(map(tuple, d.author_year_citations(df).select("doc_id", "block_id", "pattern", "place", "key").collect())) == sorted(sql(plans.SQL["author_year_citations"], blocks=df))
    assert d.author_year_citations(spark.createDataFrame([], B)).count() == 0


def test_headings(spark):
    rows = [block(1, "结论："), block(2, "2.1 Data"), block(3, "3 items were lost."), block(4, "RELATED WORK"), block(5, "plain words"), block(6, " Discussion "), block(7, "1 " + "x" * 200), block(8, "4) Limits", "list_item"), block(9, "References", "heading"), block(10, "")]
    df = spark.createDataFrame(rows, B)
    got = {r.block_id: r.level for r in d.headings_by_look(df).collect()}
    assert got == {"p1": 1, "p2": 2, "p4": 1, "p6": 1, "p8": 1}
    assert sorted(map(tuple, d.headings_by_look(df).collect())) == sorted(sql(plans.SQL["headings_by_look"], blocks=df))


def test_fields(spark):
    rows = [
        (1, "[3] Smith, J.; Lee, K. (2020). A study of things. Journal X, 3."), (2, "“Quoted title” by nobody"), (3, None), (4, " "), (5, "王五. 2019. 研究方法。学报"), (6, "Only a sentence here. Then more"), (7, "2001"),
    ]
    got = {r.rec_id: (r.year, r.authors, r.title) for r in d.reference_fields(spark.createDataFrame(rows + rows[:1], "rec_id bigint, raw string")).collect()}
    assert got[1] == (2020, ["Smith, J", "Lee, K"], "A study of things") and got[2] == (None, ["“"], "Quoted title") or got[2][2] == "Quoted title"
    assert got[5] == (2019, ["王五"], "研究方法") and got[6][2] == "Only a sentence here" and got[7] == (2001, [], "") and set(got) == {1, 2, 5, 6, 7}
