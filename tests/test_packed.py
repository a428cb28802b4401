import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.operators.packed import split_marks

SCHEMA = "doc_id string, seq int, raw string, key string, val int"


def values(spark, rows):
    df = spark.createDataFrame([(d, s, r, k, 0) for d, s, r, k in rows], SCHEMA)
    out = {}
    for r in split_marks(df).collect():
        out.setdefault((r.doc_id, r.seq), []).append((r.val_pos, r.val))
    return {k: [v for _, v in sorted(x)] for k, x in out.items()}


def test_notations(spark):
    rows = [
        ("a", 1, "[8,3;]", "8,3;"),
        ("a", 2, "[2]", " 2 "),
        ("a", 3, "[13, 3; 5 and 7-5]", "13, 3; 5 and 7-5"),
        ("a", 4, "[“10”,“3”]", "“10”,“3”"),
        ("a", 5, None, "5], [5–7], [09"),
        ("a", 6, "(Klimli & Gilwis, 1991;Jiahar et al., 2003b)", None),
        ("a", 7, "(Sulwebi, M., 2013; Rekulm, 1995, 2011)", "\"sulwebi; m.\"|2013; rekulm|1995,2011"),
        ("a", 8, "Refs 4 to 5,４", ""),
        ("a", 9, None, None),
        ("a", 10, "", ""),
        ("b", 1, "(A, 2001; B, 2002)", "alpha|2001, beta|2002"),
        ("b", 1, "(A, 2001; B, 2002)", "alpha|2001, beta|2002"),
        ("b", 2, "x", "500 / 1303"),
        ("b", 3, "[24-25]", "24-25"),
        (None, None, "1,2", None),
    ]
    got = values(spark, rows)
    assert got == {
        ("a", 1): ["8", "3"],
        ("a", 3): ["13", "3", "5", "5", "6", "7"],
        ("a", 4): ["10", "3"],
        ("a", 5): ["5", "5", "6", "7", "9"],
        ("a", 6): ["klimli|1991", "jiahar|2003b"],
        ("a", 7): ["sulwebi; m.|2013", "rekulm|1995", "rekulm|2011"],
        ("a", 8): ["4", "5", "4"],
        ("b", 1): ["alpha|2001", "beta|2002"],
        ("b", 2): ["500", "1303"],
        ("b", 3): ["24", "25"],
        (None, None): ["1", "2"],
    }


def test_empty_table(spark):
    assert split_marks(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_mark_and_hot_document(spark):
    rows = [("hot", i, None, "1, 2; 3") for i in range(300)] + [("hot", 999, None, ",".join(map(str, range(20_000))))]
    got = values(spark, rows)
    assert len(got) == 301 and all(got["hot", i] == ["1", "2", "3"] for i in range(300)) and len(got["hot", 999]) == 20_000


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(st.one_of(st.integers(1, 400), st.tuples(st.integers(1, 60), st.integers(1, 60))), min_size=1, max_size=6), st.sampled_from([", ", ";", "、", " and ", "/", "|", "；"])), min_size=1, max_size=8))
def test_round_trip(spark, marks):
    rows, want = [], {}
    for i, (items, sep) in enumerate(marks):
        text = sep.join(f"{x[0]}–{x[1]}" if isinstance(x, tuple) else str(x) for x in items)
        full = [str(v) for x in items for v in (range(min(x), max(x) + 1) if isinstance(x, tuple) else [x])]
        rows.append(("d", i, None, text))
        if len(full) > 1:
            want["d", i] = full
    assert values(spark, rows) == want
    assert all(re.fullmatch(r"[1-9]\d*", v) for x in want.values() for v in x)


def test_scores_decide(spark):
    """The same delimiter parts values in one source and belongs to a value in another."""
    rows = [("slash", i, None, f"smith/jones|{1990 + i}; lee/kim|2001") for i in range(4)] + [("parts", i, None, f"smith|{1990 + i}/lee|2001") for i in range(4)]
    rows += [("amp", i, None, f"smith & jones|{1990 + i}; lee|2001") for i in range(4)] + [("plain", 1, None, "3/5")]
    got = values(spark, rows)
    assert got["slash", 0] == ["smith/jones|1990", "lee/kim|2001"] and got["parts", 1] == ["smith|1991", "lee|2001"] and got["amp", 2] == ["smith & jones|1992", "lee|2001"]
    assert got["plain", 1] == ["3", "5"]


def test_ranges_of_any_width(spark):
    got = values(spark, [("a", 1, None, "5, 1-100002, 9"), ("a", 2, None, "12345678901234567891-12345678901234567889")])
    assert len(got["a", 1]) == 100_004 and got["a", 1][:3] == ["5", "1", "2"] and got["a", 1][-2:] == ["100002", "9"]
    assert got["a", 2] == ["12345678901234567889", "12345678901234567890", "12345678901234567891"]
