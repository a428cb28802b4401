from fractions import Fraction

import pytest

from folioscope.operators.units import converted, metric_key, quantity, to_base_units, unit_spans

DIMS = [("response latency", "duration", "us"), ("accuracy", "proportion", "ppm"), ("skin temperature", "temperature", "mdegC"), ("lesion diameter", "length", "um"), ("corpus size", "quantity", "count"), ("体重", "mass", "ug")]
SCHEMA = "fact_id bigint, metric string, value double, unit string, context string, raw string, kind string, base_unit string"


def run(spark, rows, operator=converted):
    facts = spark.createDataFrame([(i, *r, "value", "x") for i, r in enumerate(rows)], SCHEMA)
    dims = spark.createDataFrame(DIMS, "metric string, dimension string, base_unit string")
    return {r.fact_id: (r.base_unit, r.base_value) for r in operator(facts, dims).collect()}


def test_fields_in_order(spark):
    rows = [
        ("Response Latency", 2.0, " Sec ", None, "2"),
        ("mean response latency", None, None, None, "1 h 2 min"),
        ("response latency [ms]", 3.5, "", "", "3.5"),
        ("response latency", 4.0, None, "All times in ms. The response latency was 4 at site 2.", "4"),
        ("response latency", 4.0, "µs", None, "4 µs"),
        ("accuracy", 0.5, None, "The accuracy was 0.5 in the set.", "0.5"),
        ("accuracy, per 100 000", 1.0, "", None, "1"),
        ("skin temperature", None, "", None, "９８.６ °F"),
        ("lesion diameter", 0.3, "", "The lesion diameter was 0.3 in the control arm.", "0.3"),
        ("lesion diameter", 2.0, None, None, "2 in"),
        ("corpus size", 8.0, "M", None, "8M"),
        ("corpus size", 8.0, None, None, "8"),
        ("体重", 70.0, "公斤", "体重为70公斤。", "70公斤"),
        ("unheard of", 1.0, "kg", None, None),
        (None, None, None, None, None),
        ("accuracy", None, "%", None, None),
    ]
    assert run(spark, rows) == {
        0: ("us", 2_000_000), 1: ("us", 3_720_000_000), 2: ("us", 3500), 3: ("us", 4000), 5: ("ppm", 500_000), 6: ("ppm", 10), 7: ("mdegC", 37_000),
        9: ("um", 50_800), 10: ("count", 8_000_000), 12: ("ug", 70 * 10**9),
    }


def test_base_units_keep_their_value(spark):
    assert run(spark, [("response latency", 4.4, "us", None, "4.4 us")], to_base_units) == {0: ("us", 4)}


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    dims = spark.createDataFrame(DIMS + DIMS, "metric string, dimension string, base_unit string")
    one = (7, "accuracy", 1.0, "%", None, None, "value", "x")
    assert converted(spark.createDataFrame([one, one], SCHEMA), dims).count() == 1


def test_long_text(spark):
    assert run(spark, [("accuracy", 5.0, None, "filler words " * 20_000 + "accuracy was 5 % today", "5")]) == {0: ("ppm", 50_000)}


@pytest.mark.parametrize("text,dimension,want", [("mg/dL", "concentration", ["mg/dL"]), ("mg/dL", "mass", []), ("mm Hg", "pressure", ["mmHg"]), ("min", "duration", ["min"]), ("minute hand", "duration", ["min"]), ("admin", "duration", [])])
def test_longest_free_alias(text, dimension, want):
    assert [u for _, _, u in unit_spans(text, dimension)] == want


def test_metric_names():
    assert metric_key("Mean Accuracy in per 100 000") == "accuracy" and metric_key("skin temperature (°C)") == "skin temperature"
    assert quantity(None, "", "", "1,506.7 mm", "", "length") == (Fraction("1506.7"), "mm")
