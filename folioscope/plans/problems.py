"""Queries of the general data problems (4 and 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.packed import split_marks
from folioscope.operators.units import converted
from folioscope.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_marks(table(spark, sf_dir, "marks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted(table(spark, sf_dir, "numeric_facts"), table(spark, sf_dir, "metric_dims"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p6_found": p6_found}
SQL: dict[str, str] = {}
