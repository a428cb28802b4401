"""Queries of the language data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.consensus import consensus, finding_votes
from folioscope.llm.encode import encode
from folioscope.llm.language import identify, relabelled
from folioscope.llm.link import link
from folioscope.llm.lookalike import canonical_texts, hidden_quotes
from folioscope.llm.names import resolve_names, same_names
from folioscope.llm.neardup import duplicate_classes, duplicate_pairs
from folioscope.llm.packing import pack
from folioscope.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_names(table(spark, sf_dir, "citation_records").dropDuplicates(["rec_id"]))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_names(table(spark, sf_dir, "citation_records").dropDuplicates(["rec_id"]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_links(spark, sf_dir).select("rec_id", "identifier")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "citation_records"), table(spark, sf_dir, "resolver_metadata"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus(finding_votes(table(spark, sf_dir, "findings"), table(spark, sf_dir, "judgments")))
    return items.select(F.col("item").alias("finding_id"), "verdict")


def p3_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, judges = consensus(finding_votes(table(spark, sf_dir, "findings"), table(spark, sf_dir, "judgments")))
    return judges


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = duplicate_pairs(table(spark, sf_dir, "findings"), "id", ["verbatim_quote", "rationale"])
    return pairs.select(F.col("a").alias("finding_a"), F.col("b").alias("finding_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "findings"), "id", ["verbatim_quote", "rationale"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_quotes(table(spark, sf_dir, "findings"), table(spark, sf_dir, "blocks"))


def p7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding's quote in its canonical spelling and in the form that look-alike texts share."""
    quotes = table(spark, sf_dir, "findings").select("id", F.col("verbatim_quote").alias("text")).dropDuplicates(["id"])
    forms = canonical_texts(quotes, table(spark, sf_dir, "blocks").select("text"))
    return forms.select(F.col("id").alias("finding_id"), "canonical", "form")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "packing_profiles"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "language_codes"))


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "language_codes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_entities": p1_entities, "p2_found": p2_found, "p2_links": p2_links, "p3_found": p3_found, "p3_judges": p3_judges, "p5_found": p5_found, "p5_classes": p5_classes, "p7_found": p7_found, "p7_quotes": p7_quotes, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_languages": p10_languages}
SQL: dict[str, str] = {}
