"""Checks on numeric statements (`numeric_facts` by fact_id, `blocks` with cell_rows, body texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import plain

NUMBER = r"((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"


def facts_of(facts: DataFrame) -> DataFrame:
    return facts.dropDuplicates(["fact_id"])


def number(text: Column) -> Column:
    """A number in text without thousands separators; null if there is none."""
    return F.replace(F.regexp_extract(text, NUMBER, 1), F.lit(","), F.lit("")).try_cast("double")


def parsed(facts: DataFrame) -> DataFrame:
    """(fact_id, parsed, agrees): the number read from raw against the stored value; agrees is null where either is missing."""
    v = number(F.col("raw"))
    return facts_of(facts).where("kind = 'value'").select("fact_id", v.alias("parsed"), (F.abs(v - F.col("value")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("value"))).alias("agrees"))


def significance(facts: DataFrame) -> DataFrame:
    """(fact_id, operator, value, significant): p values read from raw; significant is null where the statement leaves it open."""
    op = F.regexp_extract("raw", r"p\s*(<=|>=|≤|≥|<|>|=)", 1)
    op = F.when(op == "≤", "<=").when(op == "≥", ">=").when(op == "", "=").otherwise(op)
    v = F.regexp_extract("raw", r"p\s*(?:<=|>=|≤|≥|<|>|=)\s*(\d*\.?\d+)", 1).try_cast("double")
    p = facts_of(facts).where("kind = 'p_value'").select("fact_id", op.alias("operator"), F.coalesce(v, F.col("value")).alias("value"))
    below = F.when(F.col("value") > 0.05, False).when((F.col("operator") == "<=") | (F.col("value") < 0.05), True)
    above = F.when(F.col("value") >= 0.05, False)
    s = F.when(F.col("operator").isin("<", "<="), below).when(F.col("operator").isin(">", ">="), above).otherwise(F.col("value") < 0.05)
    return p.select("fact_id", "operator", "value", s.alias("significant"))


def out_of_range(facts: DataFrame) -> DataFrame:
    """(fact_id, kind, value): p values outside 0 to 1, confidence levels outside 0 to 100, sample sizes below one, intervals upside down."""
    f = facts_of(facts)
    bad = (
        ((F.col("kind") == "p_value") & ~F.col("value").between(0, 1)) | ((F.col("kind") == "sample_size") & (F.col("value") < 1))
        | ((F.col("kind") == "ci") & ((F.col("ci_interval.low") > F.col("ci_interval.high")) | ~F.col("confidence_level").between(0, 100)))
    )
    return f.where(bad).select("fact_id", "kind", "value")


def sample_sizes(facts: DataFrame) -> DataFrame:
    """(doc_id, n_facts, n_distinct, smallest, largest) of the sample sizes of a document."""
    f = facts_of(facts).where("kind = 'sample_size' and value is not null")
    return f.groupBy("doc_id").agg(F.count("*").alias("n_facts"), F.count_distinct("value").alias("n_distinct"), F.min("value").alias("smallest"), F.max("value").alias("largest"))


def conflicts(facts: DataFrame) -> DataFrame:
    """(doc_id, metric, unit, n_values, n_facts, low, high): metrics of which a document states several values in one unit, by name without unit and case."""
    name = F.trim(F.regexp_replace(F.lower(F.regexp_replace("metric", r"\s*[\[(,].*$", "")), r"^(mean|median|average)\s+", ""))
    f = facts_of(facts).where("kind = 'value' and value is not null and metric is not null")
    f = f.select("doc_id", name.alias("metric"), F.lower(F.trim(F.coalesce("unit", F.lit("")))).alias("unit"), F.round("value", 10).alias("value"))
    g = f.groupBy("doc_id", "metric", "unit").agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n_facts"), F.min("value").alias("low"), F.max("value").alias("high"))
    return g.where("n_values >= 2")


def metric_families(facts: DataFrame) -> DataFrame:
    """(family, n_facts, n_docs): facts by the measure that their metric names."""
    m = F.lower("metric")
    family = F.when(m.rlike(r"precision|精确率"), "precision").when(m.rlike(r"recall|sensitivity|召回"), "recall").when(m.rlike(r"\bf-?1\b|f值"), "f1").when(m.rlike(r"accura|准确"), "accuracy").otherwise("other")
    return facts_of(facts).where("kind = 'value'").groupBy(family.alias("family")).agg(F.count("*").alias("n_facts"), F.count_distinct("doc_id").alias("n_docs"))


def interval_checks(facts: DataFrame) -> DataFrame:
    """(fact_id, other, inside): confidence intervals against the values of the same metric in the same block."""
    f = facts_of(facts)
    ci = f.where("kind = 'ci'").select("doc_id", "block_id", F.lower("metric").alias("m"), F.col("fact_id"), F.col("ci_interval.low").alias("low"), F.col("ci_interval.high").alias("high"))
    v = f.where("kind = 'value' and value is not null").select("doc_id", "block_id", F.lower("metric").alias("m"), F.col("fact_id").alias("other"), "value")
    return ci.join(v, ["doc_id", "block_id", "m"]).select("fact_id", "other", F.col("value").between(F.col("low"), F.col("high")).alias("inside"))


def cells(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, row_no, col_no, header, row_label, cell, value): tables as one row a body cell."""
    b = blocks.dropDuplicates(["doc_id", "block_id"]).where("size(cell_rows) > 1")
    r = b.select("doc_id", "block_id", F.element_at("cell_rows", 1).alias("head"), F.posexplode(F.slice("cell_rows", 2, F.size("cell_rows"))).alias("r", "row"))
    c = r.select("doc_id", "block_id", "head", (F.col("r") + 1).alias("row_no"), F.try_element_at("row", F.lit(1)).alias("row_label"), F.posexplode("row").alias("c", "cell"))
    header = F.try_element_at("head", F.col("c") + 1)
    return c.select("doc_id", "block_id", "row_no", (F.col("c") + 1).alias("col_no"), header.alias("header"), "row_label", "cell", F.replace(F.trim("cell"), F.lit(","), F.lit("")).try_cast("double").alias("value"))


TOTAL = r"(?i)^\s*(total|sum|overall|all|合计|总计)\b|^(合计|总计)"


def table_totals(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, header, parts, stated, right): columns of a table with the sum of their parts and the stated total (null without one)."""
    c = cells(blocks).where("value is not null and col_no > 1")
    is_total = F.coalesce(F.col("row_label").rlike(TOTAL), F.lit(False))
    g = c.groupBy("doc_id", "block_id", "header").agg(F.round(F.sum(F.when(~is_total, F.col("value"))), 6).alias("parts"), F.max(F.when(is_total, F.col("value"))).alias("stated"))
    return g.select("doc_id", "block_id", "header", "parts", "stated", (F.abs(F.col("parts") - F.col("stated")) < 1e-6).alias("right"))


def body_numbers(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, n_numbers, n_years, n_percent, total): numbers in body texts."""
    b = blocks.dropDuplicates(["doc_id", "block_id"]).where("not is_bibliography and text is not null")
    found = F.regexp_extract_all("text", F.lit(NUMBER), 1)
    years = F.size(F.filter(found, lambda x: x.rlike(r"^(19\d\d|20\d\d|2100)$")))
    return b.select("doc_id", "block_id", F.size(found).alias("n_numbers"), years.alias("n_years"), F.size(F.regexp_extract_all("text", F.lit(NUMBER + r"\s*[%％]"), 1)).alias("n_percent")).where("n_numbers > 0")


def statement_findings(facts: DataFrame) -> DataFrame:
    """(doc_id, issue, n): conflicting values, impossible values and values outside their interval."""
    f = facts_of(facts).select("fact_id", "doc_id")
    a = conflicts(facts).select("doc_id", F.lit("conflict").alias("issue"))
    b = out_of_range(facts).join(f, "fact_id").select("doc_id", F.lit("range").alias("issue"))
    c = interval_checks(facts).where("not inside").join(f, "fact_id").select("doc_id", F.lit("interval").alias("issue"))
    return a.unionByName(b).unionByName(c).groupBy("doc_id", "issue").agg(F.count("*").alias("n"))


def context_keys(facts: DataFrame) -> DataFrame:
    """(fact_id, context_key): the words of a fact's context without its metric and numbers."""
    words = F.regexp_replace(plain(F.col("context")), r"\d+", " ")
    return facts_of(facts).select("fact_id", F.trim(F.regexp_replace(F.replace(words, plain(F.col("metric")), F.lit(" ")), " +", " ")).alias("context_key"))
