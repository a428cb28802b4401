"""Reports written by Spark: one Markdown text or JSON object a manuscript, findings split by the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import norm_ws
from folioscope.operators.findings import severity_rank


def markdown(findings: DataFrame) -> DataFrame:
    """(doc_id, n, report): findings by severity, then confidence and seq, one line each."""
    f = findings.dropDuplicates(["id"])
    line = F.concat(F.lit("- **"), F.coalesce("severity", F.lit("?")), F.lit("** "), F.coalesce("issue_type", F.lit("other")), F.lit(" ("), F.coalesce(F.array_join("block_ids", ", ", "?"), F.lit("?")), F.lit("): "), norm_ws(F.coalesce("rationale", "verbatim_quote", F.lit(""))))
    key = F.struct(severity_rank(F.col("severity")).alias("s"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), "seq", line.alias("line"))
    g = f.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("a"))
    return g.select("doc_id", "n", F.concat(F.lit("# "), F.col("doc_id"), F.lit("\n\n"), F.array_join(F.transform("a", lambda x: x.line), "\n")).alias("report"))


def json_rows(findings: DataFrame) -> DataFrame:
    """(doc_id, value): each finding as a JSON object."""
    f = findings.dropDuplicates(["id"])
    return f.select("doc_id", F.to_json(F.struct(*[c for c in f.columns if c != "doc_id"])).alias("value"))


def write_split(findings: DataFrame, path: str) -> None:
    """Findings as Parquet, one folder for those that passed the gate and one for the rest."""
    findings.withColumn("gate_passed", F.coalesce("gate_passed", F.lit(False))).write.partitionBy("gate_passed").parquet(path)
