"""Votes of a panel of judges on findings: validation, four-state verdicts, agreement and what is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

POSITIONS = ["claim_first", "evidence_first"]
VOTES = ["yes", "no", "cannot_assess"]
VERDICTS = ["confirmed", "contested", "refuted", "unverifiable"]


def name(c: Column) -> Column:
    """A judge, position or vote as written, in one notation."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def judgments_of(judgments: DataFrame) -> DataFrame:
    j = judgments.dropDuplicates(["doc_id", "seq"])
    return j.select("doc_id", "seq", "finding_id", F.lower(F.trim("judge_model")).alias("judge"), name(F.col("position")).alias("position"), name(F.col("verdict")).alias("vote"), "judged_at", "arrived_at")


def checked(judgments: DataFrame, findings: DataFrame) -> DataFrame:
    """judgments_of with error, the first rule that a judgment breaks, null if none; of several votes of one judge in one position on a finding the first stands."""
    ids = findings.select(F.col("id").alias("finding_id")).distinct().withColumn("known", F.lit(True))
    j = judgments_of(judgments).join(ids, "finding_id", "left")
    repeat = F.row_number().over(W.partitionBy("finding_id", "judge", "position").orderBy("doc_id", "seq"))
    error = (
        F.when(F.col("known").isNull(), "unknown finding").when(F.coalesce("judge", F.lit("")) == "", "no judge").when(~F.coalesce(F.col("position").isin(POSITIONS), F.lit(False)), "unknown position")
        .when(~F.coalesce(F.col("vote").isin(VOTES), F.lit(False)), "unknown vote").when(F.col("turn") > 1, "repeated")
    )
    return j.withColumn("turn", repeat).withColumn("error", error).drop("known", "turn")


def errors(judgments: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, seq, error) of the judgments that break a rule."""
    return checked(judgments, findings).where("error is not null").select("doc_id", "seq", "error")


def sound(judgments: DataFrame, findings: DataFrame) -> DataFrame:
    return checked(judgments, findings).where("error is null").drop("error")


def verdicts(judgments: DataFrame, findings: DataFrame, required: int = 2) -> DataFrame:
    """(finding_id, verdict, n_judges, n_votes, n_yes, n_no): four-state verdict of every finding.

    Too few judges, a judge who did not vote in both positions, or abstentions only: unverifiable. Some abstentions or
    disagreement: contested. All yes: confirmed. All no: refuted.
    """
    v = sound(judgments, findings).groupBy("finding_id").agg(
        F.count_distinct("judge").alias("n_judges"), F.count("*").alias("n_votes"), *[F.count_if(F.col("vote") == x).alias(f"n_{x}") for x in VOTES],
    )
    n = findings.select(F.col("id").alias("finding_id")).distinct().join(v, "finding_id", "left").fillna(0)
    verdict = (
        F.when((F.col("n_judges") < required) | (F.col("n_votes") < 2 * F.col("n_judges")) | (F.col("n_cannot_assess") == F.col("n_votes")), "unverifiable").when(F.col("n_cannot_assess") > 0, "contested")
        .when(F.col("n_yes") == F.col("n_votes"), "confirmed").when(F.col("n_no") == F.col("n_votes"), "refuted").otherwise("contested")
    )
    return n.select("finding_id", verdict.alias("verdict"), "n_judges", "n_votes", "n_yes", "n_no")


def summary(judgments: DataFrame, findings: DataFrame) -> DataFrame:
    """(verdict, n): all four verdicts, those of no finding with 0."""
    spark = judgments.sparkSession
    all_ = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    n = verdicts(judgments, findings).groupBy("verdict").agg(F.count("*").alias("n"))
    return F.broadcast(all_).join(n, "verdict", "left").fillna(0, ["n"])


def open_votes(judgments: DataFrame, findings: DataFrame) -> DataFrame:
    """(finding_id, judge, position): positions in which a judge who voted on a finding has still to vote."""
    v = sound(judgments, findings).select("finding_id", "judge", "position").distinct()
    want = v.select("finding_id", "judge").distinct().select("finding_id", "judge", F.explode(F.array(*map(F.lit, POSITIONS))).alias("position"))
    return want.join(v, ["finding_id", "judge", "position"], "left_anti")


def latest(judgments: DataFrame) -> DataFrame:
    """(finding_id, judge, position, vote, n): the last judgment by time and seq of each judge in each position."""
    j = judgments_of(judgments).where("finding_id is not null and judge is not null and position is not null")
    g = j.groupBy("finding_id", "judge", "position").agg(F.max_by("vote", F.struct("judged_at", "seq")).alias("vote"), F.count("*").alias("n"))
    return g


def judge_rates(judgments: DataFrame, findings: DataFrame) -> DataFrame:
    """(judge, position, n, share_yes, share_abstained, median_delay): how each judge votes in each position; delay in seconds from judging to arrival."""
    j = sound(judgments, findings)
    delay = F.unix_timestamp("arrived_at") - F.unix_timestamp("judged_at")
    return j.groupBy("judge", "position").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("vote") == "yes").cast("double")), 6).alias("share_yes"), F.round(F.avg((F.col("vote") == "cannot_assess").cast("double")), 6).alias("share_abstained"),
        F.round(F.avg(delay), 3).alias("mean_delay"),
    )


def position_flips(judgments: DataFrame, findings: DataFrame) -> DataFrame:
    """(judge, n_both, n_flipped): how often a judge answers otherwise when the evidence comes first."""
    v = sound(judgments, findings).where("vote in ('yes', 'no')").groupBy("finding_id", "judge").pivot("position", POSITIONS).agg(F.first("vote"))
    both = v.where("claim_first is not null and evidence_first is not null")
    return both.groupBy("judge").agg(F.count("*").alias("n_both"), F.count_if(F.col("claim_first") != F.col("evidence_first")).alias("n_flipped"))
