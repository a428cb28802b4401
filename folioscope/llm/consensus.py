"""Consensus from several judges' votes by spectral reliability.

An annotator is a judge in one position. Votes are yes (+1) or no (-1); each annotator's votes are centred by its own chance
level (mean vote). For annotators i, j with N_ij common items the agreement matrix is C_ij = S_ij / N_ij, S_ij the sum of
products of centred votes. If errors are independent given the truth, C_ij = g_i g_j off the diagonal, so g is the leading
eigenvector; power iteration by sparse joins, every entry weighted by its overlap:
    g_i <- sum_j S_ij g_j / sum_j N_ij g_j^2   (j != i).
With the share of yes items, g and the mean vote give every annotator's hit rates on yes and on no items, whose
log-likelihood ratios weigh the votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import written

#: Iterations end when nothing moves by more than this in a round; needing more rounds than that is an error.
STILL, MOST_ROUNDS = 1e-4, 200
POSITIONS = ["claim_first", "evidence_first"]
YES, NO = ["yes", "y", "true", "1", "是"], ["no", "n", "false", "0", "否"]


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, r"[\s\u00a0\u200b\ufeff]+", " ")), r"[\s\-]+", "_"))


def readable_votes(judgments: DataFrame) -> DataFrame:
    """(item, annotator, judge, position, v): the last readable vote (+1, -1) of a judge in a position on an item.

    Rows with null or unknown position, without item or judge, or with another verdict than yes or no in any notation, are no
    votes. Repeated rows and repeated votes count once; later judged_at, then higher seq, wins.
    """
    verdict = _plain(F.col("verdict"))
    j = judgments.select(
        F.col("finding_id").alias("item"), _plain(F.col("judge_model")).alias("judge"), _plain(F.col("position")).alias("position"),
        F.when(verdict.isin(YES), 1.0).when(verdict.isin(NO), -1.0).alias("v"), F.struct("judged_at", "seq").alias("at"),
    )
    j = j.where(F.col("item").isNotNull() & (F.col("judge") != "") & F.col("position").isin(POSITIONS) & F.col("v").isNotNull())
    j = j.groupBy("item", "judge", "position").agg(F.max(F.struct("at", "v")).alias("last"))
    return j.select("item", F.concat_ws(":", "judge", "position").alias("annotator"), "judge", "position", F.col("last.v").alias("v"))


def agreement_matrix(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((annotator, n, mean), (i, j, s, n)) of votes (item, annotator, v); the matrix has both triangles and no diagonal.

    An item holds at most one vote per annotator, so its pairs are bounded by the annotators; they are summed before the shuffle.
    """
    means = votes.groupBy("annotator").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    centred = votes.join(means.select("annotator", "mean"), "annotator").select("item", "annotator", (F.col("v") - F.col("mean")).alias("x"))
    rows = centred.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", "x"))).alias("a"))
    left = rows.select("a", F.posexplode("a").alias("k", "p"))
    pairs = left.select(F.col("p.annotator").alias("i"), F.col("p.x").alias("xi"), F.explode(F.slice("a", F.col("k") + 2, F.size("a"))).alias("q"))
    upper = pairs.groupBy("i", F.col("q.annotator").alias("j")).agg(F.sum(F.col("xi") * F.col("q.x")).alias("s"), F.count("*").alias("n"))
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return means, upper.select(both.alias("e"), "s", "n").select("e.i", "e.j", "s", "n")


def spectral_reliability(votes: DataFrame) -> DataFrame:
    """(annotator, n, mean, g): g is the annotator's coordinate of the scaled leading eigenvector, negative for one worse than chance.

    An annotator with no item in common with another has g 0. With fewer than three annotators reliability can't be told from
    votes; agreement with the others then gives g. Two steps of the iteration bring g back to its scale, so every second one is
    compared with the last.
    """
    means, matrix = agreement_matrix(votes)
    means, matrix = written(means, "annotators"), written(matrix, "agreement")
    g = means.select(F.col("annotator").alias("j"), F.lit(1.0).alias("gj"))
    for _ in range(MOST_ROUNDS):
        new = g
        for _ in range(2):
            new = matrix.join(new, "j").groupBy("i").agg((F.sum(F.col("s") * F.col("gj")) / F.nullif(F.sum(F.col("n") * F.col("gj") * F.col("gj")), F.lit(0.0))).alias("gj")).select(F.col("i").alias("j"), F.coalesce("gj", F.lit(0.0)).alias("gj"))
        new = written(new.join(g.withColumnRenamed("gj", "before"), "j"), "eigenvector")
        moved = new.agg(F.max(F.abs(F.col("gj") - F.col("before"))).alias("by"), F.max(F.abs("gj")).alias("most")).first()
        g = new.select("j", "gj")
        if (moved["by"] or 0.0) <= STILL * max(1.0, moved["most"] or 0.0):
            break
    else:
        raise RuntimeError("the power iteration did not settle")
    pair = matrix.join(g, "j").join(g.select(F.col("j").alias("i"), F.col("gj").alias("gi")), "i")
    fit = pair.agg(F.sum(F.col("s") * F.col("gi") * F.col("gj")).alias("a"), F.sum(F.col("n") * (F.col("gi") * F.col("gj")) ** 2).alias("b"), F.sum(F.col("n") * F.col("gi")).alias("sign")).first()
    scale = math.sqrt(max(fit["a"] or 0.0, 0.0) / fit["b"]) if fit and fit["b"] else 0.0
    scale = -scale if fit and (fit["sign"] or 0) < 0 else scale
    return means.join(g.withColumnRenamed("j", "annotator"), "annotator", "left").select("annotator", "n", "mean", (F.coalesce("gj", F.lit(0.0)) * scale).alias("g"))


def _rates(b: float) -> tuple[Column, Column]:
    """Hit rates on yes and no items from g and the mean vote, for a mean truth of b; kept within what n votes can show."""
    d = F.col("g") / math.sqrt(max(1 - b * b, 1e-6))
    a = F.col("mean") - b * d
    edge = F.least(F.lit(0.25), 1.0 / (F.col("n") + 2.0))
    bound = lambda x: F.greatest(edge, F.least(1 - edge, x))
    return bound((1 + a + d) / 2), bound((1 - a + d) / 2)


def _posterior(votes: DataFrame, model: DataFrame, b: float) -> DataFrame:
    yes, no = _rates(b)
    weights = model.select("annotator", F.log(yes / (1 - no)).alias("w_yes"), F.log((1 - yes) / no).alias("w_no"))
    scored = votes.join(weights, "annotator").withColumn("w", F.when(F.col("v") > 0, F.col("w_yes")).otherwise(F.col("w_no")))
    prior = math.log((1 + b) / (1 - b))
    sums = scored.groupBy("item").agg(F.count("*").alias("n_votes"), F.sum("w").alias("w"), F.avg("v").alias("raw_mean"), F.sum(F.abs("w")).alias("weight"))
    return sums.select("item", "n_votes", "raw_mean", (F.col("w") + prior).alias("log_odds"), F.when(F.col("weight") > 0, F.abs("w") / F.col("weight")).otherwise(0.0).alias("agreement"))


def consensus(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((item, verdict, confidence, agreement, n_votes), (annotator, n_votes, reliability, hit_yes, hit_no)) of votes (item, annotator, v).

    agreement is 1 where all weighted votes point one way and 0 where they cancel out. Exact ties are `no`. Without votes both
    are empty.
    """
    votes = written(votes.select("item", "annotator", "v"), "votes")
    model = written(spectral_reliability(votes), "reliability")
    b = 0.0
    for _ in range(MOST_ROUNDS):  # the share of yes items that the votes tell, given itself
        mean = _posterior(votes, model, b).agg(F.avg(F.tanh(F.col("log_odds") / 2)).alias("b")).first()["b"]
        b, before = max(-0.95, min(0.95, mean or 0.0)), b
        if abs(b - before) <= STILL * 10:
            break
    else:
        raise RuntimeError("the share of yes items did not settle")
    items = _posterior(votes, model, b)
    sure = 1 / (1 + F.exp(-F.abs("log_odds")))
    items = items.select("item", F.when(F.col("log_odds") > 0, "yes").otherwise("no").alias("verdict"), sure.alias("confidence"), "agreement", "n_votes")
    yes, no = _rates(b)
    return items, model.select("annotator", F.col("n").alias("n_votes"), F.col("g").alias("reliability"), yes.alias("hit_yes"), no.alias("hit_no"))


def finding_votes(findings: DataFrame, judgments: DataFrame) -> DataFrame:
    """Readable votes on ids that are findings."""
    ids = findings.select(F.col("id").alias("item")).where("item is not null").distinct()
    return readable_votes(judgments).join(ids, "item", "left_semi")
