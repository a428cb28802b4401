"""Append logs: sessions by gap, windows of event time, last row per key, bulk set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """(user_id, session_no, n, seconds): a user's events, a new session after more than the gap without one.

    Windows run over one day of one user; the days are then chained by their last events and numbers of starts, so a user with a
    third of all rows is no single task.
    """
    e = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    days = e.groupBy("user_id", "day").agg(F.max("us").alias("last"))
    days = days.select("user_id", "day", F.lag("last").over(W.partitionBy("user_id").orderBy("day")).alias("before"))
    w = W.partitionBy("user_id", "day").orderBy("us", "event_id")
    e = e.join(days, ["user_id", "day"]).withColumn("before", F.coalesce(F.lag("us").over(w), "before"))
    e = e.withColumn("start", F.coalesce((F.col("us") - F.col("before") > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    e = e.withColumn("inside", F.sum("start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    starts = e.groupBy("user_id", "day").agg(F.sum("start").alias("starts"))
    chain = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("user_id", "day", F.coalesce(F.sum("starts").over(chain), F.lit(0)).alias("offset"))
    e = e.join(starts, ["user_id", "day"]).withColumn("session_no", F.col("inside") + F.col("offset"))
    return e.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.round((F.max("us") - F.min("us")) / 1e6, 3).alias("seconds"))


def hourly(events: DataFrame) -> DataFrame:
    """(hour, event_type, n, total, users): tumbling windows of an hour."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


def last_rows(events: DataFrame) -> DataFrame:
    """(user_id, event_type, value, n): the last event of every user by time and id."""
    last = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", last).alias("event_type"), F.max_by("value", last).alias("value"), F.count("*").alias("n"))


def recovered_json(events: DataFrame) -> DataFrame:
    """(event_type, k, n): the value of a JSON payload inside any text around it."""
    inner = F.regexp_extract("props", r"(?s)(\{.*\})", 1)
    return events.select("event_type", F.get_json_object(inner, "$.k").try_cast("int").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


def late_rows(records: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, n_records, n_findings, n_late): per manuscript what arrived over a week after the manuscript's first row of the kind."""
    r = records.dropDuplicates(["rec_id"]).select("doc_id", F.col("ingested_at").alias("at"))
    start = r.groupBy("doc_id").agg(F.min("at").alias("start"), F.count("*").alias("n_records"))
    late = r.join(start, "doc_id").where(F.unix_micros("at") - F.unix_micros("start") > 7 * 86_400 * 1_000_000).groupBy("doc_id").agg(F.count("*").alias("n_late"))
    f = findings.dropDuplicates(["id"]).groupBy("doc_id").agg(F.count("*").alias("n_findings"))
    return start.drop("start").join(f, "doc_id", "left").join(late, "doc_id", "left").fillna(0, ["n_findings", "n_late"])


def only_in_body(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, block_id): blocks with a bracket in their body text but without a citation mark (set difference)."""
    b = blocks.where("not is_bibliography and text rlike '\\\\[\\\\d'").select("doc_id", "block_id").distinct()
    return b.exceptAll(marks.select("doc_id", "block_id").distinct())


def shared_manuscripts(blocks: DataFrame, findings: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id): manuscripts with blocks, findings and documents (set intersection)."""
    d = documents.select(F.col("ms_id").alias("doc_id")).where("doc_id is not null")
    return blocks.select("doc_id").intersect(findings.select("doc_id")).intersect(d)


def document_profile(documents: DataFrame) -> DataFrame:
    """(doc_kind, source_share, n, n_null, n_chars, n_equal): documents by kind, and how many texts another document repeats."""
    d = documents.dropDuplicates(["doc_id"]).withColumn("h", F.sha1("text"))
    equal = d.where("h is not null").groupBy("h").agg(F.count("*").alias("copies"))
    j = d.join(equal, "h", "left")
    return j.groupBy("doc_kind").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("n_null"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"), F.count_if(F.col("copies") > 1).alias("n_equal"))


def order_summary(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """(o_orderpriority, l_returnflag, n, quantity, revenue): a star join and its aggregate."""
    j = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"])
    return j.groupBy("o_orderpriority", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"))
