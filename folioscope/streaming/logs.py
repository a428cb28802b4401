"""Append logs as streams: windows with a watermark, rows once per key, last row per key in a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """A stream of event files of a folder; broken JSON lines become rows of nulls and are dropped."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)
    return events.where("event_id is not null")


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): tumbling windows of event time; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Every event_id once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): sessions of a user by event time."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_last(events: DataFrame) -> DataFrame:
    """(user_id, event_type, value, n): the last event of every user, updated with every batch; state is one row a user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, event, kind, value, n = state.get if state.exists else (-1, -1, None, None, 0)
        for b in batches:
            b = b.assign(us=b["ts"].astype("int64"))
            n += len(b)
            top = b.sort_values(["us", "event_id"]).iloc[-1]
            if (int(top["us"]), int(top["event_id"])) > (at, event):
                at, event, kind, value = int(top["us"]), int(top["event_id"]), top["event_type"], float(top["value"])
        state.update((at, event, kind, value, n))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [kind], "value": [value], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_type string, value double, n bigint", "at bigint, event bigint, kind string, value double, n bigint", "update", GroupStateTimeout.NoTimeout)


#: Parts of a kept table by hash of its key.
PARTS = 64


def keep_last(events: DataFrame, table: str, checkpoint: str):
    """Start a query that keeps the last event of every user as a Parquet table, split into PARTS by hash of the user.

    A batch rewrites only the parts whose users it holds; doing it again after a failure gives the same rows. A new state is
    written beside the table before it takes its place.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("user_id", "ts", "event_id", "event_type", "value", F.pmod(F.xxhash64("user_id"), F.lit(PARTS)).cast("int").alias("part"))
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most PARTS rows
        if not touched:
            return
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            new = new.unionByName(spark.read.parquet(table).where(F.col("part").isin(touched)).select(new.columns))
        last = new.groupBy("part", "user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("x"))
        last.select("part", "user_id", "x.*").write.mode("overwrite").parquet(f"{table}-next")
        stage = spark.read.parquet(f"{table}-next")
        stage.write.mode("overwrite").partitionBy("part").option("partitionOverwriteMode", "dynamic").parquet(table)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}-next"), True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
