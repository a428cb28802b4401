"""Sessions, tables and intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(sc, "_folioscope_dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="folioscope-")
            sc._folioscope_dir = folder
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of executors, is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `written` that a later one has replaced."""
    for t in tables:
        if path := getattr(t, "_folioscope_path", None):
            p, fs = _path(t.sparkSession, path)
            fs.delete(p, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many partitions as the session shuffles to, for CPU-bound work on few input files; a scan of enough partitions stays as it is."""
    sc = df.sparkSession.sparkContext
    if not keys and "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.rdd.getNumPartitions() >= sc.defaultParallelism:
        return df
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism)
    return df.repartition(n, *keys) if keys else df.repartition(n)
