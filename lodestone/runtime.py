"""Session helpers: shared folders, lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and Spark runs in one process.
LOCAL_FALLBACK = "/tmp/checkpoints/lodestone"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(LOCAL_FALLBACK)
    return LOCAL_FALLBACK


#: Paths of the tables that `saved` has written in this process, in order.
_WRITTEN: list[str] = []


def saved_so_far() -> int:
    return len(_WRITTEN)


def drop_saved(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables saved after the first `since`, before the JVM's end; how many were there."""
    paths, n = _WRITTEN[since:], 0
    for path in filter(None, paths):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        n += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN[since:] = [""] * len(paths)
    return n


def saved(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The new plan has no lineage to recompute, and its files outlive executors.
    They are deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended; else they stay until the driver's memory runs short.

    One round alone was seen to leave them: the last query's plan is still held while it runs.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
