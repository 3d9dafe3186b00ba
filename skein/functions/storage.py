"""Snapshots of tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With it Spark drops a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Partitions that shuffles begin with under adaptive execution.
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Shuffled bytes that adaptive execution puts into a task, and as many as spread() lets it.
ADVISORY, TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where everything runs in one process may it be unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "skein-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def spread(spark: SparkSession, path: str, size: int = 2 << 20) -> None:
    """From now on shuffles begin with a partition for every ``size`` bytes of the files in ``path`` at least.

    A number that is fixed makes tasks grow with the input. Adaptive execution puts small partitions together
    again, so small inputs keep few tasks; where it is off the session's own number holds.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    key = INITIAL
    most = max(int(spark.conf.get(key, None) or 0), int(spark.conf.get("spark.sql.shuffle.partitions")), -(-there // size))
    spark.conf.set(key, str(most))
    if spark.conf.get(ADVISORY, None) in (None, "64MB", "67108864b"):  # a task sorts some ten times the compressed bytes that it reads
        spark.conf.set(ADVISORY, str(TASK_BYTES))


def tasks(spark: SparkSession) -> int:
    """Tasks for what makes many rows of few: by the bytes that spread() saw, one a core at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get(INITIAL, None) or 0))


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df``, of narrow rows, with a broadcast hint if it has at most ``limit``, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends here and lost executors cost nothing."""
    return snapshot(spark, df, fresh(spark, name))


def snapshot(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """A version of a table: published by handing on its path, so readers never see half of it.

    What was shuffled for it goes at once, so that a job of many steps holds the shuffle files of one step.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a snapshot that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Rounds:
    """Snapshots of a loop, each read by the next round only: the last two stay, older ones are deleted."""

    def __init__(self, spark: SparkSession, name: str, write=snapshot):
        self.spark, self.name, self.write, self.paths = spark, name, write, []

    def put(self, df: DataFrame) -> DataFrame:
        self.paths.append(fresh(self.spark, self.name))
        out = self.write(self.spark, df, self.paths[-1])
        if len(self.paths) > 2:
            discard(self.spark, self.paths.pop(0))
        return out
