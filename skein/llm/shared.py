"""Shared storage, checked broadcasts and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.storage import CLEANUP, Rounds, fresh

#: Rows of a narrow table (a few numbers a row) that are broadcast at most.
BROADCAST_ROWS = 100_000


#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from here on: what a Python worker holds at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, min(BATCH_BYTES, int(spark.conf.get(key, "67108864").rstrip("b"))))


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    What was shuffled for it isn't needed any more and goes at once, so that a job of many
    steps holds the shuffle files of one step.
    """
    return written(spark, df, fresh(spark, name))


def written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """stored() at a path of the caller's."""
    bounded(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in order of ``keys``, dealt to tasks by range; even rows of equal keys can lie in several."""
    tagged = rows.withColumn("_tie", F.monotonically_increasing_id())
    return tagged.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, and all columns but the text in a struct ``row``: names in it can't clash with added ones."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), *keep)


def unpacked(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The ``columns`` that packed() had, with ``changed`` expressions in the place of some."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is (a shuffle join).

    For rows of a few numbers; rows with arrays are left to Spark, which knows their bytes.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def settled(pairs: DataFrame) -> bool:
    """Whether every node of ``pairs`` (hi, lo) is a root or has one edge, to a root."""
    ends = pairs.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(pairs.select("lo", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").limit(1).count()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as rows (node, component), component the smallest node.

    Alternating large-star and small-star rounds until each node hangs on its root; each
    round is written to shared storage and the one before the last deleted. The rounds grow with
    the logarithm of the longest path, and edges that are stars already need none. Nodes
    without an edge don't occur in the result; an edge with a null end or equal ends is ignored.
    """
    rounds = Rounds(spark, "cc", written)
    pairs = rounds.put(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while not settled(pairs):
        # large star: every larger neighbour of a node goes to the node's least neighbour
        both = pairs.union(pairs.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small star: every smaller neighbour, and the node, go to the least neighbour
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = rounds.put(moved.union(low.select("hi", F.col("m").alias("lo"))).distinct())
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
