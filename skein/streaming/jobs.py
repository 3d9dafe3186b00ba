"""Structured Streaming: incremental import and live job counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skein.operators.ingest import new_meetings
from skein.operators.ledger import counts


def sync_stream(spark: SparkSession, meetings: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends meetings of the stream that ``target`` (Parquet) doesn't hold, each batch's once.

    The stored table is the state: nothing grows in the query itself. Runs on what is
    there and ends.
    """

    def append(batch: DataFrame, _: int) -> None:
        have = spark.read.schema(batch.schema).parquet(target)
        new_meetings(batch, have).select(*batch.columns).write.mode("append").parquet(target)

    spark.createDataFrame([], meetings.schema).write.mode("append").parquet(target)
    return meetings.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counter_stream(jobs: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Job counts by status, handed to ``each`` whole after every batch; state is a row a status."""
    return counts(jobs).writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
