"""Live progress of an import: a row a batch, stored and handed to a listener."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from skein.functions.storage import discard, fresh, snapshot
from skein.operators.ingest import new_meetings

PROGRESS = "batch long, found long, imported long, skipped long, failed long"


class ImportListener(StreamingQueryListener):
    """Calls ``each`` with a dict a batch: batch, found, imported, skipped, failed, and rows_per_second of the stream.

    Register it with spark.streams.addListener() and give it to sync_with_progress(). Calls
    come from a thread of Spark's after a batch was committed, in the order of the batches.
    Batches of other queries are passed over; what fails in ``each`` doesn't stop the import.
    """

    def __init__(self, each: Callable[[dict], None]):
        self.each, self.name, self._counts, self._lock = each, None, {}, threading.Lock()

    def counted(self, row: dict) -> None:
        """A batch's counts, kept until Spark reports the batch as committed."""
        with self._lock:
            self._counts[row["batch"]] = row

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name != self.name:
            return
        with self._lock:
            row = self._counts.pop(event.progress.batchId, None)
        if row:
            self.each({**row, "rows_per_second": event.progress.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def seed(meetings: DataFrame, target: str) -> None:
    """Puts meetings that are there before any batch into ``target``."""
    meetings.write.mode("append").parquet(f"{target}/batch=-1")


def sync_with_progress(
    spark: SparkSession, meetings: DataFrame, target: str, quarantine: str, progress: str, checkpoint: str,
    readable: Column | None = None, listener: ImportListener | None = None, name: str = "import",
) -> StreamingQuery:
    """sync_stream() that keeps unreadable meetings apart and counts each batch.

    New meetings for which ``readable`` holds are appended to ``target``, the others (null
    counts as unreadable) to ``quarantine``; both are partitioned by batch, and seed() adds what was stored before.
    The quarantine is a table that the import never reads: a meeting that
    arrives again is tried again. ``progress`` gets a row a batch (see PROGRESS): found, rows of the
    batch; imported; failed; skipped, the rest: stored before or repeated. Counts are observed while the
    rows are written, so nothing is read twice for them. A batch that is run again after a
    failure replaces its files in all three tables, so nothing is stored or counted twice.
    """
    good = F.coalesce(readable, F.lit(False)) if readable is not None else F.lit(True)
    if listener:
        listener.name = name

    def store(df: DataFrame, path: str, batch: int) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        return seen.get.get("n", 0)

    def append(rows: DataFrame, batch: int) -> None:
        have = spark.read.schema(f"{keys}, batch long").parquet(target).where(F.col("batch") != batch)
        found, kept = Observation(), fresh(spark, "import")
        counted = rows.observe(found, F.count(F.lit(1)).alias("n"))
        new = snapshot(spark, new_meetings(counted, have).withColumn("_good", good), kept)
        done = store(new.where("_good").drop("_good"), target, batch)
        failed = store(new.where("not _good").drop("_good"), quarantine, batch)
        discard(spark, kept)
        n = found.get.get("n", 0)
        row = {"batch": batch, "found": n, "imported": done, "skipped": n - done - failed, "failed": failed}
        spark.createDataFrame([row], PROGRESS).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{progress}/batch={batch}")
        if listener:
            listener.counted(row)

    keys = ", ".join(f"{c} {meetings.schema[c].dataType.simpleString()}" for c in ("source_id", "source_adapter"))
    seed(spark.createDataFrame([], meetings.schema), target)
    return meetings.writeStream.queryName(name).foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
