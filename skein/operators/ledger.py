"""Reports and bulk changes on the job ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def summary(jobs: DataFrame) -> DataFrame:
    """One row: active (pending or running), completed, failed and their total; cancelled jobs don't count."""
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0))
    return jobs.agg(n("pending", "running").alias("active"), n("completed").alias("completed"), n("failed").alias("failed"), n("pending", "running", "completed", "failed").alias("total"))


def retryable(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'failed' and attempts < max_attempts").orderBy("created_at", "id")


def claimable(jobs: DataFrame, now: str) -> DataFrame:
    """The next job of each kind: pending and due, highest priority, then oldest."""
    due = jobs.where((F.col("status") == "pending") & (F.col("scheduled_at") <= F.lit(now).cast("timestamp")))
    rank = F.struct(-F.col("priority"), F.col("created_at"), F.col("id"))
    return due.groupBy("kind").agg(F.min_by(F.struct("id", "priority", "created_at"), rank).alias("j")).select("kind", "j.*")


def cleanup(jobs: DataFrame, cutoff: str) -> DataFrame:
    """Without completed jobs that ended before the cutoff."""
    old = (F.col("status") == "completed") & (F.col("completed_at") < F.lit(cutoff).cast("timestamp"))
    return jobs.where(~F.coalesce(old, F.lit(False)))


def reset_failed(jobs: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return jobs.withColumns({"attempts": F.when(failed, 0).otherwise(F.col("attempts")), "last_error": F.when(~failed, F.col("last_error")), "status": F.when(failed, "pending").otherwise(F.col("status"))})


def backoff(jobs: DataFrame, base: float = 1.0, cap: float = 60.0) -> DataFrame:
    """(id, attempts, delay) of jobs with attempts left: base * 2^(attempts - 1) seconds, ``cap`` at most."""
    return jobs.where("attempts < max_attempts").select("id", "attempts", F.least(base * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(cap)).alias("delay"))


def tail(rows: DataFrame, n: int = 500) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
