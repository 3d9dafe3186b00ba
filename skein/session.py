"""A session with the settings that the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC and Arrow; more settings as keyword arguments with __ for dots."""
    b = SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    b = b.master(master) if master else b
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
