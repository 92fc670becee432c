"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "salesmart", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode, adaptive execution and dynamic partition overwrite."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    return SparkSession.builder.appName(app).config(map=base).getOrCreate()
