"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "millrace", **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew splitting, field ids; anything else comes from the caller or the cluster."""
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.fieldId.write.enabled": "true",
        "spark.sql.parquet.fieldId.read.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k: str(v) for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=wanted).getOrCreate()
