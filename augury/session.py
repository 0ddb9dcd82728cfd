"""A session with the settings that the engine's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "augury", **conf: str) -> SparkSession:
    """UTC, ANSI mode, adaptive execution; the caller's settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
