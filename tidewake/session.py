"""The session that jobs and tests use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewake", **conf: str) -> SparkSession:
    """A session in UTC with ANSI checks and adaptive execution; ``conf`` adds or overrides settings (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
