"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "echoloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``settings`` win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    usual = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=usual | settings).getOrCreate()
