"""Bounds on what Spark sends to a Python worker at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

MOST = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to MOST where they are higher (or 0, for none).

    Whole texts travel to the workers; the usual batches of 10,000 rows and 64 MB, held
    twice in each of several workers, crowd out the executor's own memory.
    """
    for key, most in MOST.items():
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
