"""What the jobs share: command lines, config files, and reading a folder that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def parser(about: str, *paths: str) -> argparse.ArgumentParser:
    """Options: the config file, a Spark master for trials, and a required path for each name."""
    out = argparse.ArgumentParser(description=about)
    out.add_argument("--config", required=True, help="JSON file of settings")
    out.add_argument("--master", help="Spark master, unless spark-submit sets it")
    for name in paths:
        out.add_argument(f"--{name}", required=True)
    return out


def settings(path: str | Path, usual: dict) -> dict:
    """The settings of a JSON file over the usual ones; an unknown name is a mistake."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    if unknown := set(given) - set(usual):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return usual | given


def log_to_stderr() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")


def there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder with a stated schema, partition columns included; no rows if it is not there."""
    return spark.read.schema(schema).parquet(path) if there(spark, path) else spark.createDataFrame([], schema)
