"""Where intermediate tables go.

Intermediates that are read more than once, or whose lineage must be cut, are
written as Parquet below the folder named by ``spark.checkpoint.dir``.  That
folder is shared by the driver and all executors, so the tables outlive any lost
executor.  Only where the setting is absent (tests, a laptop) is a local
folder made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; if unset, a fresh local one where driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='echoloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/echoloom/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no frame reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stored`."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/echoloom/" in f}:
        remove(df.sparkSession, name)


def purge(spark: SparkSession) -> None:
    """Delete every intermediate of this shared folder; frames that read them are dead then."""
    remove(spark, f"{shared_dir(spark)}/echoloom")
