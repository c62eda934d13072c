"""Stored runs.

Two Parquet tables: ``records``, partitioned by run_id, and ``runs``.  A run's records are
written first and its ``runs`` row last; readers only see runs that have that row, so
a writer that fails half-way leaves nothing visible.  There is one writer at a time.
"""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoloom.operators.ranking import numbered
from echoloom.schema import RUN, STORED_RECORD
from echoloom.scratch import remove

LOADED = ("record_id", "kind", "file_path", "signature", "normalized_code", "md5sum", "intent", "start_line", "end_line")

#: A10: selective reads by these columns skip row groups, by their filters and, of md5sum, by the bounds of sorted row groups.
BLOOM = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("md5sum", "file_path", "intent_status")}
ROW_GROUP = 16 << 20  #: bytes of a row group: many a file, so that a lookup leaves most unread


def run_status(analyzer_errors: Column, failed: Column) -> Column:
    """S7."""
    return F.when((analyzer_errors > 0) | (failed > 0), "completed_with_errors").otherwise("completed")


def record_counts(records: DataFrame) -> DataFrame:
    """record_count and intent_failed_count of each run."""
    return records.groupBy("run_id").agg(F.count("*").alias("record_count"), F.count_if(F.col("intent_status") == "failed").alias("intent_failed_count"))


def eligible_of_run(records: DataFrame, run_id: int) -> DataFrame:
    """Nine columns of a run's functions and methods, by record_id."""
    return records.where((F.col("run_id") == run_id) & F.col("kind").isin("function", "method")).select(*LOADED).orderBy("record_id")


class Persistence(Protocol):
    """Where runs go to."""

    def persist(self, records: DataFrame, analyzer_errors: int, root_path: str, provider_url: str, model: str, scope: str, progress_batch_size: int) -> dict: ...

    def load(self, run_id: int) -> DataFrame: ...


class RunStore:
    """The two tables below one folder; either is empty until the first run (A10)."""

    def __init__(self, spark: SparkSession, folder: str, row_group: int = ROW_GROUP) -> None:
        self.spark, self.folder, self.row_group = spark, folder.rstrip("/"), row_group

    def _there(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def runs(self) -> DataFrame:
        path = f"{self.folder}/runs"
        return self.spark.read.schema(RUN).parquet(path) if self._there(path) else self.spark.createDataFrame([], RUN)

    def records(self) -> DataFrame:
        """Records of finished runs."""
        path = f"{self.folder}/records"
        if not self._there(path):
            return self.spark.createDataFrame([], STORED_RECORD)
        return self.spark.read.schema(STORED_RECORD).parquet(path).join(self.runs().select("run_id"), "run_id", "left_semi")

    def find(self, run_id: int, **wanted: str) -> DataFrame:
        """A10: records of a finished run by ``md5sum``, ``file_path`` or ``intent_status``; the scan skips row groups that cannot hold them."""
        rows = self.records().where(F.col("run_id") == run_id)
        for name, value in wanted.items():
            if name not in ("md5sum", "file_path", "intent_status"):
                raise ValueError(f"no index on {name}")
            rows = rows.where(F.col(name) == value)
        return rows

    def load(self, run_id: int) -> DataFrame:
        """An unknown run has no records; partition and kind are pruned in the scan."""
        if self.runs().where(F.col("run_id") == run_id).isEmpty():
            return self.spark.createDataFrame([], STORED_RECORD).select("run_id", *LOADED)
        rows = self.spark.read.schema(STORED_RECORD).parquet(f"{self.folder}/records")
        return rows.where((F.col("run_id") == run_id) & F.col("kind").isin("function", "method")).select("run_id", *LOADED).orderBy("record_id")

    def persist(self, records: DataFrame, analyzer_errors: int, root_path: str, provider_url: str, model: str, scope: str, progress_batch_size: int) -> dict:
        """Append a run; returns its row.  ``records`` has ``seq``, its order inside a file, and is read once."""
        started = datetime.now(timezone.utc).isoformat()
        last_run = self.runs().agg(F.max("run_id")).first()[0] or 0
        run_id, path = last_run + 1, f"{self.folder}/records/run_id={last_run + 1}"
        taken = (self.records().agg(F.max("record_id")).first()[0] or 0) if last_run else 0
        if self._there(path):  # left by a writer that failed
            remove(self.spark, path)
        columns = [c.split()[0] for c in STORED_RECORD.split(", ") if c.split()[0] != "run_id"]
        placed = numbered(records, "file_path", "seq", name="record_id", start=taken + 1).select(*columns)
        # Sorted by fingerprint: records of one are neighbours, and each row group has its own range of them.
        sorted_ = placed.repartitionByRange("md5sum", "record_id").sortWithinPartitions("md5sum", "record_id")
        sorted_.write.options(**BLOOM, **{"parquet.block.size": str(self.row_group)}).parquet(path)
        counts = self.spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if(F.col("intent_status") == "failed").alias("failed")).first()
        status = "completed_with_errors" if analyzer_errors or counts["failed"] else "completed"
        finished = datetime.now(timezone.utc).isoformat()
        row = (run_id, started, finished, root_path, provider_url, model, scope, progress_batch_size, status, analyzer_errors, counts["failed"], counts["n"])
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        return dict(zip((c.split()[0] for c in RUN.split(", ")), row, strict=True))
