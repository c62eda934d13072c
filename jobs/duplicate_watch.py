"""Job 1: keep the exact duplicates of a growing collection of code up to date.

    python -m jobs.duplicate_watch --config jobs/duplicate_watch.json --input records/ --output out/ --checkpoint mark/

A file stream takes the Parquet files that came to ``--input`` since the last run (its checkpoint is the mark), and
ends when there are no more.  Each batch of files

1. normalises and fingerprints its records, the costly part, once for each record ever, and writes them to
   ``fingerprints/`` (record_id, md5sum, lines), partitioned by batch and run;
2. groups again those runs that the batch touched, from the stored fingerprints of those runs alone, and replaces
   their partitions of ``groups/`` (md5sum, member_count, pair_count, first_record, last_batch; a row without md5sum
   is the run's total).

Both writes replace whole partitions that the batch determines, so a batch that failed half-way and is repeated, or a job
that is run again without new files, leaves the same output.  A record is (run, id): if it comes again, the text of the
latest batch counts (of the same batch, the greatest fingerprint).  Records without an id are told apart by their
fingerprint; a null or empty run is ``(none)``; a null text is fingerprinted as null and is in no group.

Settings: ``schema`` of the input (only these columns are read), the columns ``id``, ``code`` and ``run``,
``normalise`` (``lines``: comment-only and blank lines go, natively; ``code``: standalone strings too, by the tokenizer),
and ``files_per_batch``, which bounds a batch.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoloom.functions.normalize import fingerprint, normalize_code, without_blank_lines, without_comment_lines
from echoloom.session import session
from jobs.common import log_to_stderr, parser, read_or_empty, settings

LOG = logging.getLogger("duplicate_watch")
USUAL = {"schema": "doc_id long, text string, source string", "id": "doc_id", "code": "text", "run": "source", "normalise": "lines", "files_per_batch": 200}
PRINTS = "record_id long, md5sum string, lines int, batch long, run string"
GROUPS = "md5sum string, member_count long, pair_count long, first_record long, last_batch long, run string"
NO_RUN = "(none)"


def normalised(code: Column, how: str) -> Column:
    if how == "code":
        return normalize_code(code)
    if how == "lines":
        return without_blank_lines(without_comment_lines(code))
    raise ValueError(f"no such normalisation: {how}")


def fingerprints(records: DataFrame, config: dict) -> DataFrame:
    """(record_id, run, md5sum, lines) of records."""
    run = F.col(config["run"]).cast("string")
    coded = records.select(F.col(config["id"]).cast("long").alias("record_id"), F.when(run != "", run).otherwise(NO_RUN).alias("run"), normalised(F.col(config["code"]).cast("string"), config["normalise"]).alias("code"))
    lines = F.when(F.length("code") > 0, F.size(F.split("code", "\n"))).otherwise(0)
    return coded.select("record_id", "run", fingerprint(F.col("code")).alias("md5sum"), F.when(F.col("code").isNotNull(), lines).cast("int").alias("lines"))


def current(prints: DataFrame) -> DataFrame:
    """The latest fingerprint of each record."""
    apart = F.when(F.col("record_id").isNull(), F.col("md5sum")).alias("_apart")
    latest = prints.groupBy("run", "record_id", apart).agg(F.max(F.struct("batch", "md5sum", "lines")).alias("last"))
    return latest.select("run", "record_id", "last.batch", "last.md5sum", "last.lines")


def grouped(prints: DataFrame) -> DataFrame:
    """Groups of at least two current records of a run with one fingerprint, and the total of each run.

    The total has no md5sum: it counts the records of the run and the pairs of its groups.  It also
    makes sure that a run that has no group any more gets a new partition.
    """
    by = current(prints).groupBy("run", "md5sum").agg(F.count("*").alias("n"), F.min("record_id").alias("first"), F.max("batch").alias("last"))
    pairs = F.when(F.col("md5sum").isNotNull(), F.col("n") * (F.col("n") - 1) / 2).otherwise(0).cast("long")
    sizes = by.select("run", "md5sum", F.col("n").alias("member_count"), pairs.alias("pair_count"), F.col("first").alias("first_record"), F.col("last").alias("last_batch"))
    total = sizes.groupBy("run").agg(F.lit(None).cast("string").alias("md5sum"), F.sum("member_count").alias("member_count"), F.sum("pair_count").alias("pair_count"), F.min("first_record").alias("first_record"), F.max("last_batch").alias("last_batch"))
    return sizes.where("md5sum IS NOT NULL AND member_count >= 2").unionByName(total).select("md5sum", "member_count", "pair_count", "first_record", "last_batch", "run")


def _absorb(output: str, config: dict, log: list[dict]):  # noqa: ANN202
    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = fingerprints(batch, config).withColumn("batch", F.lit(batch_id).cast("long"))
        # Rebalanced by run: few files a run, and a run with much of the batch still has many writers.
        new.hint("rebalance", "run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "run").parquet(f"{output}/fingerprints")
        prints = spark.read.schema(PRINTS).parquet(f"{output}/fingerprints")
        own = prints.where(F.col("batch") == batch_id)
        read = own.count()
        touched = own.select("run").distinct()
        made = grouped(prints.join(touched, "run", "left_semi"))
        made.hint("rebalance", "run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{output}/groups")
        row = {"batch": batch_id, "records": read, "runs": touched.count()}
        LOG.info("batch %(batch)d: read %(records)d records of %(runs)d runs, wrote their fingerprints and groups", row)
        log.append(row)

    return absorb


def watch(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> list[dict]:
    """Absorb what is new below ``source``; returns batch, records and runs of each batch, none if nothing is new."""
    config = USUAL | (config or {})
    output, log = output.rstrip("/"), []
    # A pattern of one match: the stream then also takes a single file, which as a plain path it refuses.
    path = source.rstrip("/")
    path = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    LOG.info("reading %s, mark %s, writing %s", source, checkpoint, output)
    stream = spark.readStream.schema(config["schema"]).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(path)
    writer = stream.writeStream.foreachBatch(_absorb(output, config, log)).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("%d batches, %d new records", len(log), sum(x["records"] for x in log))
    return log


def outcome(spark: SparkSession, output: str) -> DataFrame:
    """The output as one frame: every current record with its group, if it has one."""
    prints = current(read_or_empty(spark, f"{output}/fingerprints", PRINTS))
    groups = read_or_empty(spark, f"{output}/groups", GROUPS).select("run", "md5sum", "member_count", "pair_count", "first_record")
    joined = prints.select("run", "record_id", "md5sum", "lines").join(groups, ["run", "md5sum"], "left")
    return joined.select("run", "record_id", "md5sum", "lines", F.coalesce("member_count", F.lit(1)).cast("long").alias("member_count"), "pair_count", F.coalesce("first_record", "record_id").alias("first_record"))


def main(arguments: list[str] | None = None) -> None:
    given = parser("Keep the exact duplicates of a growing collection of code up to date.", "input", "output", "checkpoint").parse_args(arguments)
    log_to_stderr()
    spark = session("duplicate_watch", given.master)
    try:
        watch(spark, given.input, given.output, given.checkpoint, settings(given.config, USUAL))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
