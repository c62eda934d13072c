"""Job 2: the report of likely duplicated code for runs of a table of records.

    python -m jobs.duplicate_report --config jobs/duplicate_report.json --input records.parquet --output report/

Reads a Parquet table, makes records of it by the expressions of the config file, leaves out files that the ignore
rules name, and compares the functions and methods of each run: by fingerprint, by similar intents, and by similar code.  Writes

* ``members/``: a row for each member of each group, as the report shows it, partitioned by run and kind of match;
* ``groups/``: a row for each group, partitioned the same way;
* ``runs/``: a row for each run: its records, compared records, ignored records, groups and pairs, partitioned by run.

The output of all runs, or with ``runs`` of those alone, is replaced whole, so the job may be repeated after a failure and gives
the same output for the same input.

Settings: SQL expressions ``record_id`` (unique), ``run_id``, ``kind``, ``file_path``, ``signature``, ``code`` and ``intent``;
``start_line`` and ``end_line`` if there are any; ``threshold``; ``compare``, some of ``exact``, ``fuzzy`` (intents) and
``normalized_code_fuzzy`` (code); ``normalise``, whether code has yet to be normalised; ``ignore``, rules as in ignore files;
``runs``, empty for all.  Records without an id are in no group; a null intent compares as the empty text.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoloom.functions.normalize import fingerprint, normalize_code
from echoloom.operators.duplicates import CODE, EXACT, FUZZY, comparable_intent, eligible, exact_groups, fuzzy_groups
from echoloom.operators.similar_pairs import checked_threshold
from echoloom.plans.report import report_rows
from echoloom.scratch import stored
from echoloom.session import session
from echoloom.sources.tree import IgnoreRules
from jobs.common import log_to_stderr, parser, settings

LOG = logging.getLogger("duplicate_report")
FIELDS = ("record_id", "run_id", "kind", "file_path", "signature", "code", "intent", "start_line", "end_line")
USUAL = {
    **{f: f for f in FIELDS[:-2]},
    "start_line": "CAST(NULL AS INT)",
    "end_line": "CAST(NULL AS INT)",
    "normalise": False,
    "threshold": 0.85,
    "compare": [EXACT, FUZZY, CODE],
    "ignore": [],
    "runs": [],
}
KINDS = {"record_id": "long", "run_id": "long", "start_line": "int", "end_line": "int"}
PARTITIONS = ("run_id", "match_type")


def records_of(table: DataFrame, config: dict) -> DataFrame:
    """Records by the expressions of the config, with their fingerprint and whether the ignore rules name their file."""
    rows = table.select(*[F.expr(config[f]).cast(KINDS.get(f, "string")).alias(f) for f in FIELDS])
    if config["runs"]:
        rows = rows.where(F.col("run_id").isin(config["runs"]))
    code = normalize_code(F.col("code")) if config["normalise"] else F.col("code")
    ignored = F.coalesce(IgnoreRules(config["ignore"]).column(F.col("file_path")), F.lit(False)) if config["ignore"] else F.lit(False)
    coded = rows.withColumn("normalized_code", code).withColumn("ignored", ignored).drop("code")
    return coded.withColumn("md5sum", fingerprint(F.col("normalized_code")))


def compared(records: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """Groups and members of every kind of match that the config asks for."""
    ways = {
        EXACT: lambda: exact_groups(records),
        FUZZY: lambda: fuzzy_groups(records, comparable_intent(F.col("intent")), FUZZY, config["threshold"]),
        CODE: lambda: fuzzy_groups(records, F.col("normalized_code"), CODE, config["threshold"]),
    }
    if not config["compare"] or set(config["compare"]) - set(ways):
        raise ValueError(f"compare must name some of {', '.join(ways)}")
    groups, members = zip(*[ways[x]() for x in dict.fromkeys(config["compare"])], strict=True)
    return reduce(DataFrame.unionByName, groups), reduce(DataFrame.unionByName, members)


def report(spark: SparkSession, source: str, output: str, config: dict | None = None) -> dict[str, int]:
    """Compare the runs of a table and write the report; returns what was read and written, in rows."""
    config = USUAL | (config or {})
    checked_threshold(config["threshold"])
    output = output.rstrip("/")
    LOG.info("reading %s, writing %s", source, output)
    records = stored(records_of(spark.read.parquet(source), config), "report-records")
    some = eligible(records.where("NOT ignored"))
    groups, members = compared(some, config)

    def put(rows: DataFrame, name: str, *by: str) -> int:
        """Replace the whole table, or the folders of the runs asked for, also where nothing is left for them."""
        path, schema = f"{output}/{name}", rows.schema
        if config["runs"]:
            rows = stored(rows, f"report-{name}")
        for run in config["runs"] or [None]:
            own, rest = (rows, by) if run is None else (rows.where(F.col("run_id") == run).drop("run_id"), by[1:])
            own = own.hint("rebalance", *rest) if rest else own
            own.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*rest).parquet(path if run is None else f"{path}/run_id={run}")
        return spark.read.schema(schema).parquet(path).count()

    held = {"groups": put(groups, "groups", *PARTITIONS), "members": put(report_rows(members), "members", *PARTITIONS)}
    by_run = records.groupBy("run_id").agg(F.count("*").alias("records"), F.count_if(F.col("kind").isin("function", "method") & ~F.col("ignored")).alias("compared"), F.count_if("ignored").alias("ignored"))
    found = groups_of(spark, output).groupBy("run_id").agg(F.count("*").alias("groups"), F.sum("pair_count").alias("pairs"))
    zero = F.lit(0).cast("long")
    runs = by_run.join(found, "run_id", "left").select("run_id", "records", "compared", "ignored", F.coalesce("groups", zero).alias("groups"), F.coalesce("pairs", zero).alias("pairs"))
    counts = {"records": records.count(), **held, "runs": put(runs, "runs", "run_id")}
    LOG.info("read %(records)d records, wrote %(groups)d groups, %(members)d members, %(runs)d runs", counts)
    return counts


MEMBER_ROWS = "group_id long, record_id long, kind string, file_path string, signature string, said string, lines string, best_ratio string, avg_ratio string, md5_overlap string, run_id long, match_type string"
GROUP_ROWS = "group_id long, member_count long, pair_count long, md5_overlap_pairs long, run_id long, match_type string"


def groups_of(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(GROUP_ROWS).parquet(f"{output.rstrip('/')}/groups")


def outcome(spark: SparkSession, output: str) -> DataFrame:
    """The output as one frame: members with the counts of their group."""
    members = spark.read.schema(MEMBER_ROWS).parquet(f"{output.rstrip('/')}/members")
    return members.join(groups_of(spark, output), [*PARTITIONS, "group_id"])


def main(arguments: list[str] | None = None) -> None:
    given = parser("Report likely duplicated code in a table of records.", "input", "output").parse_args(arguments)
    log_to_stderr()
    spark = session("duplicate_report", given.master)
    try:
        report(spark, given.input, given.output, settings(given.config, USUAL))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
