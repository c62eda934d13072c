"""The jobs as queries: each runs twice on the whole tables into a folder of its own, and gives the output as it is then."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from echoloom.functions.normalize import BLANKS
from echoloom.plans.bindings import PAGE_RECORDS
from echoloom.plans.catalog import FUNCTIONS, INTENT, groups_sql
from echoloom.scratch import scratch_path
from jobs import duplicate_report, duplicate_watch
from jobs.common import settings

HERE = Path(__file__).resolve().parent


def job1_duplicate_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = settings(HERE / "duplicate_watch.json", duplicate_watch.USUAL)
    folder = scratch_path(spark, "job1")
    for _ in range(2):
        duplicate_watch.watch(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/mark", config)
    return duplicate_watch.outcome(spark, f"{folder}/out")


JOB1_SQL = f"""
WITH n AS (SELECT doc_id AS record_id, coalesce(nullif(source, ''), '(none)') AS run,
    list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^{BLANKS}*(#|$)')) AS kept FROM documents),
f AS (SELECT record_id, run, md5(array_to_string(kept, chr(10))) AS md5sum, CASE WHEN array_to_string(kept, '') = '' THEN 0 ELSE len(kept) END::INTEGER AS lines FROM n)
SELECT run, record_id, md5sum, lines, count(*) OVER g AS member_count,
  CASE WHEN count(*) OVER g > 1 THEN count(*) OVER g * (count(*) OVER g - 1) // 2 END AS pair_count, min(record_id) OVER g AS first_record
FROM f WINDOW g AS (PARTITION BY run, md5sum)"""


def job2_duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = settings(HERE / "duplicate_report.json", duplicate_report.USUAL)
    folder = scratch_path(spark, "job2")
    for _ in range(2):
        duplicate_report.report(spark, f"{sf_dir}/pages.parquet", folder, config)
    return duplicate_report.outcome(spark, folder)


JOB2_SQL = (
    groups_sql(PAGE_RECORDS, INTENT, 0.85, FUNCTIONS)
    + f""",
x AS (SELECT * FROM ({PAGE_RECORDS}) WHERE {FUNCTIONS}),
e AS (SELECT run_id, md5sum, count(*) AS n, row_number() OVER (PARTITION BY run_id ORDER BY md5sum) AS group_id FROM x GROUP BY run_id, md5sum HAVING count(*) >= 2),
found AS (
  SELECT run_id, 'exact' AS match_type, group_id, record_id, n AS member_count, n * (n - 1) // 2 AS pair_count, n * (n - 1) // 2 AS md5_overlap_pairs, 1.0::DOUBLE AS best, 1.0::DOUBLE AS mean, true AS same FROM x JOIN e USING (run_id, md5sum)
  UNION ALL
  SELECT l.run_id, 'fuzzy', l.group_id, l.record_id, member_count, pair_count, md5_overlap_pairs, best_ratio, avg_ratio, md5_overlap
  FROM labelled l JOIN incident USING (record_id) JOIN sized s ON s.component = l.component JOIN paired p ON p.component = l.component)
SELECT f.run_id, match_type, group_id, f.record_id, member_count, pair_count, md5_overlap_pairs, kind, file_path, coalesce(signature, 'None') AS signature, coalesce(intent, 'None') AS said, '' AS lines,
  printf('%.4f', best) AS best_ratio, printf('%.4f', mean) AS avg_ratio, CASE WHEN same THEN 'yes' ELSE 'no' END AS md5_overlap
FROM found f JOIN x USING (record_id)"""
)

QUERIES = {f.__name__: f for f in (job1_duplicate_watch, job2_duplicate_report)}
SQL = {"job1_duplicate_watch": JOB1_SQL, "job2_duplicate_report": JOB2_SQL}
