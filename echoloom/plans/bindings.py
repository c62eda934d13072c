"""The driver's tables as inputs of the engine, in expressions that Spark and DuckDB share.

Three tables stand for records, each with whole fields; the id decides the kind, and every seventh
record lacks an intent:

* ``documents``: each source is a run, the text is the code, its first line the intent;
* ``pages``: each fifth page is of one run, the html is the code, the URL the intent;
* ``part``: each brand is a run, the code is a short statement of all that the row tells.

Intents of pages and code of parts are short enough for SQL that compares them letter by
letter.  Python sources are generated from ``part``, a file for each row, so that what they hold can be told in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORDS = """
SELECT doc_id AS record_id, CAST(substr(source, 4) AS BIGINT) AS run_id,
  CASE doc_id % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'class' WHEN 2 THEN 'function' ELSE 'method' END AS kind,
  source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.py' AS file_path,
  CASE WHEN doc_id % 4 <> 0 THEN split_part(text, chr(10), 1) END AS signature,
  1 AS start_line, 2 AS end_line, text AS raw_code, text AS normalized_code, md5(text) AS md5sum,
  CASE WHEN doc_id % 7 <> 0 THEN split_part(text, chr(10), 1) END AS intent,
  CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failed' ELSE 'skipped' END AS intent_status,
  CASE WHEN quality = 0 THEN 'refused' END AS intent_error
FROM documents LEFT JOIN (SELECT doc_id AS labelled, quality FROM labels) AS l ON doc_id = labelled"""

PAGE_RECORDS = """
SELECT page_id AS record_id, page_id % 5 AS run_id,
  CASE page_id % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'class' WHEN 2 THEN 'function' ELSE 'method' END AS kind,
  'pages/' || CAST(page_id AS STRING) || '.py' AS file_path, CASE WHEN page_id % 4 <> 0 THEN url END AS signature,
  1 AS start_line, 2 AS end_line, html AS raw_code, html AS normalized_code, md5(html) AS md5sum,
  CASE WHEN page_id % 7 <> 0 THEN url END AS intent
FROM pages"""

PART_RECORDS = """
SELECT p_partkey AS record_id, CAST(substr(p_brand, 7) AS BIGINT) AS run_id,
  CASE p_partkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'class' WHEN 2 THEN 'function' ELSE 'method' END AS kind,
  'parts/' || CAST(p_partkey AS STRING) || '.py' AS file_path, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS signature,
  1 AS start_line, 2 AS end_line, code AS raw_code, code AS normalized_code, md5(code) AS md5sum, p_name AS intent
FROM (SELECT *, replace(p_name, ' ', '_') || '(' || p_type || ', ' || CAST(p_size AS STRING) || ') = ' || CAST(CAST(floor(p_retailprice) AS INT) AS STRING) AS code FROM part)"""

KEY = "CAST(p_partkey AS STRING)"
#: The lines of a generated file; part 50, 100, ... have a last line that does not parse.
LINES = [
    f"'\"\"\"Part ' || {KEY} || '.\"\"\"'",
    "'import os'",
    "'from parts.base import Root'",
    "'# brand: ' || p_brand",
    "''",
    f"'class Part' || {KEY} || '(Root):'",
    "'    \"\"\"Holds ' || p_name || '.\"\"\"'",
    "'    size = ' || CAST(p_size AS STRING)",
    "''",
    f"'    def price_' || {KEY} || '(self, factor):'",
    "'        # by size'",
    "'        return self.size * factor'",
    "''",
    "'@os.fspath'",
    f"'def make_' || {KEY} || '(first,'",
    "'          second=None):'",
    "'    \"\"\"Builds.\"\"\"'",
    "'    def inner():'",
    f"'        return getattr(first, ' || chr(39) || 'price_' || {KEY} || chr(39) || ')'",
    "'    return inner'",
    "'if True:'",
    "'    def unseen(): pass'",
]
BROKEN = "p_partkey % 50 = 0"


def joined(first: int, last: int) -> str:
    """SQL for lines first..last (from 1) of a generated file."""
    return f"concat_ws(chr(10), {', '.join(LINES[first - 1 : last])})"


PATH = f"'src/parts/p' || {KEY} || '.py'"
SOURCES = f"""
SELECT p_partkey, {PATH} AS file_path,
  {joined(1, len(LINES))} || CASE WHEN {BROKEN} THEN chr(10) || 'def broken(:' ELSE '' END || chr(10) AS content
FROM part"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "documents", "labels")
    return spark.sql(RECORDS.replace("split_part(text, chr(10), 1)", "substring_index(text, chr(10), 1)"))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "pages")
    return spark.sql(PAGE_RECORDS)


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part")
    return spark.sql(PART_RECORDS)


#: Generated files that one task makes and parses.
FILES_A_TASK = 2000


def spread_parts(spark: SparkSession, sf_dir: str) -> None:
    """The view ``part``, dealt to tasks by rows: its few bytes would all go to one task, with the parsing of every file made of them."""
    views(spark, sf_dir, "part")
    rows = spark.table("part")
    rows.repartition(max(1, -(-rows.count() // FILES_A_TASK)), "p_partkey").createOrReplaceTempView("part")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread_parts(spark, sf_dir)
    return spark.sql(SOURCES).select("file_path", "content")
