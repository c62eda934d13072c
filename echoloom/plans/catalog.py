"""The engine's queries on the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoloom.functions.normalize import fingerprint, normalize_code, without_blank_lines, without_comment_lines
from echoloom.operators.components import connected_components
from echoloom.operators.duplicates import comparable_intent, edge_counts, eligible, exact_groups, find_duplicates, fuzzy_groups, progress_ticks, record_edges
from echoloom.operators.enrich import OfflineClient, enriched, enriched_once
from echoloom.operators.extract import split_symbols, tagged_symbols
from echoloom.operators.ranking import numbered
from echoloom.operators.rewrite import rewrite_files
from echoloom.operators.symbols import base26, module_roots, project_index, rename_map, rename_targets, reserved_names, symbol_rows
from echoloom.plans import features
from echoloom.plans.bindings import BROKEN, KEY, PAGE_RECORDS, PART_RECORDS, PATH, RECORDS, joined, page_records, part_records, records, sources, views
from echoloom.plans.report import record_json, report_rows
from echoloom.scratch import scratch_path, stored
from echoloom.sources.store import RunStore, eligible_of_run, record_counts, run_status
from echoloom.sources.tree import IgnoreRules, rebased

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
THRESHOLD = 0.85


def query(sql: str | None = None) -> Callable:
    """Register a query under the function's name, with its SQL if there is one."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Exact groups over the whole table as one run.

EXACT_SQL = f"""
WITH r AS (SELECT * FROM ({RECORDS}) WHERE kind IN ('function', 'method')),
g AS (SELECT md5sum, count(*) AS n, row_number() OVER (ORDER BY md5sum) AS group_id FROM r GROUP BY md5sum HAVING count(*) >= 2)"""


def one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(records(spark, sf_dir)).withColumn("run_id", F.lit(0).cast("long"))


@query(f"{EXACT_SQL} SELECT group_id, n AS member_count, n * (n - 1) // 2 AS pair_count, n * (n - 1) // 2 AS md5_overlap_pairs FROM g")
def exact_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(one_run(spark, sf_dir))[0].select("group_id", "member_count", "pair_count", "md5_overlap_pairs")


@query(f"{EXACT_SQL} SELECT group_id, record_id, kind, file_path, md5sum, 1.0::DOUBLE AS best_ratio, true AS md5_overlap FROM r JOIN g USING (md5sum)")
def exact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(one_run(spark, sf_dir))[1].select("group_id", "record_id", "kind", "file_path", fingerprint(F.col("normalized_code")).alias("md5sum"), "best_ratio", "md5_overlap")


# Similar pairs inside each run.  The SQL finds the subsequence bit by bit in numbers of 127 bits, which hold whole
# intents of pages and whole code of parts; whole texts of documents are beyond it.


def edges_sql(rows: str, text: str, threshold: float, where: str = "true") -> str:
    """CTEs up to ``edges`` (run_id, left_id, right_id, ratio, md5_match)."""
    return f"""
WITH RECURSIVE r AS (SELECT run_id, record_id, md5sum, {text} AS t FROM ({rows}) WHERE {where}),
p AS (SELECT a.run_id, a.record_id AS left_id, b.record_id AS right_id, a.t AS x, b.t AS y, a.md5sum = b.md5sum AS md5_match
  FROM r a JOIN r b ON a.run_id = b.run_id AND a.record_id < b.record_id),
l AS (
  SELECT *, 1 AS i, (1::HUGEINT << length(x)) - 1 AS v FROM p
  UNION ALL
  SELECT run_id, left_id, right_id, x, y, md5_match, i + 1, ((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << length(x)) - 1)
  FROM (SELECT *, coalesce(list_sum([1::HUGEINT << (k - 1)::INTEGER for k in range(1, length(x) + 1) if x[k] = y[i]]), 0)::HUGEINT AS m FROM l WHERE i <= length(y))),
q AS (SELECT *, length(x) + length(y) AS total, length(x) - bit_count(v) AS common FROM l WHERE i = length(y) + 1),
scored AS (SELECT run_id, left_id, right_id, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (total - 2 * common)::DOUBLE / total END AS ratio, md5_match FROM q),
edges AS (SELECT * FROM scored WHERE ratio >= {threshold})"""


INTENT, CODE = "coalesce(intent, '')", "normalized_code"
FUNCTIONS = "kind IN ('function', 'method')"


@query(f"{edges_sql(PAGE_RECORDS, INTENT, THRESHOLD)} SELECT * FROM edges")
def intent_ratio_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_edges(page_records(spark, sf_dir), comparable_intent(F.col("intent")), THRESHOLD)


@query(f"{edges_sql(PART_RECORDS, CODE, THRESHOLD, FUNCTIONS)} SELECT * FROM edges")
def code_ratio_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_edges(eligible(part_records(spark, sf_dir)), F.col("normalized_code"), THRESHOLD)


@query(f"{edges_sql(PAGE_RECORDS, INTENT, 1.0, 'intent IS NULL')} SELECT run_id, count(*) AS pairs, min(ratio) AS least FROM edges GROUP BY run_id")
def null_intent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = record_edges(page_records(spark, sf_dir).where("intent IS NULL"), comparable_intent(F.col("intent")), 1.0)
    return edges.groupBy("run_id").agg(F.count("*").alias("pairs"), F.min("ratio").alias("least"))


SWEEP = (0.5, 0.7, 0.85, 1.0)
SWEEP_OUT = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) AS pairs FROM edges WHERE ratio >= {t}" for t in SWEEP)


@query(f"{edges_sql(PAGE_RECORDS, INTENT, 0.5)} {SWEEP_OUT}")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_counts(page_records(spark, sf_dir), comparable_intent(F.col("intent")), SWEEP)


def groups_sql(rows: str, text: str, threshold: float, where: str) -> str:
    """CTEs up to ``labelled`` (run_id, record_id, component, group_id)."""
    return f"""{edges_sql(rows, text, threshold, where)},
incidence AS (SELECT run_id, left_id AS a, right_id AS b, ratio, md5_match FROM edges UNION ALL SELECT run_id, right_id, left_id, ratio, md5_match FROM edges),
reach AS (SELECT a AS record_id, a AS other FROM incidence UNION SELECT reach.record_id, incidence.b FROM reach JOIN incidence ON reach.other = incidence.a),
comp AS (SELECT record_id, min(other) AS component FROM reach GROUP BY record_id),
labelled AS (SELECT DISTINCT incidence.run_id, comp.record_id, comp.component, dense_rank() OVER (PARTITION BY incidence.run_id ORDER BY comp.component) AS group_id FROM incidence JOIN comp ON incidence.a = comp.record_id),
sized AS (SELECT run_id, group_id, component, count(*) AS member_count FROM labelled GROUP BY ALL),
paired AS (SELECT component, count(*) AS pair_count, count(*) FILTER (md5_match) AS md5_overlap_pairs FROM edges JOIN comp ON left_id = record_id GROUP BY component),
incident AS (SELECT a AS record_id, max(ratio) AS best_ratio, round(avg(ratio), 9) AS avg_ratio, bool_or(md5_match) AS md5_overlap FROM incidence GROUP BY a)"""


GROUPS_OUT = " SELECT run_id, group_id, member_count, pair_count, md5_overlap_pairs FROM sized JOIN paired USING (component)"
MEMBERS_OUT = " SELECT run_id, group_id, record_id, best_ratio, avg_ratio, md5_overlap FROM labelled JOIN incident USING (record_id)"


def _groups(result: tuple[DataFrame, DataFrame]) -> DataFrame:
    return result[0].select("run_id", "group_id", "member_count", "pair_count", "md5_overlap_pairs")


def _members(result: tuple[DataFrame, DataFrame]) -> DataFrame:
    return result[1].select("run_id", "group_id", "record_id", "best_ratio", F.round("avg_ratio", 9).alias("avg_ratio"), "md5_overlap")


def intent_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fuzzy_groups(eligible(page_records(spark, sf_dir)), comparable_intent(F.col("intent")), "fuzzy", THRESHOLD)


def code_groups(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    return fuzzy_groups(eligible(rows), F.col("normalized_code"), "normalized_code_fuzzy", threshold)


@query(groups_sql(PAGE_RECORDS, INTENT, THRESHOLD, FUNCTIONS) + GROUPS_OUT)
def fuzzy_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(intent_groups(spark, sf_dir))


@query(groups_sql(PAGE_RECORDS, INTENT, THRESHOLD, FUNCTIONS) + MEMBERS_OUT)
def fuzzy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(intent_groups(spark, sf_dir))


@query(groups_sql(PART_RECORDS, CODE, THRESHOLD, FUNCTIONS) + GROUPS_OUT)
def code_fuzzy_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(code_groups(part_records(spark, sf_dir), THRESHOLD))


@query(groups_sql(PART_RECORDS, CODE, THRESHOLD, FUNCTIONS) + MEMBERS_OUT)
def code_fuzzy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(code_groups(part_records(spark, sf_dir), THRESHOLD))


# The same on the texts of documents, which are beyond what the SQL's bits hold.


@query()
def code_ratio_edges_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_edges(eligible(records(spark, sf_dir)), F.col("normalized_code"), 0.7)


@query()
def code_fuzzy_group_sizes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(code_groups(records(spark, sf_dir), 0.7))


@query()
def code_fuzzy_members_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(code_groups(records(spark, sf_dir), 0.7))


@query(groups_sql(PAGE_RECORDS, INTENT, THRESHOLD, "true") + " SELECT record_id AS node, component FROM comp")
def fuzzy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(record_edges(page_records(spark, sf_dir), comparable_intent(F.col("intent")), THRESHOLD))


REPORT_SQL = (
    groups_sql(PAGE_RECORDS, INTENT, THRESHOLD, FUNCTIONS)
    + f""" SELECT l.run_id, 'fuzzy' AS match_type, group_id, l.record_id, kind, file_path, coalesce(signature, 'None') AS signature, coalesce(intent, 'None') AS said,
  start_line || '-' || end_line AS lines, printf('%.4f', best_ratio) AS best_ratio, CASE WHEN md5_overlap THEN 'yes' ELSE 'no' END AS md5_overlap
FROM labelled l JOIN incident USING (record_id) JOIN ({PAGE_RECORDS}) AS x USING (record_id)"""
)


@query(REPORT_SQL)
def report_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rows(intent_groups(spark, sf_dir)[1]).drop("avg_ratio")


@query()
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check on full texts: exact, intent and code groups of every run."""
    return find_duplicates(records(spark, sf_dir), THRESHOLD)[0]


# Stored runs.


@query(f"SELECT * FROM ({RECORDS}) WHERE {FUNCTIONS}")
def eligible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(records(spark, sf_dir))


LOADED = "record_id, kind, file_path, signature, normalized_code, md5sum, intent, start_line, end_line"


@query(f"SELECT {LOADED} FROM ({RECORDS}) WHERE run_id = 3 AND {FUNCTIONS}")
def load_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible_of_run(records(spark, sf_dir), 3)


@query(f"SELECT {LOADED} FROM ({RECORDS}) WHERE run_id = -1")
def missing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible_of_run(records(spark, sf_dir), -1)


@query(f"SELECT run_id, count(*) AS record_count, count(*) FILTER (intent_status = 'failed') AS intent_failed_count, CASE WHEN count(*) FILTER (intent_status = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM ({RECORDS}) GROUP BY run_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_counts(records(spark, sf_dir)).withColumn("status", run_status(F.lit(0), F.col("intent_failed_count")))


@query(f"SELECT row_number() OVER (ORDER BY file_path) + 1000 AS assigned, file_path FROM ({RECORDS})")
def assign_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(records(spark, sf_dir).select("file_path"), "file_path", name="assigned", start=1001)


PERSISTED_SQL = f"SELECT row_number() OVER (ORDER BY file_path) AS record_id, file_path, kind, md5sum FROM ({RECORDS})"


@query(f"SELECT * FROM ({PERSISTED_SQL}) WHERE {FUNCTIONS}")
def persist_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = RunStore(spark, scratch_path(spark, "store"))
    rows = records(spark, sf_dir).withColumn("seq", F.lit(0))
    run = store.persist(rows, 0, "/", "offline", "none", "all", 10)
    return store.load(run["run_id"]).select("record_id", "file_path", "kind", "md5sum")


# Intents.

ASKED = ["class", "function", "method"]
ENRICHED_SQL = f"""
WITH r AS (SELECT record_id, kind, raw_code FROM ({RECORDS})),
e AS (SELECT record_id, kind, CASE WHEN kind = 'file' THEN NULL WHEN contains(raw_code, 'the') THEN NULL ELSE 'intent::' || length(raw_code) END AS intent,
  CASE WHEN kind = 'file' THEN 'skipped' WHEN contains(raw_code, 'the') THEN 'failed' ELSE 'success' END AS intent_status,
  CASE WHEN kind <> 'file' AND contains(raw_code, 'the') THEN 'refused' END AS intent_error FROM r)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = records(spark, sf_dir).withColumns({"intent": F.lit(None).cast("string"), "intent_status": F.lit("skipped"), "intent_error": F.lit(None).cast("string")})
    return enriched(fresh, lambda: OfflineClient("the"), ASKED)


@query(f"{ENRICHED_SQL} SELECT * FROM e")
def enrich_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("record_id", "kind", "intent", "intent_status", "intent_error")


@query(f"{ENRICHED_SQL} SELECT kind, intent_status, count(*) AS n FROM e GROUP BY ALL")
def enrich_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).groupBy("kind", "intent_status").agg(F.count("*").alias("n"))


@query(f"{ENRICHED_SQL} SELECT *, intent_status = 'failed' AS asked FROM e")
def enrich_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second job with the answers of a first asks only where the first was refused."""
    fresh = records(spark, sf_dir).withColumns({"intent": F.lit(None).cast("string"), "intent_status": F.lit("skipped"), "intent_error": F.lit(None).cast("string")})
    log = scratch_path(spark, "answers")
    for _ in range(2):
        out = enriched_once(fresh, lambda: OfflineClient("the"), ASKED, log, "offline", per_part=50_000)
    return out.select("record_id", "kind", "intent", "intent_status", "intent_error", F.col("elapsed").isNotNull().alias("asked"))


TICKS_SQL = """
WITH c AS (SELECT event_id + 1 AS n, (event_id % 8) / 4.0 AS elapsed, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS failed FROM events),
s AS (SELECT n, max(n) OVER () AS total, sum(failed) OVER w AS failed, (sum(elapsed) OVER w)::DOUBLE / n AS mean_seconds FROM c WINDOW w AS (ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT n, total, failed::BIGINT AS failed, mean_seconds, n * 100.0::DOUBLE / total AS percent, round_even((total - n) * mean_seconds, 0)::BIGINT AS eta_seconds FROM s WHERE n % 10 = 0 OR n = total"""


@query(TICKS_SQL)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    calls = spark.sql("SELECT event_id + 1 AS n, CAST(event_id % 8 AS DOUBLE) / 4 AS elapsed, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS failed FROM events")
    return progress_ticks(calls, 10)


# Text of code.

MIXED = "concat('# first', chr(10), text, chr(10), '   # indented', chr(10), '   ', chr(10), text, chr(10), 'x = 1  # stays', chr(10))"


@query(f"SELECT doc_id, md5(array_to_string(list_filter(string_split({MIXED}, chr(10)), lambda x: NOT regexp_matches(x, '^[\\x09-\\x0D\\x1C-\\x20]*#')), chr(10))) AS stripped FROM documents")
def strip_comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "documents")
    return spark.table("documents").select("doc_id", F.md5(without_comment_lines(F.expr(MIXED))).alias("stripped"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter(string_split({MIXED}, chr(10)), lambda x: NOT regexp_matches(x, '^[\\x09-\\x0D\\x1C-\\x20]*$')), chr(10))) AS stripped FROM documents")
def strip_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "documents")
    return spark.table("documents").select("doc_id", F.md5(without_blank_lines(F.expr(MIXED))).alias("stripped"))


# Symbols of generated sources: (kind, first line, last line, last line of the header).

LAST = 22
PARTS = [("file", 1, LAST, None), ("class", 6, 12, 6), ("method", 10, 12, 11), ("function", 15, 20, 16), ("function", 18, 19, 18)]


def symbols_sql(extra: str = "") -> str:
    one = []
    for seq, (kind, a, b, header) in enumerate(PARTS):
        raw = joined(a, b) + (" || chr(10)" if kind == "file" else "")
        one.append(f"SELECT p_partkey, '{kind}' AS kind, {PATH} AS file_path, {joined(a, header) if header else 'NULL::VARCHAR'} AS signature, {a} AS start_line, {b} AS end_line, {raw} AS raw_code, {seq} AS seq FROM part WHERE NOT ({BROKEN})")
    return " UNION ALL ".join(one)


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_symbols(tagged_symbols(sources(spark, sf_dir)))[0]


@query(f"SELECT kind, file_path, signature, start_line, end_line, raw_code, seq FROM ({symbols_sql()})")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir)


@query(f"SELECT kind, count(*) AS n, count(signature) AS signed, sum(end_line - start_line + 1)::BIGINT AS lines FROM ({symbols_sql()}) GROUP BY kind")
def symbols_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count("signature").alias("signed"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))


@query(f"SELECT {PATH} AS file_path, true AS told FROM part WHERE {BROKEN}")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_symbols(tagged_symbols(sources(spark, sf_dir)))[1].select("file_path", (F.length("message") > 0).alias("told"))


#: Lines that stay in the normalised form of each part.
KEPT = {0: [2, 3, 6, 8, 10, 12, 14, 15, 16, 18, 19, 20, 21, 22], 1: [6, 8, 10, 12], 2: [10, 12], 3: [15, 16, 18, 19, 20], 4: [18, 19]}


def _kept(seq: int) -> str:
    return f"concat_ws(chr(10), {', '.join(joined(i, i) for i in KEPT[seq])})"


NORMALIZED_SQL = " UNION ALL ".join(f"SELECT {PATH} AS file_path, {seq} AS seq, {_kept(seq)} AS normalized_code FROM part WHERE NOT ({BROKEN})" for seq in KEPT)


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nested bodies are indented, which the tokenizer refuses on its own; such texts keep their strings.
    return _symbols(spark, sf_dir).select("file_path", "seq", normalize_code(F.col("raw_code")).alias("normalized_code"))


@query(f"SELECT * FROM ({NORMALIZED_SQL})")
def normalize_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir)


@query(f"SELECT file_path, seq, md5(normalized_code) AS md5sum FROM ({NORMALIZED_SQL})")
def normalized_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).select("file_path", "seq", fingerprint(F.col("normalized_code")).alias("md5sum"))


@query(f"SELECT to_json(struct_pack(kind := kind, n := n)) AS json FROM (SELECT kind, count(*) AS n FROM ({RECORDS}) GROUP BY kind)")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_json(records(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")))


# The rename map of generated sources.


@query("SELECT DISTINCT name FROM (SELECT source AS name FROM documents UNION ALL SELECT 'src' UNION ALL SELECT 'parts')")
def local_module_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = records(spark, sf_dir).select("file_path").unionByName(sources(spark, sf_dir).select("file_path")).unionByName(spark.createDataFrame([("__init__.py",), ("src/__init__.py",)], "file_path string"))
    return module_roots(paths)


#: What each generated file tells, as (category, name expression).
FACTS = [
    ("external", "'os'"),
    ("candidate", "'Root'"),
    ("class", f"'Part' || {KEY}"),
    ("candidate", f"'Part' || {KEY}"),
    ("attribute", "'size'"),
    ("candidate", "'size'"),
    ("attribute", f"'price_' || {KEY}"),
    ("candidate", f"'price_' || {KEY}"),
    ("candidate", "'self'"),
    ("candidate", "'factor'"),
    ("candidate", f"'make_' || {KEY}"),
    ("candidate", "'first'"),
    ("candidate", "'second'"),
    ("candidate", "'inner'"),
    ("dynamic", f"'price_' || {KEY}"),
    ("candidate", "'unseen'"),
]
INDEX_SQL = " UNION ".join(f"SELECT '{c}' AS category, {n} AS name FROM part WHERE NOT ({BROKEN})" for c, n in FACTS)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(project_index(symbol_rows(sources(spark, sf_dir), ["src", "parts"])), "index")


@query(INDEX_SQL)
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


TARGETS_SQL = f"SELECT DISTINCT name FROM ({INDEX_SQL}) WHERE category IN ('candidate', 'attribute') AND name NOT IN ('os')"


@query(TARGETS_SQL)
def rename_target_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_targets(_index(spark, sf_dir))


BASE26_SQL = """
WITH RECURSIVE b AS (SELECT event_id AS id, event_id AS n, '' AS s FROM events UNION ALL SELECT id, n // 26 - 1, chr((97 + n % 26)::INTEGER) || s FROM b WHERE n >= 0)
SELECT id, s AS name FROM b WHERE n < 0"""


@query(BASE26_SQL)
def base26_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.table("events").select(F.col("event_id").alias("id"), base26(F.col("event_id")).alias("name"))


RESERVED = f"SELECT unnest([{', '.join(f"'{x}'" for x in reserved_names())}]) AS name"


def map_sql(index: str) -> str:
    """The rename map of an index: the i-th target gets the i-th name that is not taken."""
    return f"""
WITH RECURSIVE i AS ({index}), t AS (SELECT DISTINCT name FROM i WHERE category IN ('candidate', 'attribute') AND name NOT IN (SELECT name FROM i WHERE category = 'external')),
taken AS (SELECT name FROM t UNION SELECT name FROM i WHERE category = 'external' UNION {RESERVED}),
b AS (SELECT range AS id, range AS n, '' AS s FROM range(100000) UNION ALL SELECT id, n // 26 - 1, chr((97 + n % 26)::INTEGER) || s FROM b WHERE n >= 0),
free AS (SELECT s AS new_name, row_number() OVER (ORDER BY id) AS place FROM b WHERE n < 0 AND s NOT IN (SELECT name FROM taken)),
ranked AS (SELECT name AS symbol, row_number() OVER (ORDER BY name) AS place FROM t)
SELECT symbol, new_name, symbol IN (SELECT name FROM i WHERE category = 'dynamic') AS likely_local FROM ranked JOIN free USING (place)"""


@query(map_sql(INDEX_SQL))
def rename_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_map(_index(spark, sf_dir))


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return rewrite_files(sources(spark, sf_dir), index, stored(rename_map(index), "rename-map"))


@query(f"SELECT {PATH} AS file_path, {BROKEN} AS failed, CASE WHEN {BROKEN} THEN 0 ELSE 20 END AS symbols_renamed, CASE WHEN {BROKEN} THEN 0 ELSE 1 END AS likely_local_rewrites, CASE WHEN {BROKEN} THEN 0 ELSE 1 END AS dynamic_name_rewrites FROM part")
def rewrite_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir).select("file_path", F.col("error").isNotNull().alias("failed"), "symbols_renamed", "likely_local_rewrites", "dynamic_name_rewrites")


def _feature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(project_index(symbol_rows(features.feature_sources(spark, sf_dir), ["src", "parts"])), "feature-index")


@query(features.INDEX_SQL)
def feature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature_index(spark, sf_dir)


@query(features.after_sql(map_sql(features.INDEX_SQL), f"SELECT name FROM ({features.INDEX_SQL}) WHERE category IN ('candidate', 'external') UNION {RESERVED}"))
def rewrite_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole new text of sources that use every construct."""
    index = _feature_index(spark, sf_dir)
    out = rewrite_files(features.feature_sources(spark, sf_dir), index, stored(rename_map(index), "feature-map"))
    return out.select("file_path", "transformed_source", "unchanged", "symbols_renamed", "likely_local_rewrites", "dynamic_name_rewrites")


@query(f"SELECT count(*) AS python_files, count(*) FILTER ({BROKEN}) AS failed, 20 * count(*) FILTER (NOT ({BROKEN})) AS symbols_renamed, count(*) FILTER (NOT ({BROKEN})) AS symbols_renamed_likely_local, count(*) FILTER (NOT ({BROKEN})) AS dynamic_name_rewrites FROM part")
def rewrite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a project."""
    sums = {"symbols_renamed": "symbols_renamed", "likely_local_rewrites": "symbols_renamed_likely_local", "dynamic_name_rewrites": "dynamic_name_rewrites"}
    return _rewritten(spark, sf_dir).agg(F.count("*").alias("python_files"), F.count_if(F.col("error").isNotNull()).alias("failed"), *[F.sum(c).alias(n) for c, n in sums.items()])


# Ignore rules on generated paths: a root file's and those of a nested folder, put below it.

RULES = ["# comment", "*.log", "build/", "/top.txt", "!keep.log", "docs/*.md"]
NESTED = ["*.tmp", "/a?.c", "!keep.log", "old/"]
TAILS = ["a.log", "keep.log", "x/b.log", "build/z.py", "x/build/y", "top.txt", "x/top.txt", "docs/a.md", "docs/b/a.md", "src/m.py", "p.tmp", "x/p.tmp", "sub/p.tmp", "sub/x/p.tmp", "sub/ab.c", "sub/abc.c", "sub/x/ab.c", "sub/old/f", "sub/x/old/f", "sub/d.log"]


@query(
    f"WITH p AS (SELECT page_id, unnest({TAILS}) AS tail FROM pages), "
    "f AS (SELECT 'p' || page_id || '/' || tail AS path, '/' || tail AS t FROM p) "
    "SELECT path, (t LIKE '%.log' AND NOT t LIKE '%/keep.log') OR t LIKE '%/build/%' OR regexp_matches(path, '^p0/(sub)/[^/]*[.]tmp$|^p0/sub/a.[.]c$|^p0/sub/old/') AS ignored FROM f"
)
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "pages")
    rules = IgnoreRules([*RULES, *(rebased(x, "p0/sub") for x in NESTED)])
    tails = ", ".join(f"'{x}'" for x in TAILS)
    paths = spark.sql(f"SELECT concat('p', page_id, '/', tail) AS path FROM pages LATERAL VIEW explode(array({tails})) AS tail")
    return paths.select("path", rules.column(F.col("path")).alias("ignored"))
