"""Work that must be spread over tasks, and must not be done twice."""

from pyspark.sql import functions as F

from echoloom.functions.similarity import indel_ratio
from echoloom.operators import enrich
from echoloom.operators.components import connected_components
from echoloom.operators.duplicates import edge_counts
from echoloom.operators.rewrite import rewrite_files
from echoloom.operators.similar_pairs import MARKED, SUM, TIE, _blocks, pair_sums, similar_pairs
from echoloom.operators.symbols import project_index, rename_map, symbol_rows
from echoloom.plans import features
from echoloom.plans.bindings import FILES_A_TASK, sources
from echoloom.scratch import stored


def parts(spark, folder, n):
    """A table of n parts in one file with one row group."""
    rows = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("red nut").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), F.lit(3).alias("p_size"), F.lit(900.0).alias("p_retailprice"))
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_generated_files_are_dealt_to_tasks_by_their_number(spark, tmp_path):
    path = parts(spark, tmp_path, 3 * FILES_A_TASK)
    for files in (sources(spark, path), features.feature_sources(spark, path)):
        sizes = [r["count"] for r in files.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 3 and max(sizes) < 1.2 * FILES_A_TASK


def test_an_index_parses_each_file_once(spark, tmp_path):
    path = parts(spark, tmp_path, 60)
    index = project_index(symbol_rows(sources(spark, path), ["src", "parts"]))
    assert index._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert ("external", "os") in {tuple(r) for r in index.collect()}


def test_what_grows_with_the_names_of_a_project_is_not_broadcast(spark, tmp_path):
    """Plans at a size where every side would be small enough to be gathered in the driver."""
    path = parts(spark, tmp_path, 60)
    index = stored(project_index(symbol_rows(sources(spark, path), ["src", "parts"])), "index")
    mapped = stored(rename_map(index), "map")
    tree = rewrite_files(sources(spark, path), index, mapped)._jdf.queryExecution().sparkPlan().toString()
    assert tree.count("SortMergeJoin") == 5 and "BroadcastHashJoin" not in tree


def test_counts_at_many_thresholds_take_one_comparison(spark):
    rows = [(1, i, x) for i, x in enumerate(["abcd", "abcd", "abcd", "abce", "wxyz", None])] + [(2, 9, "abcd")]
    counts = edge_counts(spark.createDataFrame(rows, "run_id long, record_id long, text string"), F.col("text"), (0.5, 0.75, 1.0))
    assert {r.threshold: r.pairs for r in counts.collect()} == {0.5: 6, 0.75: 6, 1.0: 3}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_blocks_of_short_texts_stay_in_many_tasks(spark):
    texts = spark.range(400).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("record_id"), F.lpad(F.col("id").cast("string"), 12, "a").alias("text"))
    assert similar_pairs(texts, 0.5, 20).select(F.spark_partition_id()).distinct().count() > 4


def test_pairs_are_summed_where_they_are_found(spark):
    """200 texts that are all alike make 19,900 pairs, but a few rows a text; sums are those of all pairs, long texts and weights included."""
    words = [f"{'ab' * (40 * (i % 2))}some words {i:03}" for i in range(200)]
    rows = [(1, i, x, i % 3 + 1, i in (3, 5, 8)) for i, x in enumerate(words)]
    frame = spark.createDataFrame(rows, "run_id long, record_id long, text string, weight int, mark boolean")
    got = pair_sums(frame, 0.7, 100).collect()
    near = {(i, j): indel_ratio(words[i], words[j]) for i in range(200) for j in range(i) if indel_ratio(words[i], words[j]) >= 0.7}
    assert len(near) > 9000 and len(got) < 200 * 6
    assert {(r.left_id, r.right_id) for r in got if r.what == MARKED} == {(j, i) for i, j in near if {i, j} <= {3, 5, 8}}
    for i in range(200):
        mine = [(q, rows[sum(k) - i][3]) for k, q in near.items() if i in k]
        sums = [r for r in got if r.what == SUM and r.left_id == i]
        assert max(r.best for r in sums) == max(q for q, _ in mine) and sum(r.met for r in sums) == sum(w for _, w in mine)
        assert abs(sum(r.total for r in sums) - sum(q * w for q, w in mine)) < 1e-9
    edges = spark.createDataFrame(list(near), "left_id long, right_id long")
    ties = spark.createDataFrame([(r.left_id, r.right_id) for r in got if r.what == TIE], "left_id long, right_id long")
    assert {tuple(r) for r in connected_components(ties).collect()} == {tuple(r) for r in connected_components(edges).collect()}


def test_blocks_of_short_texts_grow_with_their_number(spark):
    """A text is sent to at most 16 blocks until blocks are eight times as large, not to one for each ``block`` texts; neighbours stay together."""
    texts = spark.range(400).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("record_id"), F.lpad(F.col("id").cast("string"), 12, "a").alias("text"), F.lit(1).alias("weight"))
    sent = _blocks(texts, 0.5, 5)
    assert sent.count() == 400 * 16
    own = {frozenset(r.ids) for r in sent.where("split(key, '/')[0] = split(key, '/')[1]").groupBy("key").agg(F.collect_set("record_id").alias("ids")).collect()}
    ranked = sorted(range(400), key=lambda i: str(i).rjust(12, "a"))
    assert own == {frozenset(ranked[i : i + 25]) for i in range(0, 400, 25)}


def test_long_texts_are_dealt_to_many_tasks(spark):
    texts = spark.range(60).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("record_id"), F.concat(F.repeat(F.lit("some words of a long text "), 1000), "id").alias("text"))
    assert similar_pairs(texts, 0.7).select(F.spark_partition_id()).distinct().count() > 4


def test_long_input_is_asked_about_in_turns(spark, monkeypatch):
    """A task takes a bounded share of the text, and only code goes to Python."""
    monkeypatch.setattr(enrich, "CHARACTERS_A_TASK", 1000)
    rows = spark.range(500).select(F.when(F.col("id") % 5 > 0, "function").otherwise("file").alias("kind"), F.concat(F.lit("some code "), "id").alias("raw_code"))
    full = rows.withColumns({c: F.lit(None).cast("string") for c in ("intent", "intent_error")} | {"intent_status": F.lit("skipped")})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = enrich.enriched(full, lambda: enrich.OfflineClient("9"), ["function"], 2)
    assert len(out.inputFiles()) > 4 + 2 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    want = {(f"some code {i}", None if i % 5 == 0 or "9" in str(i) else f"intent::{len(str(i)) + 10}", "skipped" if i % 5 == 0 else "failed" if "9" in str(i) else "success") for i in range(500)}
    got = [(r.raw_code, r.intent, r.intent_status) for r in out.collect()]
    assert len(got) == 500 and set(got) == want


def test_answers_are_joined_without_moving_code(spark, tmp_path):
    rows = spark.range(50).select(F.lit("class").alias("kind"), F.concat(F.lit("some code "), "id").alias("raw_code"), "id", F.lit("skipped").alias("intent_status"))
    full = rows.withColumns({c: F.lit(None).cast("string") for c in ("intent", "intent_error")})
    out = enrich.enriched_once(full, enrich.OfflineClient, ["class"], str(tmp_path / "log"), "x", per_part=20).select("id", "intent")
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in tree and "normalized" not in tree and out.count() == 50
