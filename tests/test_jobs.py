"""The two jobs: growing input, repeated and broken runs, command lines, and their outcome against plain Python."""

import json
import re
import subprocess
import sys
from collections import defaultdict
from hashlib import md5
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import duplicate_report, duplicate_watch
from jobs.common import settings

ROOT = Path(__file__).resolve().parents[1]
SCHEMA = "doc_id long, text string, source string, run string"
CODE = "def f():\n    return {}\n"
FIRST = [(1, CODE.format(1), "a", "x"), (2, "# note\n\n" + CODE.format(1), "a", "x"), (3, CODE.format(2), "a", "x"), (4, CODE.format(1), "b", "x"), (5, None, "b", "x"), (6, "", "b", "x"), (7, "# only\n", "b", "x"), (None, "y", None, "x"), (None, "z", "", "x")]
SECOND = [(8, CODE.format(2), "a", "x"), (9, CODE.format(9), "c", "x"), (9, CODE.format(9), "c", "x"), (None, "y\n", None, "x"), (4, CODE.format(4), "b", "x")]


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def plain(rows):
    """The outcome that the latest of rows with one run and id should give."""
    last = {}
    for i, text, source, _ in rows:
        code = None if text is None else "\n".join(x for x in text.split("\n") if x.strip() and not x.strip().startswith("#"))
        digest = None if code is None else md5(code.encode()).hexdigest()
        last[source or "(none)", i, digest if i is None else None] = digest
    groups = defaultdict(list)
    for (run, i, _), digest in last.items():
        groups[run, digest].append(i)
    size = lambda run, digest: len(groups[run, digest]) if digest and len(groups[run, digest]) > 1 else 1
    return sorted((run, str(i), str(d), size(run, d)) for (run, i, _), d in last.items())


def outcome(spark, out):
    return sorted((r.run, str(r.record_id), str(r.md5sum), r.member_count) for r in duplicate_watch.outcome(spark, out).collect())


def written(folder):
    return {p.relative_to(folder).as_posix(): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


@pytest.fixture
def place(tmp_path):
    return {x: str(tmp_path / x) for x in ("in", "out", "mark")}


def watch(spark, place, **config):
    return duplicate_watch.watch(spark, place["in"], place["out"], place["mark"], config)


def test_watch_takes_only_what_is_new(spark, place):
    put(spark, FIRST, place["in"])
    assert [x["records"] for x in watch(spark, place)] == [len(FIRST)]
    assert outcome(spark, place["out"]) == plain(FIRST)
    before = written(place["out"])
    assert watch(spark, place) == [] and written(place["out"]) == before
    put(spark, SECOND, place["in"])
    assert [x["records"] for x in watch(spark, place)] == [len(SECOND)]
    assert outcome(spark, place["out"]) == plain(FIRST + SECOND)
    after = written(place["out"])
    # Fingerprints of the first batch stay as they were; only groups of runs in the second are made anew.
    assert {k: v for k, v in after.items() if "batch=0" in k} == {k: v for k, v in before.items() if "batch=0" in k}
    groups = duplicate_watch.read_or_empty(spark, f"{place['out']}/groups", duplicate_watch.GROUPS)
    assert {r.run: (r.member_count, r.pair_count) for r in groups.where("md5sum IS NULL").collect()} == {"a": (4, 2), "b": (4, 1), "c": (1, 0), "(none)": (2, 0)}
    # Record 4 has left its run's only group of two different texts; 6 and 7 are both empty.
    assert [r.first_record for r in groups.where("run = 'b' AND md5sum IS NOT NULL").collect()] == [6]


def test_watch_in_small_batches_gives_the_same(spark, place):
    for row in FIRST + SECOND:
        put(spark, [row], place["in"])
    log = watch(spark, place, files_per_batch=3)
    assert len(log) == 5 and sum(x["records"] for x in log) == len(FIRST + SECOND)
    assert {x[:2] for x in outcome(spark, place["out"])} == {x[:2] for x in plain(FIRST + SECOND)}
    assert outcome(spark, place["out"]) == plain(FIRST + SECOND)


def test_watch_repeats_a_batch_that_failed(spark, place, monkeypatch):
    put(spark, FIRST, place["in"])
    watch(spark, place)
    put(spark, SECOND, place["in"])
    whole = duplicate_watch.grouped
    monkeypatch.setattr(duplicate_watch, "grouped", lambda _: 1 / 0)  # after the fingerprints are written
    with pytest.raises(Exception, match="division by zero"):
        watch(spark, place)
    monkeypatch.setattr(duplicate_watch, "grouped", whole)
    assert [x["batch"] for x in watch(spark, place)] == [1]
    assert outcome(spark, place["out"]) == plain(FIRST + SECOND)


def test_watch_of_nothing_and_of_a_single_file(spark, place, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(place["in"])
    assert sum(x["records"] for x in watch(spark, place)) == 0 and outcome(spark, place["out"]) == []
    put(spark, FIRST, str(tmp_path / "one"))
    file = next(Path(tmp_path / "one").glob("*.parquet"))
    duplicate_watch.watch(spark, str(file), f"{place['out']}2", f"{place['mark']}2")
    assert outcome(spark, f"{place['out']}2") == plain(FIRST)


def test_watch_with_the_tokenizer(spark, place):
    put(spark, [(1, 'def f():\n    """Doc."""\n    return 1\n', "a", "x"), (2, "def f():\n    return 1\n", "a", "x")], place["in"])
    watch(spark, place, normalise="code")
    assert {x[3] for x in outcome(spark, place["out"])} == {2}


# The report.

RULES = {"record_id": "doc_id", "run_id": "CASE source WHEN 'a' THEN 1 ELSE 2 END", "kind": "'function'", "file_path": "concat(source, '/', doc_id, '.py')", "signature": "NULL", "code": "text", "intent": "intent"}
ROWS = [(1, CODE.format(1), "a", "adds two numbers"), (2, CODE.format(1), "a", "adds two number"), (3, CODE.format(77), "a", "something else"), (4, CODE.format(1), "b", None), (5, "other " * 9, "b", None), (6, CODE.format(1), "b", "x")]


def read_report(spark, out):
    return sorted((r.run_id, r.match_type, r.group_id, r.record_id, r.best_ratio, r.md5_overlap) for r in duplicate_report.outcome(spark, out).collect())


WANT = [
    (1, "exact", 1, 1, "1.0000", "yes"),
    (1, "exact", 1, 2, "1.0000", "yes"),
    (1, "fuzzy", 1, 1, "0.9677", "yes"),
    (1, "fuzzy", 1, 2, "0.9677", "yes"),
    (1, "normalized_code_fuzzy", 1, 1, "1.0000", "yes"),
    (1, "normalized_code_fuzzy", 1, 2, "1.0000", "yes"),
    (1, "normalized_code_fuzzy", 1, 3, "0.9333", "no"),
    (2, "exact", 1, 4, "1.0000", "yes"),
    (2, "exact", 1, 6, "1.0000", "yes"),
    (2, "fuzzy", 1, 4, "1.0000", "no"),
    (2, "fuzzy", 1, 5, "1.0000", "no"),
    (2, "normalized_code_fuzzy", 1, 4, "1.0000", "yes"),
    (2, "normalized_code_fuzzy", 1, 6, "1.0000", "yes"),
]


def test_report_of_all_runs_and_of_one(spark, tmp_path):
    table, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string, intent string").withColumn("run_id", F.lit("clash"))
    frame.write.parquet(table)
    for _ in range(2):
        counts = duplicate_report.report(spark, table, out, RULES)
        assert counts == {"records": 6, "groups": 6, "members": 13, "runs": 2}
        assert read_report(spark, out) == WANT
    # The second run loses a record; a report of that run alone leaves the first as it was.
    frame.where("doc_id <> 6").write.mode("overwrite").parquet(table)
    before = {k: v for k, v in written(out).items() if "run_id=1" in k}
    duplicate_report.report(spark, table, out, RULES | {"runs": [2], "compare": ["exact", "fuzzy", "normalized_code_fuzzy"]})
    assert {k: v for k, v in written(out).items() if "run_id=1" in k} == before
    assert [x for x in read_report(spark, out) if x[0] == 1] == [x for x in WANT if x[0] == 1]
    assert [x for x in read_report(spark, out) if x[0] == 2] == [x for x in WANT if x[:2] == (2, "fuzzy")]


def test_report_leaves_out_ignored_files_and_empty_tables(spark, tmp_path):
    table, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string, intent string")
    frame.write.parquet(table)
    duplicate_report.report(spark, table, out, RULES | {"ignore": ["b/", "!b/4.py", "a/2.py"], "compare": ["exact"]})
    assert read_report(spark, out) == []
    runs = {r.run_id: (r.records, r.compared, r.ignored) for r in spark.read.parquet(f"{out}/runs").collect()}
    assert runs == {1: (3, 2, 1), 2: (3, 1, 2)}
    frame.limit(0).write.parquet(f"{table}0")
    assert set(duplicate_report.report(spark, f"{table}0", f"{out}0", RULES).values()) == {0}
    with pytest.raises(ValueError, match="compare"):
        duplicate_report.report(spark, table, out, RULES | {"compare": ["else"]})
    with pytest.raises(ValueError, match="threshold"):
        duplicate_report.report(spark, table, out, RULES | {"threshold": 2})


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"run": "x"}))
    assert settings(path, duplicate_watch.USUAL) == duplicate_watch.USUAL | {"run": "x"}
    path.write_text(json.dumps({"rum": "x"}))
    with pytest.raises(ValueError, match="rum"):
        settings(path, duplicate_watch.USUAL)
    for name, usual in (("duplicate_watch", duplicate_watch.USUAL), ("duplicate_report", duplicate_report.USUAL)):
        assert set(settings(ROOT / "jobs" / f"{name}.json", usual)) == set(usual)


def test_command_lines(spark, tmp_path):
    put(spark, FIRST, str(tmp_path / "in"))
    spark.createDataFrame(ROWS, "doc_id long, text string, source string, intent string").write.parquet(str(tmp_path / "table"))
    (tmp_path / "rules.json").write_text(json.dumps(RULES | {"compare": ["exact"]}))
    runs = {
        "duplicate_watch": ["--config", str(ROOT / "jobs/duplicate_watch.json"), "--input", str(tmp_path / "in"), "--checkpoint", str(tmp_path / "mark")],
        "duplicate_report": ["--config", str(tmp_path / "rules.json"), "--input", str(tmp_path / "table")],
    }
    for name, options in runs.items():
        done = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--master", "local[2]", "--output", str(tmp_path / name), *options], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
        assert done.returncode == 0, done.stderr[-2000:]
        assert re.search(rf"{name} .*(9 new records|read 6 records, wrote 2 groups)", done.stderr), done.stderr[-2000:]
    assert outcome(spark, str(tmp_path / "duplicate_watch")) == plain(FIRST)
    assert [x for x in read_report(spark, str(tmp_path / "duplicate_report"))] == [x for x in WANT if x[1] == "exact"]


def test_jobs_do_not_need_the_corpus_operators():
    for path in (ROOT / "jobs").glob("*.py"):
        assert not re.search(r"echoloom\.llm|corpus_pipeline", path.read_text())
