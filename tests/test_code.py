"""Normalisation, extraction, intents, store and tree sources."""

import io
import json
import os
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from echoloom import cli, scratch
from echoloom.functions.normalize import normalized, without_blank_lines, without_comment_lines
from echoloom.operators.enrich import IntentError, OfflineClient, OllamaClient, OpenAIClient, chosen_client, enriched, enriched_once, normalized_provider, parsed_scopes
from echoloom.operators.extract import built_records, split_symbols, symbols_of, tagged_symbols
from echoloom.sources.store import RunStore
from echoloom.sources.tree import IgnoreRules, copy_project, python_paths, read_files, rebased

CASES = {
    '"""d"""\nx = 1\n': "x = 1",
    '\n"""d"""\nx = 1\n': '"""d"""\nx = 1',
    'def f():\n\n    """d"""\n    return 1\n': "def f():\n    return 1",
    'x = 1\n\n"s"\n': 'x = 1\n"s"',
    'x = 1\n"s"\n': "x = 1",
    'def f(): "doc"\n': 'def f(): "doc"',
    '"a" "b"\n': '"a" "b"',
    '"d"  # c\n': '"d"  # c',
    'f"{x}"\n': 'f"{x}"',
    "x = '''\n# gone\nkept\n'''\n": "x = '''\nkept\n'''",
    "  # c\nx = 1  # stays\n\n   \n": "x = 1  # stays",
    '    def m(self):\n        """d"""\n        return 1': "    def m(self):\n        return 1",
    "x = (\n": "x = (",
    "if x:\n        y\n    z\n": "if x:\n        y\n    z",
    "": "",
}


@pytest.mark.parametrize("code", CASES)
def test_normalized(code):
    assert normalized(code) == CASES[code]


def test_native_line_filters(spark):
    frame = spark.createDataFrame([("a\n \u3000# b\n\n \x1f\nc # d",), (None,), ("",)], "t string")
    got = frame.select(without_comment_lines(F.col("t")).alias("c"), without_blank_lines(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("a\n\n \x1f\nc # d", "a\n \u3000# b\nc # d"), (None, None), ("", "")]


SOURCE = '''import os


class A(Base):
    """Doc."""

    @property
    def m(
        self,
        x,
    ):
        # why
        @other
        def inner():
            pass
        return x

    class B:
        async def n(self): return 1


if os:
    def unseen(): pass


@deco
def top(): return 2
'''


def test_symbols_of():
    got = [(k, s, a, b) for k, s, a, b, _ in symbols_of(SOURCE)]
    assert got == [
        ("file", None, 1, 27),
        ("class", "class A(Base):", 4, 19),
        ("method", "    def m(\n        self,\n        x,\n    ):\n        # why", 8, 16),
        ("function", "        def inner():", 14, 15),
        ("class", "    class B:", 18, 19),
        ("method", "        async def n(self): return 1", 19, 19),
        ("function", "def top(): return 2", 27, 27),
    ]
    assert [x[0] for x in symbols_of("")] == ["file"] and next(symbols_of(""))[2:4] == (1, 1)


def project(root):
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "_x.py").write_text('def f():\n    """d"""\n    return 1\n')
    (root / "pkg" / ".hidden.py").write_text("class C:\n    def m(self):\n        return 1\n")
    (root / "bad.py").write_text("def f(:\n")
    (root / "latin.py").write_bytes(b"x = '\xe9'\n")
    (root / "dir.py").mkdir()
    return root


def test_scan_finds_hidden_files_and_keeps_errors(spark, tmp_path):
    files = read_files(python_paths(spark, str(project(tmp_path))))
    symbols, errors = split_symbols(tagged_symbols(files))
    assert {r.file_path for r in errors.collect()} == {"bad.py", "latin.py", "dir.py"}
    records = {(r.file_path, r.kind): r for r in built_records(symbols).collect()}
    assert set(records) == {("pkg/__init__.py", "file"), ("pkg/_x.py", "file"), ("pkg/_x.py", "function"), ("pkg/.hidden.py", "file"), ("pkg/.hidden.py", "class"), ("pkg/.hidden.py", "method")}
    assert records["pkg/_x.py", "function"].normalized_code == "def f():\n    return 1"
    assert records["pkg/__init__.py", "file"].md5sum == "d41d8cd98f00b204e9800998ecf8427e"
    empty = tmp_path / "none"
    empty.mkdir()
    assert python_paths(spark, str(empty)).count() == 0


def test_analyzers_by_suffix(spark):
    files = spark.createDataFrame([("a.py", "x = 1"), ("b.sql", "SELECT 1"), ("c.txt", "?")], "file_path string, content string")
    own = {".py": symbols_of, ".sql": lambda text: iter([("file", None, 1, 1, text)])}
    symbols, errors = split_symbols(tagged_symbols(files, own))
    assert sorted((r.file_path, r.raw_code) for r in symbols.collect()) == [("a.py", "x = 1"), ("b.sql", "SELECT 1")]
    assert [tuple(r) for r in errors.collect()] == [("c.txt", "no analyzer")]


def test_enrichment_keeps_failures(spark):
    rows = spark.createDataFrame([("file", "f", "abc"), ("function", "f", "bad one"), ("method", "f", "x\ny"), ("class", "f", "k")], "kind string, file_path string, raw_code string")
    full = rows.withColumns({c: F.lit(None).cast("string") for c in ("intent", "intent_error")} | {"intent_status": F.lit("skipped")})
    got = {r.kind: (r.intent, r.intent_status, r.intent_error) for r in enriched(full, lambda: OfflineClient("bad"), ["function", "method"]).collect()}
    assert got == {"file": (None, "skipped", None), "function": (None, "failed", "refused"), "method": ("intent::3", "success", None), "class": (None, "skipped", None)}
    with pytest.raises(ValueError):
        enriched(full, OfflineClient, ["function"], 0)


ROWS = [("function", "a.py", 1, "def f(): 1"), ("function", "b.py", 1, "def f(): 1"), ("method", "a.py", 2, "bad"), ("class", "c.py", 1, "class C: 2"), ("file", "a.py", 0, "all of it"), (None, "d.py", 1, "?"), ("function", "e.py", 1, None), ("function", "f.py", 1, "last")]


def counting(folder, breaks=None):
    """Makes clients that leave a file for each call; ``breaks`` ends the job there."""

    class Counting(OfflineClient):
        def intent(self, code):
            (Path(folder) / uuid.uuid4().hex).write_text(code)
            if breaks and breaks in code:
                raise RuntimeError("the machine is gone")
            return super().intent(code)

    return lambda: Counting("bad")


def asked_rows(spark):
    rows = spark.createDataFrame(ROWS, "kind string, file_path string, seq int, raw_code string")
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("intent", "intent_error")} | {"intent_status": F.lit("skipped"), "asked_in": F.lit("clash"), "n": F.lit(0)})


def test_equal_code_is_asked_once_and_remembered(spark, tmp_path):
    full, calls, log, told = asked_rows(spark), tmp_path / "calls", str(tmp_path / "log"), []
    calls.mkdir()

    def run(scopes, breaks=None, client="x", **more):
        before = len(list(calls.iterdir()))
        out = enriched_once(full, counting(calls, breaks), scopes, log, client, workers=2, tell=told.append, order=("file_path", "seq"), **more)
        rows = {(r.file_path, r.seq): (r.intent, r.intent_status, r.intent_error, r.elapsed is not None) for r in out.collect()}
        return rows, len(list(calls.iterdir())) - before, out.columns

    scopes = ["function", "method", "class"]
    got, n, columns = run(scopes, per_part=2)
    assert n == 5 and columns == [*full.columns, "elapsed"]
    assert [(t.n, t.total, t.failed) for t in told] == [(2, 5, 1), (4, 5, 1), (5, 5, 1)] and told[-1].eta_seconds == 0
    want = {("a.py", 1): ("intent::10", "success", None, True), ("b.py", 1): ("intent::10", "success", None, True), ("a.py", 2): (None, "failed", "refused", True), ("c.py", 1): ("intent::10", "success", None, True), ("a.py", 0): (None, "skipped", None, False), ("d.py", 1): (None, "skipped", None, False), ("e.py", 1): ("intent::0", "success", None, True), ("f.py", 1): ("intent::4", "success", None, True)}
    assert got == want
    # Again: only what was refused.  Another client: everything.  With no question there is one report.
    got, n, _ = run(scopes)
    assert n == 1 and got == {k: (*v[:3], k == ("a.py", 2)) for k, v in want.items()}
    assert run(scopes, client="y")[1] == 5 and run(["class"])[1] == 0 and told[-1].percent == 100.0
    assert run(["file"])[1] == 1 and enriched_once(full.limit(0), OfflineClient, scopes, log, "x").count() == 0
    with pytest.raises(ValueError, match="workers"):
        run(scopes, per_part=0)


def test_a_killed_job_asks_only_what_is_left(spark, tmp_path):
    full, calls, log = asked_rows(spark), tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    ask = lambda breaks: enriched_once(full, counting(calls, breaks), ["function", "class"], log, "x", workers=1, per_part=1, order=("file_path", "seq"))
    with pytest.raises(Exception, match="the machine is gone"):
        ask("class C")
    codes = lambda: sorted(p.read_text() for p in calls.iterdir())
    before = codes()
    assert set(before) == {"def f(): 1", "class C: 2"}
    assert {r.intent_status for r in ask(None).where("kind IN ('function', 'class')").collect()} == {"success"}
    again = codes()
    for code in before:
        again.remove(code)
    assert again == ["", "class C: 2", "last"]


def test_progress_comes_before_the_end(spark, tmp_path):
    """Answers of a part are in the log, and told of, before the next part is asked."""
    full, log, seen = asked_rows(spark), str(tmp_path / "log"), []

    def tell(t):
        seen.append((t.n, spark.read.parquet(log).count()))

    enriched_once(full, lambda: OfflineClient("bad"), ["function", "method", "class"], log, "x", per_part=2, tell=tell)
    assert seen == [(2, 2), (4, 4), (5, 5)]


def test_clients_and_providers():
    sent = []

    def answer(body):
        def send(request):
            sent.append((request.full_url, json.loads(request.data)))
            return json.dumps(body).encode()

        return send

    assert OllamaClient("http://h:1/", "m", send=answer({"response": " it adds "})).intent("code") == "it adds"
    assert OpenAIClient("https://api.openai.com/v1", "m", send=answer({"output": [{"content": [{"text": "says"}]}]})).intent("code") == "says"
    assert sent[0][0] == "http://h:1/api/generate" and sent[0][1]["stream"] is False and sent[1][0].endswith("/v1/responses")
    for body in ({"response": "  "}, {"response": 3}, {}):
        with pytest.raises(IntentError):
            OllamaClient("http://h", "m", send=answer(body)).intent("x")
    assert normalized_provider(" OpenAI ") == normalized_provider("https://www.openai.com/x") == "https://api.openai.com/v1"
    assert normalized_provider("host:8/v/") == "https://host:8/v"
    for bad in ("", "  ", "https://"):
        with pytest.raises(ValueError):
            normalized_provider(bad)
    assert isinstance(chosen_client("http://localhost:11434", "m"), OllamaClient) and chosen_client("openai", "mine").model != "mine"
    assert parsed_scopes("") == ["class", "function", "method"] and parsed_scopes("method, all") == ["file", "class", "function", "method"]
    for bad in ("file", "all,nope"):
        with pytest.raises(ValueError):
            parsed_scopes(bad)


def built(spark, root):
    return built_records(split_symbols(tagged_symbols(read_files(python_paths(spark, str(root)))))[0])


def test_store(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/db")
    assert store.load(1).count() == 0 and store.runs().count() == 0
    records = built(spark, project(tmp_path / "src"))
    one, two = (store.persist(records, n, "src", "offline", "m", "all", 10) for n in (3, 0))
    assert (one["run_id"], one["status"], one["record_count"]) == (1, "completed_with_errors", 6)
    assert (two["run_id"], two["status"]) == (2, "completed")
    assert [r.record_id for r in store.records().orderBy("record_id").collect()] == list(range(1, 13))
    got = store.load(2).collect()
    assert [(r.record_id, r.kind) for r in got] == [(9, "method"), (12, "function")] and store.load(7).count() == 0
    # A run without its row in runs is not seen, and its number is used again.
    store.records().where("run_id = 1").drop("run_id").write.parquet(f"{tmp_path}/db/records/run_id=3")
    assert store.load(3).count() == 0 and store.records().count() == 12
    assert store.persist(records, 0, "src", "offline", "m", "all", 10)["run_id"] == 3 and store.records().count() == 18


def test_ignore_rules():
    rules = IgnoreRules(["# c", "", "*.log", "build/", "/top.txt", "!keep.log", "docs/*.md", "a/**/z", "**/cache", "[ab]?.tmp", "name\\ ", "\\#x"])
    hits = {"x.log", "d/x.log", "build/y", "d/build/y", "top.txt", "docs/a.md", "a/z", "a/b/c/z", "q/cache", "cache/x", "a1.tmp", "name ", "#x"}
    misses = {"keep.log", "d/keep.log", "build", "d/top.txt", "docs/b/a.md", "c1.tmp", "a12.tmp", "x"}
    assert {p for p in hits | misses if rules.matches(p, False)} == hits
    assert rules.matches("build", True) and not rules.matches("", True)
    assert [rebased(x, "p") for x in ("*.log", "/x", "!y", "# c", "", "\\!z", "!/k")] == ["p/*.log", "/p/x", "!p/y", "# c", "", "\\!z", "!/p/k"]
    nested = IgnoreRules([rebased("*.log", "pkg")])
    assert nested.matches("pkg/a.log", False) and not nested.matches("pkg/d/a.log", False)


def test_copy_project(tmp_path):
    src = tmp_path / "src"
    for d in (".git", "sub/.git", "skip/deep", "empty"):
        (src / d).mkdir(parents=True)
    for f in (".gitignore", "a.py", "skip/deep/b.py", "sub/c.log", "sub/.gitignore", "sub/d.py"):
        (src / f).write_text({"sub/.gitignore": "*.log\n", ".gitignore": "skip/\n"}.get(f, "x"))
    os.symlink("a.py", src / "link.py")
    done = copy_project(src, tmp_path / "out", IgnoreRules.below(src))
    assert (done.files_copied, done.dirs_created, done.paths_skipped_by_gitignore, done.paths_skipped_git_dir) == (5, 2, 2, 2)
    assert os.readlink(tmp_path / "out/link.py") == "a.py" and not (tmp_path / "out/skip").exists() and (tmp_path / "out/empty").is_dir()


def call(spark, *argv, client=lambda args: OfflineClient):
    out, err = io.StringIO(), io.StringIO()
    return cli.run([str(a) for a in argv], out, err, spark, client), out.getvalue(), err.getvalue()


def test_commands(spark, tmp_path):
    src = project(tmp_path / "src")
    (src / "twin.py").write_text("def f():\n    return 1\n")
    code, out, err = call(spark, "model-build", "--path", src, "--format=json")
    assert code == 0 and len(json.loads(out)["records"]) == 8 and err.count("analyzer_error: ") == 3
    code, out, _ = call(spark, "--path", src, "enrich-intent", "--provider-url", "x", "--model", "m", "--output", tmp_path / "o/t.txt")
    assert code == 0 and out == "" and "intent::" in (tmp_path / "o/t.txt").read_text()
    code, _, err = call(spark, "--path", src, "enrich-intent", "--provider-url", "x", "--model", "m", "--progress-batch-size", 2, client=lambda args: lambda: OfflineClient("class"))
    assert [x.split(" eta")[0] for x in err.splitlines() if x.startswith("progress")] == ["progress 2/4 percent=50.0 failed=1", "progress 4/4 percent=100.0 failed=1"]
    code, out, _ = call(spark, "persist", "--path", src, "--provider-url", "x", "--model", "m", "--db-path", tmp_path / "db")
    assert code == 0 and "run_id=1" in out and "status=completed_with_errors" in out
    code, out, _ = call(spark, "dup-check", "--db-path", tmp_path / "db", "--run-id", 1)
    assert code == 0 and "pairs=1 md5_overlap_pairs=1" in out and out.index("Exact") < out.index("intents") < out.index("Similar code") and "1.0000" in out
    assert call(spark, "dup-check", "--db-path", tmp_path / "db", "--run-id", 9)[:2] == (0, "No duplication findings for run_id=9\n")
    for argv in (
        ["model-build"],
        ["model-build", "--path", tmp_path / "nope"],
        ["model-build", "--path", src, "--analyzer-workers", 0],
        ["enrich-intent", "--path", src, "--provider-url", "x"],
        ["enrich-intent", "--path", src, "--provider-url", "x", "--model", "m", "--scope", "file"],
        ["persist", "--path", src, "--provider-url", "x", "--model", "m", "--db-path", tmp_path / "no/db"],
        ["dup-check", "--db-path", tmp_path / "nope", "--run-id", 1],
        ["dup-check", "--db-path", tmp_path / "db"],
        ["dup-check", "--db-path", tmp_path / "db", "--run-id", 1, "--intent-threshold", 1.5],
        ["dup-check", "--db-path", tmp_path / "db", "--run-id", 1, "--format", "json"],
        ["unknown"],
    ):
        assert call(spark, *argv)[0] == 2, argv


def test_ignore_rules_as_a_column(spark):
    rules = IgnoreRules(["*.log", "!keep.log", "/top", "a/**/z", "b[!x]?.c", "dir/", "\\#odd", "*.[ch]pp", "deep/**"])
    paths = ["x.log", "a/keep.log", "top", "x/top", "a/z", "a/b/c/z", "by1.c", "bx1.c", "dir/f", "x/dir/g/h", "dir", "#odd", "m.hpp", "m.xpp", "deep/f", "deep", "/x.log/", "", "é.log", "line\nbreak.log"]
    frame = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    got = {r.path: r.i for r in frame.select("path", rules.column(frame.path).alias("i")).collect()}
    assert got.pop(None) is False and got == {p: rules.matches(p, False) for p in paths}


def test_intermediates_need_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf())

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)


def test_lookups_skip_row_groups(spark, tmp_path):
    """Row groups are sorted by md5sum; a lookup reads few of them, by its bounds or its filter, and gives what a full scan does."""
    import pyarrow.parquet as pq

    store = RunStore(spark, str(tmp_path / "db"), row_group=64 << 10)
    code = F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 1).cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512))
    rows = spark.range(20_000).select(F.lit("function").alias("kind"), F.concat(F.lit("p/f"), F.xxhash64("id").cast("string"), F.lit(".py")).alias("file_path"), F.lit(None).cast("string").alias("signature"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), code.alias("raw_code"), code.alias("normalized_code"), F.md5(code).alias("md5sum"), F.lit(None).cast("string").alias("intent"), F.when(F.col("id") == 77, "failed").otherwise("skipped").alias("intent_status"), F.lit(None).cast("string").alias("intent_error"), F.lit(0).alias("seq"))
    run = store.persist(rows, 0, "/", "u", "m", "all", 10)["run_id"]
    bounds = []
    for file in Path(tmp_path / "db/records").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        place = meta.schema.to_arrow_schema().get_field_index("md5sum")
        bounds += [(meta.row_group(g).column(place).statistics.min, meta.row_group(g).column(place).statistics.max, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
    bounds.sort()
    assert len(bounds) > 20 and all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    one = rows.where("intent_status = 'failed'").first()
    for wanted in ({"md5sum": one.md5sum}, {"file_path": one.file_path}, {"intent_status": "failed"}):
        found = store.find(run, **wanted)
        assert [r.file_path for r in found.collect()] == [one.file_path]
        assert rows_scanned(found) <= 3 * max(n for _, _, n in bounds), wanted
    with pytest.raises(ValueError, match="no index"):
        store.find(run, kind="class")


def rows_scanned(frame):
    """Rows that the scan of record files gave to what stands above it."""
    frame.collect()
    plan, waiting, most = frame._jdf.queryExecution().executedPlan(), [], 0
    waiting.append(plan)
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            waiting.append(node.plan())
            continue
        if name.startswith("Scan parquet") and "file_path" in node.simpleString(1000):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.length())]
    assert most
    return most
