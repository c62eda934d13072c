"""Symbol index, rename map and rewriting."""

import io

import pytest
from pyspark.sql import functions as F

from echoloom import cli
from echoloom.operators import rewrite
from echoloom.operators.extract import split_symbols, tagged_symbols
from echoloom.operators.rewrite import Names, RewriteError, most_imports, rewrite_files, rewritten
from echoloom.operators.symbols import alphabetic, base26, facts_of, module_roots, project_index, rename_map, reserved_names, symbol_rows

NONE = {"candidate": set(), "external": set(), "class": set(), "attribute": set(), "dynamic": set()}


def names(new, local=(), **facts):
    return Names.of_project(new, set(local), NONE | {k.rstrip("_"): set(v) for k, v in facts.items()})


def test_facts():
    got = facts_of(
        "import os.path, mine.sub as ms, re as rx\nfrom mine import a as b\nfrom . import dot\nfrom typing import Any\n"
        "class K:\n    x: int = 1\n    def m(self, p, *q, r=1, **s):\n        t = 2\n        self.u = t\n        self.v, w = 1, 2\n        getattr(o, 'm'); getattr(self, 'm'); setattr(rx, 'm', 1); hasattr(o, 'later')\n    def __init__(self): pass\n    def later(self): pass\n"
        "async def g(): pass\nfor i in []: pass\n",
        {"mine"},
    )
    assert got["external"] == {"os", "rx", "Any"}
    assert got["class"] == {"K"}
    assert got["attribute"] == {"x", "m", "t", "u", "later"}
    assert got["dynamic"] == {"m"}
    assert got["candidate"] == {"b", "K", "x", "m", "self", "p", "q", "r", "s", "t", "w", "later", "g", "i"}


def test_roots(spark):
    paths = ["a.py", "pkg/m.py", "src/core/x.py", "tests/t.py", "__init__.py", "src/__init__.py", "deep/er/__init__.py"]
    got = {r.name for r in module_roots(spark.createDataFrame([(p,) for p in paths], "file_path string")).collect()}
    assert got == {"a", "pkg", "src", "core", "tests", "t", "deep"}


def test_map(spark):
    files = [("m/a.py", "import os\ndef run(os2): pass\nclass Zed:\n    def keep(self): getattr(o, 'keep')\n"), ("m/b.py", "from x import shared\n"), ("m/c.py", "shared = 1\na = 2\n"), ("m/d.py", "def (")]
    frame = spark.createDataFrame(files, "file_path string, content string")
    index = project_index(symbol_rows(frame, ["m"]))
    got = {r.symbol: (r.new_name, r.likely_local) for r in rename_map(index).collect()}
    # a is itself a target, so it is not free; external names are never mapped.
    assert got == {"Zed": ("b", False), "a": ("c", False), "keep": ("d", True), "os2": ("e", False), "run": ("f", False), "self": ("g", False)}
    numbers = [0, 1, 25, 26, 27, 701, 702, 18277, 18278, 10**12]
    frame = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [r[0] for r in frame.select(base26(frame.n)).collect()] == [alphabetic(n) for n in numbers]
    assert alphabetic(26) == "aa" and "as" in reserved_names() and "len" in reserved_names()


def test_names_imports_and_aliases():
    n = names({"load": "c", "mod": "d"}, external=["os", "load2"], candidate=["a"])
    text, renamed, _, _ = rewritten("import os, json as j, x.y\nimport os\nfrom mod import load as l\nfrom mod import load2\nload(os.path)\n", n)
    # a is taken by a candidate and c, d by the map, so the alias is b.
    assert text == "import os as b, json as j, x.y\nimport os as b\nfrom mod import c as l\nfrom mod import load2\nc(b.path)\n"
    assert renamed == 5


def test_attributes_follow_owners():
    n = names({"size": "s", "Box": "B", "make": "m", "box": "x", "other": "o"}, class_=["Box"], attribute=["size"], external=["np"])
    text, _, local, _ = rewritten(
        "box = Box()\nbox.size\nnp.size\nunknown.size\ndef make(other, box: Box, q: np.T):\n    other.size\n    box.size\n    q.size\n    return make().size\nfor e in np.all():\n    e.size\nz = [i.size for i in make(1)]\nself.size\n", n
    )
    assert text == (
        "x = B()\nx.s\nnp.size\nunknown.size\n\ndef m(o, x: B, q: np.T):\n    o.s\n    x.s\n    q.size\n    return m().s\nfor e in np.all():\n    e.size\nz = [i.s for i in m(1)]\nself.s\n"
    )
    assert local == 3


def test_keywords_and_dynamic_names():
    n = names({"run": "r", "speed": "p", "go": "g"}, ["go"], attribute=["speed", "go"], external=["ext"])
    text, renamed, local, dynamic = rewritten("run(speed=1, other=2, **k)\next(speed=1)\ngetattr(self, 'speed')\nsetattr(ext, 'speed', 1)\nhasattr(go, 'go')\nx = 'speed'\ny = f'{run}'\n", n)
    # The owner go is renamed before it is looked up, so nothing is known of it any more.
    assert text == "r(p=1, other=2, **k)\next(speed=1)\ngetattr(self, 'p')\nsetattr(ext, 'speed', 1)\nhasattr(g, 'go')\nx = 'speed'\ny = f'{r}'\n"
    assert (renamed, local, dynamic) == (5, 1, 1)


def test_definitions():
    n = names({"f": "a", "C": "b", "T": "t", "p": "q"}, class_=["C"])
    text, *_ = rewritten("class C[T](Base):\n    def __init__(self): pass\ndef f[T](p, /, *, k=1) -> C: return lambda p: p\nasync def h[T](): pass\n", n)
    assert text == "class b(Base):\n\n    def __init__(self):\n        pass\n\ndef a(q, /, *, k=1) -> b:\n    return lambda q: q\n\nasync def h[T]():\n    pass\n"
    assert rewritten("x = 1\n", n)[0] == "x = 1\n"
    with pytest.raises(RewriteError):
        rewritten("def (", n)


def test_files_get_what_they_hold(spark):
    """The names sent to a file lead to the same rewrite as the whole map."""
    texts = {
        "m/a.py": "import os\nfrom m.b import Zed, helper\nclass Own(Zed):\n    size = 1\n    def act(self, other: Zed, *rest):\n        self.grown = other.size + helper(size=2)\n        return getattr(other, 'act')\n",
        "m/b.py": "import re, os\nclass Zed:\n    size: int = 0\n    def act(self): return [z.size for z in sorted(self.all())]\n    def all(self): return [Own()]\ndef helper(size): return size\na = helper(size=a)\nb = Zed()\nb.size = b.act()\n",
        "m/c.py": "ﬁeld = 1\nfield\nprint(field)\n",
        "m/d.py": "def (",
        "m/e.py": "",
    }
    files = spark.createDataFrame(list(texts.items()), "file_path string, content string")
    index = project_index(symbol_rows(files, ["m"]))
    mapped = rename_map(index)
    facts = {c: {r.name for r in index.where(index.category == c).collect()} for c in NONE}
    rows = mapped.collect()
    whole = Names.of_project({r.symbol: r.new_name for r in rows}, {r.symbol for r in rows if r.likely_local}, facts)
    for r in rewrite_files(files, index, mapped).collect():
        if r.file_path == "m/d.py":
            assert r.error and r.transformed_source is None
        else:
            assert (r.transformed_source, r.symbols_renamed, r.likely_local_rewrites, r.dynamic_name_rewrites) == rewritten(texts[r.file_path], whole)
            assert r.unchanged == (r.transformed_source == texts[r.file_path])


def test_names_that_recur_go_to_tasks_once(spark, monkeypatch):
    """The same rewrite whether names are sent with each file or, if they are in many files, told to every task."""
    files = spark.createDataFrame([(f"m/f{i}.py", f"import os\nclass Own{i}:\n    def size(self, other):\n        return other.size + a(size={i})\na = Own{i}()\n") for i in range(30)], "file_path string, content string")
    index = project_index(symbol_rows(files, ["m"]))
    mapped = rename_map(index)
    usual = rewrite.common_words(files)
    assert {"os", "size", "self", "other", "a"} <= usual and not any(x.startswith("Own") for x in usual)
    assert {r["name"] for r in rewrite.rows_of(index, mapped, usual)} >= {"os", "size", "self", "other", "a"}
    told = sorted(map(tuple, rewrite_files(files, index, mapped).collect()))
    monkeypatch.setattr(rewrite, "MOST_COMMON", 0)
    assert rewrite.common_words(files) == set() and sorted(map(tuple, rewrite_files(files, index, mapped).collect())) == told


def test_names_of_very_large_numbers(spark):
    """Numbers beyond 2**53 are not rounded."""
    numbers = [0, 25, 26, 701, 702, 2**53 + 1, 2**62 + 12345, 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", base26(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: alphabetic(n) for n in numbers}


def test_obfuscate_command(spark, tmp_path):
    src = tmp_path / "in"
    (src / "pkg").mkdir(parents=True)
    (src / ".gitignore").write_text("*.log\n")
    (src / "x.log").write_text("")
    (src / "pkg/one.py").write_text("class Shared:\n    def act(self):\n        return 1\n")
    (src / "pkg/two.py").write_text("from pkg.one import Shared\nvalue = Shared()\nvalue.act()\n")
    (src / "plain.py").write_text("print(1)\n")
    out, err = io.StringIO(), io.StringIO()
    assert cli.run(["obfuscate", "--input", str(src), "--output", str(tmp_path / "out")], out, err, spark) == 0, err.getvalue()
    said = out.getvalue().splitlines()
    assert said[0] == "validation:start" and said[-1] == "status=success" and "python_files_discovered=3" in said[-2] and "python_files_unchanged=1" in said[-2]
    one, two = ((tmp_path / "out/pkg" / f).read_text() for f in ("one.py", "two.py"))
    cls, act = one.split("class ")[1].split(":")[0], one.split("def ")[1].split("(")[0]
    assert f"import {cls}" in two and f".{act}()" in two and "Shared" not in one + two and not (tmp_path / "out/x.log").exists()
    (src / "bad.py").write_text("def (\n")
    for argv in (["--input", tmp_path / "no"], ["--input", src, "--output", src / "sub"], ["--input", src, "--output", tmp_path / "out"], ["--input", src, "--output", tmp_path / "out2"]):
        argv = [str(a) for a in argv] + ([] if "--output" in argv else ["--output", str(tmp_path / "o3")])
        assert cli.run(["obfuscate", *argv], io.StringIO(), err, spark) == 2
    assert "Transform failed: bad.py" in err.getvalue()


def test_deep_sources_are_error_rows(spark):
    """Trees too deep to walk or parse fail alone, in every operator on sources."""
    deep = [("m/sum.py", "x = " + "+".join(["1"] * 5000) + "\n"), ("m/minus.py", "x = " + "-" * 20_000 + "1\n"), ("m/ok.py", "def f(): pass\n"), ("m/calls.py", "x = " + "f(" * 90 + ")" * 90 + "\n")]
    frame = spark.createDataFrame(deep, "file_path string, content string")
    index = project_index(symbol_rows(frame, ["m"]))
    assert {"f"} <= {r.name for r in index.collect()}
    done = {r.file_path: r for r in rewrite_files(frame, index, rename_map(index)).collect()}
    assert [done[p].error is None for p in ("m/sum.py", "m/minus.py", "m/ok.py", "m/calls.py")] == [False, False, True, True]
    symbols, errors = split_symbols(tagged_symbols(frame))
    assert {r.file_path for r in errors.collect()} >= {"m/minus.py"} and {r.file_path for r in symbols.collect()} >= {"m/ok.py", "m/calls.py"}


def test_any_number_of_imports(spark):
    """Each plain import gets the next base-26 name that the project has not; names in use are skipped."""
    many = "\n".join(f"import m{i}, n{i}" + (f", \\\n  o{i}; import p{i} as q{i}" if i % 7 == 0 else "") for i in range(2500))
    files = [("a.py", many + "\nm3.x, p0\n"), ("b.py", "import m3\nb = aa = zz = abc = 1\n"), ("c.py", None), ("d.py", "")]
    frame = spark.createDataFrame(files, "file_path string, content string")
    index = project_index(symbol_rows(frame, []))
    mapped = rename_map(index)
    facts = NONE | {}
    for r in index.collect():
        facts = facts | {r.category: facts[r.category] | {r.name}}
    plain = Names.of_project({r.symbol: r.new_name for r in mapped.collect()}, set(), facts)
    got = {r.file_path: r for r in rewrite_files(frame, index, mapped).collect()}
    assert most_imports(frame) >= 5000 + 358 and got["a.py"].error is None and got["c.py"].error == "no content"
    for path, content in files:
        if content is not None:
            assert got[path].transformed_source == rewritten(content, plain)[0]
    taken = facts["candidate"] | facts["external"] | {x for r in mapped.collect() for x in (r.symbol, r.new_name)} | set(reserved_names())
    order = [x for x in map(alphabetic, range(20_000)) if x not in taken]
    assert got["b.py"].transformed_source.startswith(f"import m3 as {order[0]}\n") and {"b", "aa", "zz", "abc"} & set(order) == set()
    assert f"import m2499 as {order[5355]}, n2499 as {order[5356]}, o2499 as {order[5357]}" in got["a.py"].transformed_source
