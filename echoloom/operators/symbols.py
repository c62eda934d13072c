"""The symbol index of a project and its rename map.

Each file gives rows (category, name); everything after that is set algebra on frames.
"""

from __future__ import annotations

import ast
import builtins
import keyword
from collections.abc import Callable, Iterator
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from echoloom.operators.ranking import numbered
from echoloom.scratch import stored

CANDIDATE, EXTERNAL, CLASS, ATTRIBUTE, DYNAMIC = "candidate", "external", "class", "attribute", "dynamic"
DYNAMIC_CALLS = ("getattr", "setattr", "hasattr")
PLAIN = {"arg", "attr", "ctx", "id", "kind", "op", "ops", "type_comment"}  #: fields of a syntax tree without names below them
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def is_dunder(name: str) -> bool:
    return name.startswith("__") and name.endswith("__")


def renameable(name: str) -> bool:
    return name.isidentifier() and not is_dunder(name)


def module_roots(paths: DataFrame) -> DataFrame:
    """Names under which the project's own modules are imported, of (file_path)."""
    stem = F.regexp_replace("file_path", r"\.py$", "")
    parts = F.split(stem, "/")
    first = F.get(parts, F.lit(0))
    second = F.when(first.isin("src", "tests"), F.get(parts, F.lit(1)))
    roots = paths.select(F.explode(F.array(first, second)).alias("name"))
    return roots.where(F.col("name").isNotNull() & (F.col("name") != "") & (F.col("name") != "__init__")).distinct()


class _Index:
    """Facts of one module in the order of a full walk of its tree."""

    ON: ClassVar[dict[type, Callable]] = {}  #: what looks at each type of node

    def __init__(self, roots: set[str]) -> None:
        self.roots, self.facts, self.in_class = roots, {c: set() for c in (CANDIDATE, EXTERNAL, CLASS, ATTRIBUTE, DYNAMIC)}, False

    def candidate(self, name: str) -> None:
        if renameable(name):
            self.facts[CANDIDATE].add(name)

    def attribute(self, name: str) -> None:
        if not is_dunder(name):
            self.facts[ATTRIBUTE].add(name)

    def walk(self, node: ast.AST) -> None:
        kind = type(node)
        if look := self.ON.get(kind):
            look(self, node)
        outer = self.in_class
        self.in_class = outer or kind is ast.ClassDef  # methods do not end it
        for field in kind._fields:
            if field in PLAIN:
                continue
            value = getattr(node, field, None)
            for child in value if isinstance(value, list) else (value,):
                if isinstance(child, ast.AST):
                    self.walk(child)
        self.in_class = outer

    def on_Import(self, node: ast.Import) -> None:
        for name in node.names:
            root = name.name.split(".")[0]
            if root not in self.roots:
                self.facts[EXTERNAL].add(name.asname or root)

    def on_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module is None:
            return
        own = node.module.split(".")[0] in self.roots
        for name in node.names:
            shown = name.asname or name.name
            if name.name == "*":
                continue
            if own:
                self.candidate(shown)
            else:
                self.facts[EXTERNAL].add(shown)

    def on_ClassDef(self, node: ast.ClassDef) -> None:
        self.facts[CLASS].add(node.name)
        self.candidate(node.name)

    def on_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.candidate(node.name)
        if self.in_class:
            self.attribute(node.name)
        given = node.args
        for arg in (*given.posonlyargs, *given.args, *given.kwonlyargs, given.vararg, given.kwarg):
            if arg is not None:
                self.candidate(arg.arg)

    on_AsyncFunctionDef = on_FunctionDef

    def on_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Store):
            self.candidate(node.id)

    def _target(self, target: ast.expr) -> None:
        match target:
            case ast.Attribute(value=ast.Name(id="self"), attr=name):
                self.attribute(name)
            case ast.Name(id=name):
                if self.in_class:
                    self.attribute(name)
                self.candidate(name)

    def on_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            self._target(target)

    def on_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._target(node.target)

    def on_Call(self, node: ast.Call) -> None:
        match node:
            case ast.Call(func=ast.Name(id=called), args=[ast.Name(id=owner), ast.Constant(value=str(name)), *_]) if called in DYNAMIC_CALLS:
                if name in self.facts[ATTRIBUTE] and owner != "self" and owner not in self.facts[EXTERNAL]:
                    self.facts[DYNAMIC].add(name)


_Index.ON = {getattr(ast, name[3:]): look for name, look in vars(_Index).items() if name.startswith("on_")}


def facts_of(source: str, roots: set[str]) -> dict[str, set[str]]:
    index = _Index(roots)
    index.walk(ast.parse(source))
    return index.facts


def symbol_rows(files: DataFrame, roots: list[str]) -> DataFrame:
    """(file_path, category, name) for every file of (file_path, content); files that do not parse, or nest too deeply, give none.

    ``roots`` are the project's module roots, a name for each top-level module.
    """
    own = set(roots)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple[str, str, str]] = []
            for path, content in zip(frame["file_path"], frame["content"], strict=True):
                try:
                    facts = facts_of(content, own) if content is not None else {}
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                rows += [(path, category, name) for category, names in facts.items() for name in sorted(names)]
            yield pd.DataFrame(rows, columns=["file_path", "category", "name"], dtype=object)

    return files.select("file_path", "content").mapInPandas(scan, "file_path string, category string, name string")


def project_index(rows: DataFrame) -> DataFrame:
    """(category, name) of the whole project; a name that is external anywhere is no candidate.

    One aggregate by name, of at most five categories each, so that the files behind ``rows`` are parsed once.
    """
    every = rows.groupBy("name").agg(F.collect_set("category").alias("told"))
    kept = F.when(F.array_contains("told", EXTERNAL), F.array_remove("told", CANDIDATE)).otherwise(F.col("told"))
    return every.select(F.explode(kept).alias("category"), "name")


def base26(number: Column) -> Column:
    """0 is a, 25 is z, 26 is aa."""
    n = number.cast("long")
    letters, first = [], 0  # the first number that has so many letters
    for place in range(14):  # these cover all longs
        value = F.call_function("div", n - first, F.lit(26**place)) % 26
        letters.insert(0, F.when(n >= first, F.char(F.lit(97) + value)).otherwise(""))
        first += 26 ** (place + 1)
    return F.when(n.isNotNull(), F.concat(*letters))


def alphabetic(number: int) -> str:
    out = ""
    while number >= 0:
        out, number = LETTERS[number % 26] + out, number // 26 - 1
    return out


def reserved_names() -> list[str]:
    """Keywords and builtins of the running Python."""
    return sorted({*keyword.kwlist, *dir(builtins)})


def _targets(index: DataFrame) -> DataFrame:
    """(name, likely_local) of the names to rename, of one aggregate by name."""
    name, category = F.col("name"), F.col("category")
    told = index.groupBy("name").agg(F.max(category.isin(CANDIDATE, ATTRIBUTE)).alias("wanted"), F.max(category == EXTERNAL).alias("external"), F.max(category == DYNAMIC).alias("likely_local"))
    may = ~(name.startswith("__") & name.endswith("__")) & name.rlike(r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}\p{Pc}]*$")
    return told.where(F.col("wanted") & ~F.col("external") & may).select("name", "likely_local")


def rename_targets(index: DataFrame) -> DataFrame:
    """M1: candidates and attributes that are no external names and may be renamed."""
    return _targets(index).select("name")


def rename_map(index: DataFrame) -> DataFrame:
    """M2-M4: (symbol, new_name, likely_local): the i-th target gets the i-th name that is not taken.

    Both sides of the joins grow with the project, so they are merged and never gathered in the driver for a broadcast.
    """
    spark = index.sparkSession
    targets = stored(_targets(index), "rename-targets")
    taken = targets.select("name").unionByName(index.where(F.col("category") == EXTERNAL).select("name")).unionByName(spark.createDataFrame([(x,) for x in reserved_names()], "name string")).distinct()
    count, blocked = targets.count(), taken.count()
    free = spark.range(count + blocked).select("id", base26(F.col("id")).alias("name")).join(taken.hint("merge"), "name", "left_anti")
    names = numbered(free, "id").select("number", F.col("name").alias("new_name"))
    return numbered(targets.withColumnRenamed("name", "symbol"), "symbol").join(names.hint("merge"), "number").select("symbol", "new_name", "likely_local")
