"""Rewriting sources under a rename map.

Names are changed in place in the syntax tree, which is then printed anew.  What an
attribute belongs to is guessed from what is known of the names in scope: a name is
the project's, external, or likely local.  The guess for a name is looked up innermost scope
first and is kept under its old and its new spelling, since a tree is visited children
first in most places.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import count
from typing import ClassVar
from unicodedata import normalize

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from echoloom.operators.symbols import ATTRIBUTE, CANDIDATE, CLASS, DYNAMIC_CALLS, EXTERNAL, PLAIN, alphabetic, base26, is_dunder, reserved_names
from echoloom.scratch import stored

#: A plain import as far as its statement may go; a bound on what a file imports, comments and strings included.
IMPORTS = r"\bimport\b([^\n\r;]*)"
SOME_FILES, LOOKED_AT, MOST_COMMON = 200, 20_000, 500  #: for names that recur: files and characters of each looked at, and the most names
WORD = re.compile(r"[^\W\d]\w*")
PROJECT, FOREIGN, LOCAL = "project", "external", "likely_local"
PASSING = ("enumerate", "sorted", "list", "tuple", "set", "reversed")
RESULT = "file_path string, transformed_source string, symbols_renamed int, likely_local_rewrites int, dynamic_name_rewrites int, unchanged boolean, error string"
SCOPED = {ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef}
LOOPS = {ast.For, ast.AsyncFor, ast.comprehension}
COMPREHENSIONS = {ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp}


class RewriteError(RuntimeError):
    """A source that cannot be parsed or printed."""


@dataclass
class _Free:
    """Alphabetic names without end, but for those that are taken."""

    taken: set[str]

    def __iter__(self) -> Iterator[str]:
        return (a for a in map(alphabetic, count()) if a not in self.taken)


@dataclass
class Names:
    """What the rewrite of a file needs to know of the project's names.

    ``old`` leads from new names back.  ``classes`` and ``attributes`` hold both spellings, ``own_classes`` and
    ``own_attributes`` the original one.  ``free`` are names for aliases, in order.
    """

    new: dict[str, str]
    old: dict[str, str]
    likely_local: set[str]
    external: set[str]
    own_classes: set[str]
    own_attributes: set[str]
    classes: set[str]
    attributes: set[str]
    free: Iterable[str]

    @classmethod
    def of_project(cls, new: dict[str, str], likely_local: set[str], facts: dict[str, set[str]]) -> Names:
        """From a whole rename map and index."""
        taken = facts[CANDIDATE] | facts[EXTERNAL] | set(new) | set(new.values()) | set(reserved_names())

        def both(names: set[str]) -> set[str]:
            return names | {new.get(x, x) for x in names}

        return cls(new, {v: k for k, v in new.items()}, likely_local, facts[EXTERNAL], facts[CLASS], facts[ATTRIBUTE], both(facts[CLASS]), both(facts[ATTRIBUTE]), _Free(taken))

    @classmethod
    def of_rows(cls, rows: list, free: Iterable[str]) -> Names:
        """From the rows of a symbol table for the names that a file holds."""
        new = {r["name"]: r["new_name"] for r in rows if r["new_name"] is not None}
        old = {r["name"]: r["old"] for r in rows if r["old"] is not None} | {v: k for k, v in new.items()}

        def those(flag: str) -> set[str]:
            return {r["name"] for r in rows if r[flag]}

        def both(flag: str) -> set[str]:
            return those(flag) | those(f"new_{flag}") | {new.get(x, x) for x in those(flag)}

        return cls(new, old, those("likely_local"), those(EXTERNAL), those(CLASS), those(ATTRIBUTE), both(CLASS), both(ATTRIBUTE), free)

    def with_rows(self, rows: list) -> Names:
        """What else the rows of a symbol table tell; these names and those have no row in common."""
        more = Names.of_rows(rows, self.free)
        sets = ("likely_local", "external", "own_classes", "own_attributes", "classes", "attributes")
        return replace(more, new=self.new | more.new, old=self.old | more.old, **{x: getattr(self, x) | getattr(more, x) for x in sets})

    def renamed(self, name: str) -> str | None:
        """The new name, if there is one that differs."""
        new = None if is_dunder(name) else self.new.get(name)
        return new if new != name else None

    def called(self, name: str) -> bool:
        return name in self.new or name in self.old


class _File:
    """One file's pass: aliases, scopes and counters."""

    AFTER: ClassVar[dict[type, Callable]] = {}  #: what looks at each type of node once its children are done

    def __init__(self, names: Names) -> None:
        self.names, self.scopes = names, [{}]
        self.aliases: dict[str, str] = {}
        self.foreign_aliases: set[str] = set()
        self.free = iter(names.free)
        self.renamed = self.local = self.dynamic = 0

    # What a name or an expression belongs to.

    def known(self, name: str) -> str | None:
        return next((s[name] for s in reversed(self.scopes) if name in s), None)

    def learn(self, name: str, owner: str) -> None:
        spellings = {name, self.names.old.get(name)} | ({self.names.new.get(name)} if not is_dunder(name) else set())
        self.scopes[-1].update(dict.fromkeys(spellings - {None}, owner))

    def is_foreign(self, name: str) -> bool:
        return name in self.names.external or name in self.foreign_aliases

    def owner(self, base: ast.expr) -> str:
        """Of the base of an attribute."""
        if not isinstance(base, ast.Name):
            return LOCAL
        name = base.id
        if (told := self.known(name)) is not None:
            return told
        if name in self.names.likely_local:
            return LOCAL
        if not self.is_foreign(name) and (name in self.aliases.values() or name == "self"):
            return PROJECT
        return FOREIGN

    def of_value(self, value: ast.expr) -> str | None:
        names = self.names
        match value:
            case ast.Name(id=name):
                return self.known(name) or (LOCAL if name in names.likely_local else None)
            case ast.Call(func=ast.Name(id=name), args=args):
                if self.is_foreign(name):
                    return FOREIGN
                if name in PASSING:
                    return self.of_items(args[0]) if args else None
                return PROJECT if name in names.classes else LOCAL if names.called(name) else None
            case ast.Call(func=ast.Attribute(value=base, attr=name)):
                owner = self.owner(base)
                if owner == FOREIGN or name in names.classes:
                    return FOREIGN if owner == FOREIGN else PROJECT
                return LOCAL if name in names.attributes else None
        return None

    def of_items(self, items: ast.expr) -> str | None:
        match items:
            case ast.Name(id=name):
                return self.known(name)
            case ast.Call():
                return self.of_value(items)
            case ast.Subscript(value=inner):
                return self.of_items(inner)
            case ast.Attribute(value=base, attr=name):
                owner = self.owner(base)
                return LOCAL if owner != FOREIGN and (name in self.names.attributes or name in self.names.classes) else owner
        return None

    def of_annotation(self, annotation: ast.expr) -> str | None:
        said = {n.id for n in ast.walk(annotation) if isinstance(n, ast.Name)}
        return None if not said else PROJECT if said & self.names.classes else FOREIGN

    def spread(self, target: ast.expr, owner: str | None) -> None:
        """To the names of a target, inside tuples and lists too."""
        if owner is None:
            return
        if isinstance(target, ast.Name):
            self.learn(target.id, owner)
        elif isinstance(target, ast.Tuple | ast.List):
            for element in target.elts:
                self.spread(element, owner)

    def seed(self, given: ast.arguments) -> None:
        for arg in (*given.posonlyargs, *given.args, given.vararg, *given.kwonlyargs, given.kwarg):
            if arg is None:
                continue
            owner = PROJECT if arg.arg in ("self", "cls") else LOCAL if arg.annotation is None else self.of_annotation(arg.annotation)
            if owner is not None:
                self.learn(arg.arg, owner)

    # The walk.

    def walk(self, node: ast.AST) -> None:
        """Before a node's children, its scope and loop targets; after them, its own names."""
        kind = type(node)
        if kind is ast.Import:
            self.imported(node)
            return
        scoped = kind in SCOPED
        if scoped:
            self.scopes.append({})
            if kind is not ast.ClassDef:
                self.seed(node.args)
        elif kind in LOOPS:
            self.spread(node.target, self.of_items(node.iter))
        elif kind in COMPREHENSIONS:
            for clause in node.generators:
                self.spread(clause.target, self.of_items(clause.iter))
        for field in kind._fields:
            if field in PLAIN:
                continue
            value = getattr(node, field, None)
            for child in value if isinstance(value, list) else (value,):
                if isinstance(child, ast.AST):
                    self.walk(child)
        if scoped:
            self.scopes.pop()
        if after := self.AFTER.get(kind):
            after(self, node)

    def counted(self, name: str) -> str | None:
        """The new name of ``name``, counted, if it has one."""
        new = self.names.renamed(name)
        self.renamed += new is not None
        return new

    def imported(self, node: ast.Import) -> None:
        """Plain imports are given an alias, the same wherever they recur in the file."""
        for name in node.names:
            if name.asname is not None or "." in name.name:
                continue
            if name.name not in self.aliases:
                self.aliases[name.name] = next(self.free)
            name.asname = self.aliases[name.name]
            if name.name in self.names.external:
                self.foreign_aliases.add(name.asname)
            self.renamed += 1

    def after_alias(self, node: ast.alias) -> None:
        if "." not in node.name:
            node.name = self.counted(node.name) or node.name

    def after_arg(self, node: ast.arg) -> None:
        node.arg = self.counted(node.arg) or node.arg

    def after_ClassDef(self, node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        if new := self.counted(node.name):
            node.name, node.type_params = new, []  # renamed definitions lose their type parameters

    after_FunctionDef = after_AsyncFunctionDef = after_ClassDef

    def after_Name(self, node: ast.Name) -> None:
        if node.id in self.aliases:
            new = self.aliases[node.id]
        elif node.id in self.names.external:
            return
        else:
            new = self.names.renamed(node.id)
        if new is not None and new != node.id:
            node.id = new
            self.renamed += 1

    def changed_owner(self, base: ast.expr) -> bool:
        """Whether an attribute of this base may be renamed; counts guesses."""
        owner = self.owner(base)
        self.local += owner == LOCAL
        return owner != FOREIGN

    def after_Attribute(self, node: ast.Attribute) -> None:
        names = self.names
        if (node.attr in names.own_attributes or node.attr in names.own_classes) and self.names.renamed(node.attr) and self.changed_owner(node.value):
            node.attr = self.counted(node.attr) or node.attr

    def takes_keywords(self, func: ast.expr) -> bool:
        names = self.names
        match func:
            case ast.Name(id=name):
                return not self.is_foreign(name) and (name in names.classes or names.called(name))
            case ast.Attribute(attr=name):
                return name in names.attributes or name in names.classes
        return False

    def after_Call(self, node: ast.Call) -> None:
        if self.takes_keywords(node.func):
            before = self.renamed
            for keyword in node.keywords:
                if keyword.arg is not None:
                    keyword.arg = self.counted(keyword.arg) or keyword.arg
            self.local += self.renamed > before
        match node:
            case ast.Call(func=ast.Name(id=called), args=[base, ast.Constant(value=str(name)), *_]) if called in DYNAMIC_CALLS:
                new = self.names.renamed(name)
                if new and name in self.names.own_attributes and self.changed_owner(base):
                    node.args[1] = ast.Constant(new)
                    self.renamed += 1
                    self.dynamic += 1

    def after_Assign(self, node: ast.Assign) -> None:
        owner = self.of_value(node.value)
        for target in node.targets:
            if owner is not None and isinstance(target, ast.Name):
                self.learn(target.id, owner)

    def after_AnnAssign(self, node: ast.AnnAssign) -> None:
        owner = (self.of_value(node.value) if node.value is not None else None) or self.of_annotation(node.annotation)
        if owner is not None and isinstance(node.target, ast.Name):
            self.learn(node.target.id, owner)


_File.AFTER = {getattr(ast, name[6:]): look for name, look in vars(_File).items() if name.startswith("after_")}


def rewritten(source: str, names: Names) -> tuple[str, int, int, int]:
    """(new source, symbols renamed, likely-local rewrites, dynamic rewrites)."""
    try:
        tree, file = ast.parse(source), _File(names)
        file.walk(tree)
        return ast.unparse(tree) + "\n", file.renamed, file.local, file.dynamic
    except (SyntaxError, ValueError) as fault:
        raise RewriteError(str(fault)) from fault
    except (RecursionError, MemoryError) as fault:  # the parser gives up with the latter
        raise RewriteError(f"nested too deeply: {fault}") from fault


def symbol_table(index: DataFrame, mapped: DataFrame) -> DataFrame:
    """A row for each name that the index or the rename map knows, by either spelling.

    All sides grow with the project: they are merged, never gathered in the driver for a broadcast.
    """
    flags = index.groupBy("name").agg(*[F.max(F.col("category") == c).alias(c) for c in (EXTERNAL, CLASS, ATTRIBUTE)])
    known = flags.join(mapped.withColumnRenamed("symbol", "name").hint("merge"), "name", "full_outer")
    back = known.where("new_name IS NOT NULL").select(F.col("new_name").alias("name"), F.col("name").alias("old"), F.col(CLASS).alias(f"new_{CLASS}"), F.col(ATTRIBUTE).alias(f"new_{ATTRIBUTE}"))
    return known.join(back.hint("merge"), "name", "full_outer")


def most_imports(files: DataFrame) -> int:
    """At least as many as the plain imports of any one file: names after ``import``, up to the end of its logical line."""
    joined = F.regexp_replace(F.coalesce("content", F.lit("")), r"\\\r?\n|\\\r", " ")
    commas = F.transform(F.regexp_extract_all(joined, F.lit(IMPORTS), F.lit(1)), lambda x: F.length(x) - F.length(F.replace(x, F.lit(","))) + 1)
    return files.agg(F.max(F.aggregate(commas, F.lit(0), lambda a, x: a + x))).first()[0] or 0


def free_aliases(index: DataFrame, mapped: DataFrame, most: int) -> list[str]:
    """The first ``most`` names that nothing in the project or in Python has, in order: what the file with most imports needs."""
    spark = index.sparkSession
    used = index.where(F.col("category").isin(CANDIDATE, EXTERNAL)).select("name").unionByName(mapped.select(F.explode(F.array("symbol", "new_name")).alias("name")))
    taken = stored(used.unionByName(spark.createDataFrame([(x,) for x in reserved_names()], "name string")).distinct(), "taken")
    free = spark.range(taken.count() + most).select("id", base26(F.col("id")).alias("name")).join(taken.hint("merge"), "name", "left_anti")
    return [r.name for r in free.orderBy("id").limit(most).collect()]


def _words(text: str) -> set[str]:
    """The words of a file, also as the parser spells them."""
    return {*WORD.findall(text), *(() if text.isascii() else WORD.findall(normalize("NFKC", text)))}


def common_words(files: DataFrame) -> set[str]:
    """Words that are in many of a few files; any set would do, as it only says which names go to tasks once, not with every file."""
    some = [r[0] for r in files.where("content IS NOT NULL").select(F.substring("content", 1, LOOKED_AT)).limit(SOME_FILES).collect()]
    found = Counter(w for text in some for w in _words(text))
    return {w for w, n in found.most_common(MOST_COMMON) if n > max(1, len(some) // 20)}


def rows_of(index: DataFrame, mapped: DataFrame, words: set[str]) -> list:
    """The rows of :func:`symbol_table` for a few names."""
    told = mapped.where(F.col("symbol").isin(words) | F.col("new_name").isin(words))
    names = words | {r[0] for r in told.select("symbol").collect()}
    return symbol_table(index.where(F.col("name").isin(names)), told).where(F.col("name").isin(words)).collect()


def rewrite_files(files: DataFrame, index: DataFrame, mapped: DataFrame) -> DataFrame:
    """A row for each file of (file_path, content): its new source and counters, or an error.

    A file is sent what the project knows of the names in it, and no more, so neither the
    driver nor any task holds the whole rename map; at most MOST_COMMON names that recur in file after file are told to every task instead.
    The list of free aliases is as long as the file with most imports.  ``file_path`` is unique.
    """
    context = files.sparkSession.sparkContext
    free = context.broadcast(free_aliases(index, mapped, most_imports(files)))
    table = symbol_table(index, mapped)
    usual = common_words(files)
    common = context.broadcast((usual, rows_of(index, mapped, usual)))

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = common.value[0]
        for frame in frames:
            found = [(path, w) for path, text in zip(frame["file_path"], frame["content"], strict=True) if text is not None for w in _words(text) - told]
            yield pd.DataFrame(found, columns=["file_path", "name"], dtype=object)

    known = files.select("file_path", "content").mapInPandas(held, "file_path string, name string").join(table.hint("merge"), "name")
    known = known.groupBy("file_path").agg(F.collect_list(F.struct(*table.columns)).alias("known"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project = Names.of_rows(common.value[1], free.value)
        for frame in frames:
            rows: list[tuple] = []
            for path, content, told in zip(frame["file_path"], frame["content"], frame["known"], strict=True):
                try:
                    if content is None:
                        raise RewriteError("no content")
                    new, renamed, local, dynamic = rewritten(content, project if told is None else project.with_rows(list(told)))
                    rows.append((path, new, renamed, local, dynamic, new == content, None))
                except RewriteError as fault:
                    rows.append((path, None, 0, 0, 0, None, str(fault)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")], dtype=object)

    return files.select("file_path", "content").join(known.hint("merge"), "file_path", "left").mapInPandas(scan, RESULT)
