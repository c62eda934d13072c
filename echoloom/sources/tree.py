"""Source trees: listing, filtered copies and rewritten files.

Spark's file sources skip names that begin with ``_`` or ``.``, so paths are listed by
the driver and read by the executors, which must see the same file system.
"""

from __future__ import annotations

import os
import re
import shutil
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PATHS = "root string, file_path string"
FILES = "file_path string, content string, error string"


def python_paths(spark: SparkSession, root: str, partitions: int = 4, suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
    """A1: every ``*.py`` (or other suffix) below ``root``, hidden and private ones too, as (root, file_path)."""
    if partitions <= 0:
        raise ValueError("partitions must be > 0")
    base = Path(root)
    found = sorted(p.relative_to(base).as_posix() for suffix in suffixes for p in base.rglob(f"*{suffix}"))
    return spark.createDataFrame([(str(base), p) for p in found], PATHS).repartition(partitions, "file_path")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for root, path in zip(frame["root"], frame["file_path"], strict=True):
            try:
                rows.append((path, (Path(root) / path).read_text(encoding="utf-8"), None))
            except (OSError, UnicodeDecodeError) as fault:
                rows.append((path, None, str(fault)))
        yield pd.DataFrame(rows, columns=["file_path", "content", "error"], dtype=object)


def read_files(paths: DataFrame) -> DataFrame:
    """Contents as UTF-8 text; a file that cannot be read has an error instead."""
    return paths.mapInPandas(_read, FILES)


class IgnoreRules:
    """Rules of ignore files; the last rule that matches decides."""

    def __init__(self, lines: Iterable[str]) -> None:
        self.rules = [r for r in map(compiled_rule, lines) if r]

    @classmethod
    def below(cls, root: Path) -> IgnoreRules:
        lines: list[str] = []
        for file in sorted(root.rglob(".gitignore")):
            folder = file.parent.relative_to(root).as_posix()
            lines += [rebased(x, "" if folder == "." else folder) for x in file.read_text(encoding="utf-8").splitlines()]
        return cls(lines)

    def _decided(self, path: str) -> bool:
        for pattern, ignores in reversed(self.rules):
            if pattern.match(path):
                return ignores
        return False

    def column(self, path: Column) -> Column:
        """Whether files are ignored, for a column of paths below the root, in generated code."""
        clean, out = F.regexp_replace(path, "^/+|/+$", ""), F.lit(False)
        for pattern, ignores in self.rules:  # a later rule goes around the earlier ones
            out = F.when(clean.rlike(f"(?s){pattern.pattern}"), ignores).otherwise(out)
        return F.coalesce((clean != "") & out, F.lit(False))

    def matches(self, path: str, is_dir: bool) -> bool:
        clean = path.replace(os.sep, "/").strip("/")
        return bool(clean) and (self._decided(clean) or (is_dir and self._decided(clean + "/")))


def rebased(line: str, folder: str) -> str:
    """A line of a nested ignore file, relative to the root.

    Its pattern is put below the folder as it is, so one without a slash then fits direct
    children of the folder alone.
    """
    if not folder or not line or line.lstrip().startswith("#") or line.startswith(("\\!", "\\#")):
        return line
    sign, pattern = ("!", line[1:]) if line.startswith("!") else ("", line)
    slash, pattern = ("/", pattern[1:]) if pattern.startswith("/") else ("", pattern)
    return f"{sign}{slash}{folder}/{pattern}" if pattern else f"{sign}{slash}{folder}"


def _segment(glob: str) -> str:
    """One path segment of an ignore pattern as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + glob[i + 1 : i + 2].count("!") + glob[i + 1 : i + 2].count("^")) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return out


def compiled_rule(line: str) -> tuple[re.Pattern, bool] | None:
    """The pattern of an ignore line, for paths without a leading slash, and whether it ignores; None for no rule."""
    text = re.sub(r"(?<!\\) +$", "", line)
    if not text.strip() or text.startswith("#"):
        return None
    ignores = not text.startswith("!")
    text = text if ignores else text[1:]
    text = text[1:] if text.startswith(("\\#", "\\!")) else text
    only_dirs, text = text.endswith("/"), text.rstrip("/")
    if not text:
        return None
    parts = text.lstrip("/").split("/")
    anchored = text.startswith("/") or len(parts) > 1
    out = "" if anchored else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment(part) + ("" if last else "/")
    return re.compile(f"^{out}" + ("/.*$" if only_dirs else "(?:/.*)?$"), re.S), ignores


@dataclass(frozen=True)
class CopySummary:
    files_copied: int
    dirs_created: int
    paths_skipped_by_gitignore: int
    paths_skipped_git_dir: int
    elapsed_ms: int


def copy_project(source: Path, target: Path, rules: IgnoreRules) -> CopySummary:
    """Copy a tree breadth first, by name, without ignored paths and ``.git`` folders.

    An ignored folder is counted once and not entered; links are copied as links and count as files.
    """
    began = time.monotonic()
    target.mkdir(parents=True, exist_ok=True)
    count = dict.fromkeys(("files", "dirs", "ignored", "git"), 0)
    folders = [source]
    for folder in folders:  # grows while it is walked
        for entry in sorted(folder.iterdir(), key=lambda p: p.name):
            place = target / entry.relative_to(source)
            if entry.name == ".git" and entry.is_dir():
                count["git"] += 1
            elif rules.matches(entry.relative_to(source).as_posix(), entry.is_dir()):
                count["ignored"] += 1
            elif entry.is_symlink():
                if place.exists() or place.is_symlink():
                    place.unlink()
                place.symlink_to(os.readlink(entry))
                count["files"] += 1
            elif entry.is_dir():
                folders.append(entry)
                if not place.exists():
                    place.mkdir()
                    count["dirs"] += 1
            else:
                shutil.copy2(entry, place)
                count["files"] += 1
    return CopySummary(count["files"], count["dirs"], count["ignored"], count["git"], round((time.monotonic() - began) * 1000))


def replace_file(path: Path, text: str) -> None:
    """Write beside the file, then rename over it."""
    beside = path.with_name(f".{path.name}.new")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, path)
