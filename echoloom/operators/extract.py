"""Symbols of Python files as rows."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from echoloom.functions.normalize import fingerprint, normalize_code
from echoloom.schema import SYMBOL

TAGGED = f"{SYMBOL}, seq int, error string"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def symbols_of(source: str) -> Iterator[tuple[str, str | None, int, int, str]]:
    """(kind, signature, start_line, end_line, raw_code): the file, then its definitions in preorder.

    Only definitions directly in the body of a module, class or function count, not those
    inside other statements.  Raises what ``ast.parse`` raises.
    """
    tree, lines = ast.parse(source), source.splitlines()
    yield "file", None, 1, max(1, len(lines)), source
    waiting = [(node, False) for node in reversed(tree.body)]
    while waiting:
        node, in_class = waiting.pop()
        if not isinstance(node, (ast.ClassDef, *FUNCTIONS)):
            continue
        is_class = isinstance(node, ast.ClassDef)
        kind = "class" if is_class else "method" if in_class else "function"
        start, end = node.lineno, node.end_lineno or node.lineno
        first = node.body[0]
        decorators = [d.lineno for d in getattr(first, "decorator_list", [])]
        header = max(start, min([first.lineno, *decorators]) - 1)
        yield kind, "\n".join(lines[start - 1 : header]), start, end, "\n".join(lines[start - 1 : end])
        waiting += [(child, is_class) for child in reversed(node.body)]


#: An analyzer gives the symbols of one text, as :func:`symbols_of` does; files are told by their suffix.
Analyzer = Callable[[str], Iterator[tuple[str, str | None, int, int, str]]]
ANALYZERS: dict[str, Analyzer] = {".py": symbols_of}


def _extractor(analyzers: dict[str, Analyzer]) -> Callable:
    columns = ["kind", "file_path", "signature", "start_line", "end_line", "raw_code", "seq", "error"]

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, content, error in zip(frame["file_path"], frame["content"], frame["error"], strict=True):
                analyze = analyzers.get(PurePosixPath(path).suffix)
                if content is None or analyze is None:
                    rows.append((None, path, None, None, None, None, 0, error or ("no content" if analyze else "no analyzer")))
                    continue
                try:
                    rows += [(kind, path, signature, start, end, raw, i, None) for i, (kind, signature, start, end, raw) in enumerate(list(analyze(content)))]
                except (SyntaxError, ValueError, RecursionError, MemoryError) as fault:
                    rows.append((None, path, None, None, None, None, 0, str(fault) or "nested too deeply"))
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return extract


def tagged_symbols(files: DataFrame, analyzers: dict[str, Analyzer] | None = None) -> DataFrame:
    """Rows of symbols, or of one error, for every file of (file_path, content[, error])."""
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    return files.select("file_path", "content", "error").mapInPandas(_extractor(analyzers or ANALYZERS), TAGGED)


def split_symbols(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(symbols, errors)`` of tagged rows; store these first if both are used."""
    return tagged.where("error IS NULL").drop("error"), tagged.where("error IS NOT NULL").select("file_path", F.col("error").alias("message"))


def built_records(symbols: DataFrame) -> DataFrame:
    """Symbols with normalised code and fingerprint, and no intent yet."""
    empty = F.lit(None).cast("string")
    coded = symbols.withColumn("normalized_code", normalize_code(F.col("raw_code")))
    return coded.withColumns({"md5sum": fingerprint(F.col("normalized_code")), "intent": empty, "intent_status": F.lit("skipped"), "intent_error": empty})
