"""Commands: ``python -m echoloom.cli model-build --path src``.

Exit code 2 stands for unusable arguments or a phase that failed; its reason is on stderr.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoloom.operators.duplicates import find_duplicates
from echoloom.operators.enrich import Client, Progress, chosen_client, enriched_once, parsed_scopes
from echoloom.operators.extract import built_records, split_symbols, tagged_symbols
from echoloom.operators.rewrite import rewrite_files
from echoloom.operators.symbols import CANDIDATE, EXTERNAL, module_roots, project_index, rename_map, symbol_rows
from echoloom.plans.report import json_document, records_text, report_text
from echoloom.scratch import scratch_path, stored
from echoloom.session import session
from echoloom.sources.store import RunStore
from echoloom.sources.tree import IgnoreRules, copy_project, python_paths, read_files, replace_file

ROOT_OPTIONS = ("--path", "--format", "--output")


class UsageError(ValueError):
    """An argument that cannot be used, or a phase that failed."""


def _need(good: bool, reason: str) -> None:
    if not good:
        raise UsageError(reason)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="echoloom", exit_on_error=False)
    top.add_argument("--path")
    top.add_argument("--format", choices=("table", "json"), default="table")
    top.add_argument("--output")
    commands = top.add_subparsers(dest="command", required=True)
    workers, model = argparse.ArgumentParser(add_help=False), argparse.ArgumentParser(add_help=False)
    workers.add_argument("--analyzer-workers", type=int, default=4)
    model.add_argument("--provider-url", required=True)
    model.add_argument("--model", required=True)
    model.add_argument("--scope", default="")
    model.add_argument("--progress-batch-size", type=int, default=10)
    model.add_argument("--enricher-workers", type=int, default=4)
    model.add_argument("--answer-log", help="folder of answers that later runs use again")
    commands.add_parser("model-build", parents=[workers])
    commands.add_parser("enrich-intent", parents=[workers, model])
    commands.add_parser("persist", parents=[workers, model]).add_argument("--db-path", required=True)
    check = commands.add_parser("dup-check")
    check.add_argument("--db-path", required=True)
    check.add_argument("--run-id", type=int, required=True)
    check.add_argument("--intent-threshold", type=float, default=0.85)
    obfuscate = commands.add_parser("obfuscate")
    obfuscate.add_argument("--input", required=True)
    obfuscate.add_argument("--output-dir", "--output", dest="target", required=True)
    return top


def hoisted(argv: list[str]) -> list[str]:
    """Options of all commands, wherever they stand, before the command."""
    if "obfuscate" in argv:
        return argv
    first, rest, words = [], [], iter(argv)
    for word in words:
        if word in ROOT_OPTIONS:
            first += [word, *([value] if (value := next(words, None)) is not None else [])]
        elif word.startswith(tuple(f"{o}=" for o in ROOT_OPTIONS)):
            first.append(word)
        else:
            rest.append(word)
    return first + rest


def _analyzed(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    _need(bool(args.path), f"Path is required for {args.command}")
    _need(Path(args.path).exists(), f"Path does not exist: {args.path}")
    _need(args.analyzer_workers > 0, "analyzer-workers must be > 0")
    tagged = stored(tagged_symbols(read_files(python_paths(spark, args.path, args.analyzer_workers))), "symbols")
    symbols, errors = split_symbols(tagged)
    return stored(built_records(symbols), "records"), errors


def _asked(args: argparse.Namespace, records: Callable[[], tuple[DataFrame, DataFrame]], client: Callable[[argparse.Namespace], Callable[[], Client]], out: TextIO) -> tuple[DataFrame, DataFrame]:
    _need(args.progress_batch_size > 0, "progress-batch-size must be > 0")
    _need(args.enricher_workers > 0, "enricher-workers must be > 0")
    try:
        scopes = parsed_scopes(args.scope)
    except ValueError:
        raise UsageError(f"Invalid scope: {args.scope}") from None
    built, errors = records()
    log = args.answer_log or scratch_path(built.sparkSession, "answers")

    def tell(t: Progress) -> None:
        if t.total:
            out.write(f"progress {t.n}/{t.total} percent={t.percent:.1f} failed={t.failed} eta_seconds={t.eta_seconds}\n")
            out.flush()

    done = enriched_once(built, client(args), scopes, log, f"{args.provider_url} {args.model}", args.enricher_workers, args.progress_batch_size, tell, ("file_path", "seq"))
    return stored(done.drop("elapsed"), "enriched"), errors


def _client(args: argparse.Namespace) -> Callable[[], Client]:
    url, model, key = args.provider_url, args.model, os.environ.get("OPENAI_API_KEY", "")
    return lambda: chosen_client(url, model, key)


def _tell_errors(errors: DataFrame, err: TextIO) -> int:
    rows = errors.orderBy("file_path").collect()
    for r in rows:
        err.write(f"analyzer_error: {r.file_path}: {r.message}\n")
    return len(rows)


def _show(records: DataFrame, errors: DataFrame, args: argparse.Namespace, with_intent: bool, out: TextIO, err: TextIO) -> None:
    _tell_errors(errors, err)
    text = json_document(records, errors) if args.format == "json" else records_text(records, with_intent)
    if args.output:
        try:
            Path(args.output).parent.mkdir(parents=True, exist_ok=True)
            Path(args.output).write_text(text + "\n", encoding="utf-8")
        except OSError as fault:
            raise UsageError(f"Cannot write {args.output}: {fault}") from None
    else:
        out.write(text + "\n")


def _persist(spark: SparkSession, args: argparse.Namespace, client: Callable, out: TextIO, err: TextIO) -> None:
    _need(Path(args.db_path).parent.exists(), f"Parent directory does not exist: {Path(args.db_path).parent}")
    records, errors = _asked(args, lambda: _analyzed(spark, args), client, err)
    n = _tell_errors(errors, err)
    run = RunStore(spark, f"file://{Path(args.db_path).resolve()}").persist(records, n, args.path, args.provider_url, args.model, args.scope, args.progress_batch_size)
    out.write(f"persisted run_id={run['run_id']} db_path={args.db_path} record_count={run['record_count']} intent_failed_count={run['intent_failed_count']} analyzer_error_count={n} status={run['status']}\n")


def _dup_check(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> None:
    _need(args.format == "table", "dup-check supports only table format")
    _need(0.0 <= args.intent_threshold <= 1.0, "intent-threshold must be between 0.0 and 1.0")
    _need(Path(args.db_path).exists(), f"DB path does not exist: {args.db_path}")
    records = RunStore(spark, f"file://{Path(args.db_path).resolve()}").load(args.run_id)
    groups, members = (stored(x, "found") for x in find_duplicates(records, args.intent_threshold))
    # Groups of similar code alone count as no finding here, though the library gives them.
    if groups.where("match_type <> 'normalized_code_fuzzy'").isEmpty():
        out.write(f"No duplication findings for run_id={args.run_id}\n")
    else:
        out.write(report_text(groups, members) + "\n")


def _paths(source: Path, target: Path) -> tuple[Path, Path]:
    source, target = source.resolve(), target.resolve()
    _need(source.exists(), f"Input path does not exist: {source}")
    _need(source.is_dir(), f"Input path must be a directory: {source}")
    _need((source / ".gitignore").exists(), f"Input path must contain .gitignore: {source}")
    _need(not (target.is_dir() and any(target.iterdir())), f"Output path must be empty: {target}")
    _need(source != target and source not in target.parents and target not in source.parents, "Input and output paths must not overlap")
    return source, target


def transform_project(spark: SparkSession, root: Path) -> dict[str, int]:
    """Rewrite the Python files of a tree in place; the first fault ends it, files done before stay."""
    began = time.monotonic()
    files = stored(read_files(python_paths(spark, str(root))), "project-files")
    bad = files.where("error IS NOT NULL").orderBy("file_path").first()
    roots = [r.name for r in module_roots(files).collect()]
    index = stored(project_index(symbol_rows(files, roots)), "project-index")
    mapped = stored(rename_map(index), "rename-map")
    size = {r["category"]: r["count"] for r in index.groupBy("category").count().collect()}
    count = dict.fromkeys(("python_files_discovered", "python_files_processed", "python_files_unchanged", "symbols_discovered", "symbols_renamed", "symbols_skipped_external", "symbols_renamed_likely_local", "dynamic_name_rewrites"), 0)
    count |= {"python_files_discovered": files.count(), "symbols_discovered": size.get(CANDIDATE, 0), "symbols_skipped_external": size.get(EXTERNAL, 0)}
    for r in stored(rewrite_files(files, index, mapped), "rewritten").orderBy("file_path").toLocalIterator():
        if r.error is not None:
            raise UsageError(f"Transform failed: {r.file_path}: {bad.error if bad and bad.file_path == r.file_path else r.error}")
        count["python_files_processed"] += 1
        count["symbols_renamed"] += r.symbols_renamed
        count["symbols_renamed_likely_local"] += r.likely_local_rewrites
        count["dynamic_name_rewrites"] += r.dynamic_name_rewrites
        if r.unchanged:
            count["python_files_unchanged"] += 1
        else:
            replace_file(root / r.file_path, r.transformed_source)
    return count | {"elapsed_ms": round((time.monotonic() - began) * 1000)}


def _obfuscate(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> None:
    def summary(values: dict) -> None:
        out.write(" ".join(f"{k}={v}" for k, v in values.items()) + "\n")

    out.write("validation:start\n")
    source, target = _paths(Path(args.input), Path(args.target))
    out.write("validation:done\n")
    try:
        rules = IgnoreRules.below(source)
    except (OSError, UnicodeDecodeError) as fault:
        raise UsageError(f"Failed to read .gitignore files: {fault}") from None
    out.write("copy:start\n")
    try:
        copied = copy_project(source, target, rules)
    except OSError as fault:
        raise UsageError(f"Copy failed: {fault}") from None
    out.write("copy:done\n")
    summary(vars(copied))
    out.write("transform:start\n")
    done = transform_project(spark, target)
    out.write("transform:done\n")
    summary(done)
    out.write("status=success\n")


def run(argv: list[str], out: TextIO, err: TextIO, spark: SparkSession | None = None, client: Callable = _client) -> int:
    try:
        args = parser().parse_args(hoisted(argv))
    except (argparse.ArgumentError, SystemExit) as fault:
        err.write(f"{fault}\n")
        return 2
    spark = spark or session()
    try:
        match args.command:
            case "model-build":
                _show(*_analyzed(spark, args), args, False, out, err)
            case "enrich-intent":
                _show(*_asked(args, lambda: _analyzed(spark, args), client, err), args, True, out, err)
            case "persist":
                _persist(spark, args, client, out, err)
            case "dup-check":
                _dup_check(spark, args, out)
            case "obfuscate":
                _obfuscate(spark, args, out)
    except UsageError as fault:
        err.write(f"{fault}\n")
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:], sys.stdout, sys.stderr))
