"""Report rows and their text form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

SECTIONS = (("exact", "Exact duplicates (md5)"), ("fuzzy", "Similar intents"), ("normalized_code_fuzzy", "Similar code"))
SHOWN = ("match_type", "group_id", "record_id", "kind", "file_path", "signature", "said", "lines", "best_ratio", "avg_ratio", "md5_overlap")


def report_rows(members: DataFrame) -> DataFrame:
    """Members as text: ratios with four decimals, yes or no, ``None`` for what is missing.

    ``said`` is the intent, or the code where code was compared.
    """
    said = F.when(F.col("match_type") == "normalized_code_fuzzy", F.col("normalized_code")).otherwise(F.col("intent"))
    missing = F.lit("None")
    return members.select(
        "run_id",
        "match_type",
        "group_id",
        "record_id",
        "kind",
        "file_path",
        F.coalesce("signature", missing).alias("signature"),
        F.coalesce(said, missing).alias("said"),
        F.concat_ws("-", "start_line", "end_line").alias("lines"),
        F.format_string("%.4f", "best_ratio").alias("best_ratio"),
        F.format_string("%.4f", "avg_ratio").alias("avg_ratio"),
        F.when(F.col("md5_overlap"), "yes").otherwise("no").alias("md5_overlap"),
    )


def record_json(records: DataFrame) -> DataFrame:
    """One JSON object for each record, keys in order, nulls kept."""
    columns = sorted(c for c in records.columns if c != "seq")
    return records.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def json_document(records: DataFrame, errors: DataFrame) -> str:
    """The whole document, for output that a person reads."""
    body = {"errors": [r.asDict() for r in errors.orderBy("file_path").collect()], "records": [json.loads(r.json) for r in record_json(records.orderBy("file_path", "seq")).collect()]}
    return json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False)


def table_text(header: tuple[str, ...], rows: list[tuple]) -> str:
    """Aligned columns; line breaks inside cells are shown as \\n."""
    cells = [header, *(tuple(str(x).replace("\n", "\\n") for x in r) for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(header))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def records_text(records: DataFrame, with_intent: bool) -> str:
    """Record tables, one for each file."""
    header = ("kind", "lines", "md5sum", "signature", *(("intent_status", "intent") if with_intent else ()))
    out, now, held = [], None, []
    rows = records.withColumn("lines", F.concat_ws("-", "start_line", "end_line")).orderBy("file_path", "seq")
    for r in [*rows.toLocalIterator(), None]:
        if r is None or r["file_path"] != now:
            if held:
                out.append(f"{now}\n{table_text(header, held)}")
            now, held = (r["file_path"] if r else None), []
        if r:
            held.append(tuple(r[c] for c in header))
    return "\n\n".join(out)


def report_text(groups: DataFrame, members: DataFrame) -> str:
    """Three sections, each by group."""
    sizes = {(g.match_type, g.group_id): (g.pair_count, g.md5_overlap_pairs) for g in groups.collect()}
    rows = report_rows(members).orderBy("match_type", "group_id", "record_id").collect()
    out = []
    for kind, title in SECTIONS:
        out.append(f"== {title} ==")
        own = [r for r in rows if r.match_type == kind]
        if not own:
            out.append("No groups")
        for group in dict.fromkeys(r.group_id for r in own):
            pairs, overlap = sizes[kind, group]
            header = ("record_id", "kind", "file_path", "lines", "signature", "normalized_code" if kind == "normalized_code_fuzzy" else "intent", "best_ratio", "avg_ratio", "md5_overlap")
            out.append(f"group {group}: pairs={pairs} md5_overlap_pairs={overlap}")
            out.append(table_text(header, [(r.record_id, r.kind, r.file_path, r.lines, r.signature, r.said, r.best_ratio, r.avg_ratio, r.md5_overlap) for r in own if r.group_id == group]))
    return "\n".join(out)
