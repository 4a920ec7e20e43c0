"""The harmonize job: a cell grid in, records, quarantine and audit tables out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridwork.config import JobConfig
from gridwork.functions.cells import column_letters, entries_json, row_json
from gridwork.functions.labels import folded
from gridwork.operators.headers import SHEET, find_headers
from gridwork.operators.mapping import (
    HEADER,
    directory,
    extra_names,
    header_columns,
    place_rows,
    segment_mapping,
    segments,
    sheet_bounds,
    untitled_columns,
)
from gridwork.operators.matching import AMBIGUOUS, CONFLICT
from gridwork.operators.rows import judge_rows, name_cells
from gridwork.session import broadcast_if_small, settle
from gridwork.sources.grid import apply_sheet_rules

EVENT = ["level", "code", "group", "file", "sheet", "row_no", "detail"]


@dataclass
class Harmonized:
    """Everything a harmonize job yields, as DataFrames."""

    cfg: JobConfig
    record: DataFrame
    quarantine: DataFrame
    mapping: DataFrame
    event: DataFrame
    segment: DataFrame
    groups: DataFrame
    extras: DataFrame


def event(rows: DataFrame, level: str, code: str, detail: Column | str = "", row: str | None = None) -> DataFrame:
    """Audit events, one per input row; absent provenance columns read NULL."""

    def present(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)

    return rows.select(
        F.lit(level).alias("level"),
        F.lit(code).alias("code"),
        present("group").alias("group"),
        present("file").alias("file"),
        present("sheet").alias("sheet"),
        (F.lit(None) if row is None else F.col(row)).cast("long").alias("row_no"),
        (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
    )


def harmonize(
    grid: DataFrame,
    cfg: JobConfig,
    groups: DataFrame | None = None,
    failures: DataFrame | None = None,
    listing_events: DataFrame | None = None,
    keep_rows: bool = True,
) -> Harmonized:
    """Detect headers, map columns, judge rows.

    ``groups(group, files_found)`` keeps groups without files visible. ``failures(group, file,
    sheet, detail)`` names unreadable files (``sheet`` NULL) and sheets; none of their rows stay.
    ``keep_rows`` writes the judged rows once to the checkpoint folder, which pays off as soon as
    more than one output is used; without it each output recomputes them from the grid.
    """
    cfg.check()
    grid, excluded = apply_sheet_rules(grid, cfg)
    if failures is not None:
        grid = _without_failures(grid, failures)
    sheets = settle(sheet_bounds(grid))
    headers = find_headers(grid, cfg)
    segment = settle(segments(headers, sheets))
    columns = settle(header_columns(segment, cfg))

    known = segment.join(columns.groupBy(*HEADER).agg(F.collect_list("col").alias("columns")), HEADER, "left")
    known = known.select(*[c for c in segment.columns if c not in ("winners", "titles", "quality")], "columns")
    lookup = settle(directory(known, known.select(*HEADER)))
    stray = settle(untitled_columns(place_rows(grid, broadcast_if_small(lookup))))
    extras = settle(_extras(columns, stray, cfg))
    mapped = settle(_outputs(columns, stray, extras, cfg))

    lean = segment.drop("winners", "titles", "quality", "matched", "seg_no")
    lookup = settle(directory(lean, segment_mapping(mapped, cfg)))
    placed = place_rows(grid, broadcast_if_small(lookup))
    judged = judge_rows(name_cells(placed, cfg), cfg)
    judged = judged.select(
        "group", *HEADER, "file_ord", "sheet_ord", "row_no", "cells", "missing", "entries", "reason"
    )
    if keep_rows:
        judged = settle(judged)
    good = judged.where(F.col("reason").isNull())
    record = good.select(
        "group", *HEADER, "file_ord", "sheet_ord", "row_no", F.map_from_entries("entries").alias("values")
    )
    bad = judged.where(F.col("reason").isNotNull())
    quarantine = bad.select(
        "group",
        *SHEET,
        "row_no",
        "reason",
        row_json(F.col("cells")).alias("raw_row"),
        entries_json(F.col("entries")).alias("mapped_data"),
    )
    mapping = _mapping_audit(mapped)
    found = sheets.select("group", "file").distinct().groupBy("group").agg(F.count("file").alias("files_found"))
    groups = found if groups is None else groups
    events = [
        excluded,
        *([_failure_events(failures)] if failures is not None else []),
        *([listing_events] if listing_events is not None else []),
        *_header_events(segment, mapped, sheets, cfg),
        *_row_events(judged, segment, stray.join(extras, ["group", "title_norm", "occurrence"])),
        event(groups.where(F.col("files_found") == 0), "WARNING", "EMPTY_GROUP", "no source file in this group"),
        _no_data_event(good),
    ]
    audit = reduce(DataFrame.unionByName, [e.select(*EVENT) for e in events])
    return Harmonized(cfg, record, quarantine, mapping, audit, segment.drop("winners", "titles"), groups, extras)


def _without_failures(grid: DataFrame, failures: DataFrame) -> DataFrame:
    files = settle(failures.where(F.col("sheet").isNull()).select("file").distinct())
    sheets = settle(failures.where(F.col("sheet").isNotNull()).select(*SHEET).distinct())
    readable = grid.join(broadcast_if_small(files), "file", "left_anti")
    return readable.join(broadcast_if_small(sheets), SHEET, "left_anti")


def _failure_events(failures: DataFrame) -> DataFrame:
    whole = failures.where(F.col("sheet").isNull())
    part = failures.where(F.col("sheet").isNotNull())
    return event(whole, "ERROR", "FILE_READ_FAILED", F.col("detail")).unionByName(
        event(part, "ERROR", "SHEET_READ_FAILED", F.col("detail"))
    )


def _extras(columns: DataFrame, stray: DataFrame, cfg: JobConfig) -> DataFrame:
    shared = ["group", "title_norm", "occurrence", "file_ord", "sheet_ord", "col", "title"]
    unmatched = columns.where(F.col("target").isNull())
    both = unmatched.select(*shared, F.col("header_row").alias("at_row")).unionByName(
        stray.select(*shared, F.col("since").alias("at_row"))
    )
    return extra_names(both, cfg)


def _outputs(columns: DataFrame, stray: DataFrame, extras: DataFrame, cfg: JobConfig) -> DataFrame:
    """All source columns, titled and untitled, with their output names."""
    titled = columns.withColumn("since", F.lit(0).cast("long"))
    both = titled.unionByName(stray.withColumn("since", F.col("since").cast("long")), allowMissingColumns=True)
    named = both.join(extras.drop("first_seen"), ["group", "title_norm", "occurrence"], "left")
    output = F.coalesce("target", "name")
    return named.withColumn("output", output).withColumn("output_norm", folded(F.col("output")))


def _mapping_audit(mapped: DataFrame) -> DataFrame:
    titled = mapped.where(F.col("since") == 0)
    return titled.select(
        "group",
        *SHEET,
        "header_row",
        "height",
        column_letters(F.col("col")).alias("source_column"),
        F.col("raw").alias("original_title"),
        "title",
        "strategy",
        F.coalesce(F.nullif("scored_label", F.lit("")), F.col("title")).alias("scored_title"),
        F.col("output").alias("target"),
        "state",
        "score",
        "runner_up",
        "margin",
    )


def _header_events(segment: DataFrame, mapped: DataFrame, sheets: DataFrame, cfg: JobConfig) -> list[DataFrame]:
    titled = mapped.where(F.col("since") == 0)
    doubtful = titled.where(F.col("state").isin(AMBIGUOUS, CONFLICT))
    review = F.format_string("%s -> %s; %s; score=%s", "raw", "output", "state", F.col("score").cast("string"))
    names = F.array(*[F.lit(n) for n in cfg.names])
    present = titled.groupBy("group", *HEADER).agg(F.collect_set("output").alias("present"))
    missing = present.withColumn("absent", F.array_except(names, F.col("present"))).where(F.size("absent") > 0)
    found = F.format_string("header row %d, height %d, matched %d", "header_row", "height", "matched")
    headless = sheets.join(segment.select(*SHEET).distinct(), SHEET, "left_anti")
    window = f"no header in rows {cfg.search_start} to {cfg.search_end}; the sheet was skipped"
    return [
        event(doubtful, "WARNING", "HEADER_REVIEW", review, "header_row"),
        event(missing, "WARNING", "MISSING_COLUMNS", F.array_join("absent", ", "), "header_row"),
        event(segment, "INFO", "HEADER_FOUND", found, "header_row"),
        event(segment.where("seg_no > 1"), "INFO", "REPEATED_HEADER", "columns were mapped anew", "header_row"),
        event(headless, "WARNING", "HEADER_NOT_FOUND", window),
    ]


def _row_events(judged: DataFrame, segment: DataFrame, stray: DataFrame) -> list[DataFrame]:
    formulas = judged.select("group", *SHEET, "row_no", F.explode("missing").alias("m"))
    formula = F.concat(column_letters(F.col("m.col")), F.lit(": no stored result; kept as text: "), F.col("m.formula"))
    unnamed = F.concat(F.lit("column "), column_letters(F.col("col")), F.lit(" -> "), F.col("name"))
    rejected = F.col("reason").isNotNull()
    counted = judged.groupBy("group", *SHEET).agg(
        F.count(F.when(~rejected, 1)).alias("added"), F.count(F.when(rejected, 1)).alias("rejected")
    )
    headed = segment.select("group", *SHEET).distinct().join(counted, ["group", *SHEET], "left").fillna(0)
    done = F.format_string("added %d, quarantined %d", "added", "rejected")
    return [
        event(formulas, "WARNING", "FORMULA_CACHE_MISSING", formula, "row_no"),
        event(stray, "WARNING", "UNNAMED_COLUMN", unnamed, "since"),
        event(
            headed.where("rejected > 0"),
            "WARNING",
            "QUARANTINED_ROWS",
            F.format_string("%d rows were set aside", "rejected"),
        ),
        event(headed, "INFO", "SHEET_DONE", done),
    ]


def _no_data_event(good: DataFrame) -> DataFrame:
    count = good.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return event(count.where("n = 0"), "WARNING", "NO_DATA", "no record passed")


def wide(record: DataFrame, cfg: JobConfig, extra_columns: list[str]) -> DataFrame:
    """Records in schema order, then extras, then provenance; absent columns read NULL."""
    values = F.col("values")
    named = [values[n]["v"].alias(n) for n in [*cfg.names, *extra_columns]]
    return record.select("group", *named, "file", "sheet", "row_no")


def extra_columns_of(result: Harmonized, group: str) -> list[str]:
    """Names of the preserved columns of one group, as first seen. As many as there are columns."""
    rows = result.extras.where(F.col("group") == group).orderBy("first_seen").select("name").collect()
    return [row["name"] for row in rows]
