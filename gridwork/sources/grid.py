"""Cell grids: one row per physical row of a sheet.

``group, file, file_ord, sheet, sheet_ord, visible, row_no, cells, formats, missing``, where
``file_ord`` is any value that sorts files in source order and ``row_no`` counts from 1.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridwork.config import JobConfig
from gridwork.functions.cells import CELL_DDL, MISSING_RESULT, make_cell, null_cell, text_cell
from gridwork.functions.paths import glob_pattern
from gridwork.session import broadcast_if_small, settle

ROWS_AT_ONCE = 5_000
MISSING_DDL = "array<struct<col:int,formula:string>>"
GRID = ["group", "file", "file_ord", "sheet", "sheet_ord", "visible", "row_no", "cells", "formats", "missing"]


def grid_rows(
    df: DataFrame,
    cells: Column,
    row_no: Column,
    file: Column,
    sheet: Column,
    group: Column | None = None,
    file_ord: Column | None = None,
    sheet_ord: Column | None = None,
    visible: Column | None = None,
    formats: Column | None = None,
    missing: Column | None = None,
) -> DataFrame:
    """A grid from columns of any DataFrame; what is not given gets its default."""
    return df.select(
        (sheet if group is None else group).alias("group"),
        file.alias("file"),
        (file if file_ord is None else file_ord).alias("file_ord"),
        sheet.alias("sheet"),
        (F.lit(0) if sheet_ord is None else sheet_ord).cast("int").alias("sheet_ord"),
        (F.lit(True) if visible is None else visible).alias("visible"),
        row_no.cast("long").alias("row_no"),
        cells.cast(f"array<{CELL_DDL}>").alias("cells"),
        (F.array() if formats is None else formats).cast("array<string>").alias("formats"),
        (F.array() if missing is None else missing).cast(MISSING_DDL).alias("missing"),
    )


def apply_sheet_rules(grid: DataFrame, cfg: JobConfig) -> tuple[DataFrame, DataFrame]:
    """Sheets in scope, and an event for each one that is not."""
    allowed = F.col("visible") | F.lit(cfg.include_hidden_sheets)
    for pattern in cfg.exclude_sheets:
        allowed = allowed & ~F.lower("sheet").rlike(glob_pattern(pattern.casefold()))
    left_out = grid.where(~allowed).select("group", "file", "sheet").distinct()
    events = left_out.select(
        F.lit("INFO").alias("level"),
        F.lit("SHEET_EXCLUDED").alias("code"),
        "group",
        "file",
        "sheet",
        F.lit(None).cast("long").alias("row_no"),
        F.lit("hidden or excluded by name").alias("detail"),
    )
    return grid.where(allowed), events


#: What the text of a cell must look like, by its type; the other types hold any text.
CELL_FORMS = {
    "int": r"^[+-]?[0-9]+$",
    "float": r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$",
    "bool": r"(?i)^(true|false)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
}


def sheet_failures(grid: DataFrame) -> DataFrame:
    """``group, file, sheet, row_no, detail`` of each sheet of a grid that holds a faulty row, with the first of
    them: no or no positive row number, a row number that comes twice, no list of cells, or a cell whose text
    doesn't fit its type. ``harmonize`` keeps none of the rows of such sheets. One row per sheet and kind of
    fault leaves a task, but for row numbers, which are compared by sheet and number."""

    def misfit(cell: Column) -> Column:
        bad = F.lit(False)
        for kind, form in CELL_FORMS.items():
            bad = bad | ((cell["t"] == kind) & cell["v"].isNotNull() & ~cell["v"].rlike(form))
        return F.coalesce(bad, F.lit(False))

    detail = (
        F.when(F.col("row_no").isNull() | (F.col("row_no") < 1), "no row number")
        .when(F.col("cells").isNull(), "no cells")
        .when(F.exists("cells", misfit), "a cell does not fit its type")
    )
    faults = grid.select("group", "file", "sheet", "row_no", detail.alias("detail")).where("detail IS NOT NULL")
    twice = grid.where("row_no IS NOT NULL").groupBy("group", "file", "sheet", "row_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    every = faults.unionByName(twice.select("group", "file", "sheet", "row_no", F.lit("row number comes twice").alias("detail")))
    first = F.min(F.struct(F.coalesce("row_no", F.lit(0)).alias("at"), "detail", "row_no")).alias("first")
    return every.groupBy("group", "file", "sheet").agg(first).select("group", "file", "sheet", "first.row_no", "first.detail")


def group_by_sheet_name(grid: DataFrame) -> DataFrame:
    """Equally named sheets of all files form one group, whatever their case. It is called as
    first seen in source order."""
    folded = F.lower("sheet")
    sheets = grid.select("sheet", "file_ord", "sheet_ord").distinct()
    first = F.struct("file_ord", "sheet_ord", "sheet")
    names = settle(sheets.groupBy(folded.alias("sheet_key")).agg(F.min(first)["sheet"].alias("group")))
    keyed = grid.drop("group").withColumn("sheet_key", folded)
    return keyed.join(broadcast_if_small(names), "sheet_key").select(*GRID)


PARSED = "group string, file string, file_ord string, row_no long, cells array<string>, detail string"


def parse_texts(files: DataFrame, delimiter: str = ",") -> DataFrame:
    """Records of text files already read as ``(group, file, file_ord, text)``: ``group, file,
    file_ord, row_no, cells, detail``. Quoted fields may hold delimiters and line breaks; blank lines
    keep their row number. A file with a malformed record, or that could not be read (text NULL),
    gives no record but one row with the reason in ``detail``."""

    def rows_of(text: str | None) -> tuple[list[list[str]], str | None]:
        if text is None:
            return [], "file could not be read"
        csv.field_size_limit(sys.maxsize)
        reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True)
        try:
            return list(reader), None
        except csv.Error as error:
            return [], f"line {reader.line_num}: {error}"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
        names = ["group", "file", "file_ord", "row_no", "cells", "detail"]
        for batch in batches:
            for i in range(batch.num_rows):
                group, file, file_ord, text = (c[i].as_py() for c in batch.columns)
                rows, detail = rows_of(text)
                numbers = list(range(1, len(rows) + 1))
                if detail is not None:
                    rows, numbers = [[]], [None]
                for low in range(0, len(rows), ROWS_AT_ONCE):
                    part = rows[low : low + ROWS_AT_ONCE]
                    same = [[v] * len(part) for v in (group, file, file_ord)]
                    columns = [*same, numbers[low : low + ROWS_AT_ONCE], part, [detail] * len(part)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    wanted = files.select(F.col("group").cast("string"), F.col("file").cast("string"), F.col("file_ord").cast("string"), "text")
    return wanted.mapInArrow(parse, PARSED)


def parsed_grid(parsed: DataFrame) -> DataFrame:
    """The grid of parsed text files, one sheet per file, named like the file without its suffix."""
    rows = parsed.where(F.col("detail").isNull())
    cells = F.transform("cells", lambda f: F.when(f != "", text_cell(f)).otherwise(null_cell()))
    name = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return grid_rows(rows, cells, F.col("row_no"), F.col("file"), name, group=F.col("group"), file_ord=F.col("file_ord"))


def parse_failures(parsed: DataFrame) -> DataFrame:
    """``group, file, sheet, row_no, detail`` of the files that gave no rows."""
    failed = parsed.where(F.col("detail").isNotNull())
    return failed.select("group", "file", F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("long").alias("row_no"), "detail")


def text_grid(files: DataFrame, delimiter: str = ",") -> DataFrame:
    """A grid from text files, without the malformed ones; see ``parse_texts``."""
    return parsed_grid(parse_texts(files, delimiter))


def merge_formulas(formulas: DataFrame, values: DataFrame) -> DataFrame:
    """Cells of a formula grid and a value grid with the keys ``file, sheet, row_no``, aligned by
    position. ``formulas`` and ``values`` are arrays of cells; a formula reads ``t = 'formula'``.
    A formula without a value becomes a marker text and is listed in ``missing``."""
    keys = ["file", "sheet", "row_no"]
    both = formulas.join(values, keys, "full")
    nothing = F.array().cast(f"array<{CELL_DDL}>")
    pairs = F.zip_with(
        F.coalesce("formulas", nothing), F.coalesce("values", nothing), lambda f, v: F.struct(f.alias("f"), v.alias("v"))
    )
    lost = lambda p: F.coalesce((p["f"]["t"] == "formula") & p["v"]["v"].isNull(), F.lit(False))
    marker = lambda p: make_cell("text", F.concat(F.lit(MISSING_RESULT + " "), p["f"]["v"]))
    merged = both.withColumn("_pairs", pairs)
    cells = F.transform("_pairs", lambda p: F.when(lost(p), marker(p)).otherwise(p["v"]))
    gaps = F.transform(
        "_pairs",
        lambda p, i: F.when(lost(p), F.struct(i.alias("col"), p["f"]["v"].alias("formula"))),
    )
    return merged.select(
        *keys, cells.alias("cells"), F.filter(gaps, lambda g: g.isNotNull()).cast(MISSING_DDL).alias("missing")
    )
