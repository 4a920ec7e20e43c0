"""Which source column feeds which output column, per header."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridwork.config import JobConfig
from gridwork.functions.cells import column_letters, nonempty, strip
from gridwork.functions.labels import fold_label, folded
from gridwork.operators.headers import SHEET
from gridwork.operators.matching import CONFLICT, score_titles, tall_header_text
from gridwork.operators.ordered import block_of, chunk_of, next_position, sequence_number

HEADER = [*SHEET, "header_row"]
# Fixed value: title of a column without one.
UNTITLED = "Başlıksız"


def sheet_bounds(grid: DataFrame) -> DataFrame:
    """One row per sheet with its last row number."""
    return grid.groupBy("group", "file", "file_ord", "sheet", "sheet_ord").agg(F.max("row_no").alias("last_row"))


def segments(headers: DataFrame, sheets: DataFrame) -> DataFrame:
    """Header to header: the rows a header rules, with a running number per sheet."""
    ordered = next_position(headers, SHEET, "chunk", "row_no", "next_row")
    ordered = sequence_number(ordered, SHEET, ["chunk"], ["row_no"], "seg_no")
    ends = ordered.join(sheets, SHEET)
    return ends.select(
        "group",
        "file",
        "file_ord",
        "sheet",
        "sheet_ord",
        F.col("row_no").alias("header_row"),
        F.col("seg_no").cast("long").alias("seg_no"),
        "height",
        "quality",
        F.size("winners").alias("matched"),
        F.coalesce(F.col("next_row"), F.col("last_row") + 1).alias("end_row"),
        "winners",
        "titles",
    )


def header_columns(segment: DataFrame, cfg: JobConfig) -> DataFrame:
    """One audited row per header cell, before unmatched titles get their column names."""
    cells = segment.select(
        "group",
        *HEADER,
        "file_ord",
        "sheet_ord",
        "height",
        "winners",
        F.explode("titles").alias("c"),
    ).select("*", F.col("c.col").alias("col"), F.col("c.compare").alias("compare"), F.col("c.raw").alias("raw")).drop("c")
    decided = score_titles(cells.select(F.col("compare").alias("raw")).distinct(), cfg, full=True)
    cells = cells.join(decided.withColumnRenamed("raw", "compare"), "compare")
    won = F.exists("winners", lambda w: (w["col"] == F.col("col")) & (w["target"] == F.col("target")))
    lost = F.col("target").isNotNull() & ~won
    title = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("raw"))
    cells = (
        cells.withColumn("state", F.when(lost, CONFLICT).otherwise(F.col("state")))
        .withColumn("target", F.when(~lost, F.col("target")))
        .withColumn("strategy", F.when(F.col("height") > 1, tall_header_text(F.col("height"))).otherwise(F.col("strategy")))
        .withColumn("title", title)
        .withColumn("title_norm", folded(F.col("title")))
        .withColumn("raw_norm", folded(F.col("raw")))
    )
    # One partition is the cells of one header.
    repeats = Window.partitionBy(*HEADER, "title_norm").orderBy("col")
    return cells.withColumn("occurrence", F.row_number().over(repeats)).drop("winners", "compare")


def untitled_columns(placed: DataFrame) -> DataFrame:
    """Columns that hold data under no header cell, with the first row that does."""
    filled = F.filter(
        F.transform("cells", lambda c, i: F.when(nonempty(c), i)), lambda i: i.isNotNull()
    )
    stray = placed.select(
        "group", *HEADER, "file_ord", "sheet_ord", "row_no", F.explode(F.array_except(filled, F.col("columns"))).alias("col")
    )
    found = stray.groupBy("group", *HEADER, "file_ord", "sheet_ord", "col").agg(F.min("row_no").alias("since"))
    title = F.concat(F.lit(UNTITLED + " "), column_letters(F.col("col")))
    return found.withColumn("title", title).withColumn("title_norm", folded(title)).withColumn("occurrence", F.lit(1))


@F.pandas_udf(T.StringType())
def _family(names: pd.Series) -> pd.Series:
    """Names that can clash share this key: numbering adds only a trailing `` [n]``."""
    return names.map(lambda name: re.sub(r"( \[\d+\])+$", "", name.casefold()))


def extra_names(columns: DataFrame, cfg: JobConfig) -> DataFrame:
    """Output names of unmatched columns: one per group, title and occurrence, worded as first
    seen. The input has one row per header cell, and it is reduced to distinct titles first."""
    seen = F.struct("file_ord", "sheet_ord", "at_row", "col", "title")
    distinct = columns.groupBy("group", "title_norm", "occurrence").agg(F.min(seen).alias("seen"))
    shown = F.coalesce(F.nullif(strip(F.col("seen.title")), F.lit("")), F.lit(UNTITLED))
    named = distinct.withColumn("base", F.substring(F.concat(F.lit(cfg.extra_prefix), shown), 1, 180))
    order = Window.partitionBy("group", "family").orderBy("seen")
    named = named.withColumn("family", _family("base")).withColumn("place", F.row_number().over(order))
    taken = {name.casefold() for name in cfg.names}

    def number(names: pd.DataFrame) -> pd.DataFrame:
        used, result = set(taken), []
        for base in names.sort_values("place")["base"]:
            name, n = base, 1
            while name.casefold() in used:
                n += 1
                name = f"{base} [{n}]"
            used.add(name.casefold())
            result.append(name)
        names = names.sort_values("place")
        return names.assign(name=result)[["group", "title_norm", "occurrence", "name", "base"]]

    schema = "group string, title_norm string, occurrence int, name string, base string"
    narrow = named.select("group", "title_norm", "occurrence", "base", "family", "place")
    first = named.select("group", "title_norm", "occurrence", F.col("seen").alias("first_seen"))
    numbered = narrow.groupBy("group", "family").applyInPandas(number, schema).drop("base")
    return numbered.join(first, ["group", "title_norm", "occurrence"])


def directory(segment: DataFrame, payload: DataFrame) -> DataFrame:
    """Segments spread over the row blocks they touch, so that rows join on sheet *and* block: a
    sheet of any length is split, and a row meets only the headers near it."""
    first, last = block_of(F.col("header_row")), block_of(F.col("end_row") - 1)
    return segment.join(payload, HEADER, "left").withColumn("block", F.explode(F.sequence(first, last)))


def place_rows(grid: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every row below a header with the segment that rules it. Headers and what lies above the
    first one drop out."""
    row = F.col("row_no")
    rows = grid.withColumns({"chunk": chunk_of(row), "block": block_of(row)}).drop("group", "file_ord", "sheet_ord")
    below = (row >= F.col("header_row") + F.col("height")) & (row < F.col("end_row"))
    return rows.join(catalogue, [*SHEET, "block"]).where(below)


def segment_mapping(columns: DataFrame, cfg: JobConfig) -> DataFrame:
    """Per header the ordered list ``array<struct<since, col, target, until>>`` and, per required
    name, the columns that answer to it. A list is as long as the header is wide."""
    later = Window.partitionBy(*HEADER, "output").orderBy("since", "col")
    entries = columns.withColumn("until", F.lead("since").over(later))
    item = F.struct("since", "col", F.col("output").alias("target"), "until")
    lists = [F.array_sort(F.collect_list(item)).alias("mapping")]
    for i, name in enumerate(cfg.required_columns):
        answers = F.array_contains(F.array("title_norm", "raw_norm", "output_norm"), fold_label(name))
        lists.append(F.collect_list(F.when(answers & (F.col("since") == 0), F.col("col"))).alias(f"required_{i}"))
    return entries.groupBy(*HEADER).agg(*lists)


def named_cells(cells: Column, formats: Column, mapping: Column, row: Column, clean) -> Column:
    """A physical row as ``array<struct<k, c>>``. Where two columns feed one name, the later wins."""
    live = F.filter(
        mapping, lambda m: (m["since"] <= row) & (m["until"].isNull() | (m["until"] > row))
    )
    return F.transform(
        live,
        lambda m: F.struct(
            m["target"].alias("k"), clean(F.get(cells, m["col"]), F.get(formats, m["col"])).alias("c")
        ),
    )
