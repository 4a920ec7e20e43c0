"""Where headers are: candidate rows, the first header of a sheet, repeated headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwork.config import JobConfig
from gridwork.functions.cells import nonempty, strip
from gridwork.functions.labels import compact, first_title, folded
from gridwork.operators.matching import score_titles, title_bound, winners
from gridwork.operators import ordered
from gridwork.operators.ordered import chunk_of, last_before
from gridwork.session import broadcast_if_small, computed_once, settle

SHEET = ["file", "sheet"]
ROW = [*SHEET, "row_no"]


def _row_parts(grid: DataFrame, cfg: JobConfig) -> DataFrame:
    """Rows that can take part in a header, judged by counts of characters alone.

    The filter is exact: a row it drops cannot reach the match thresholds. It keeps nearly all
    data rows out of the title scoring, and it costs two character counts per cell.
    """
    bound = title_bound(cfg)
    parts = F.transform(
        "cells",
        lambda c: F.when(
            nonempty(c), bound.counted(c["v"]).withField("text", F.coalesce(c["t"] == "text", F.lit(False)))
        ),
    )
    rows = grid.select(*ROW, computed_once(parts).alias("parts"))
    possible = F.size(F.filter("parts", lambda p: bound.reaches(p["known"], p["foreign"], p["open"])))
    rows = rows.withColumn("titles_possible", computed_once(possible))
    if 2 in cfg.header_heights:
        return rows.where(F.exists("parts", bound.within))
    return rows.where(F.col("titles_possible") >= cfg.min_header_matches)


def _row_pairs(rows: DataFrame, cfg: JobConfig) -> DataFrame:
    """Consecutive rows whose joined titles can reach enough matches.

    The row below is found inside a chunk of its sheet; the first row of a chunk is also sent to
    the chunk before it. One shuffle, and long sheets are split.
    """
    bound = title_bound(cfg)
    chunk = chunk_of(F.col("row_no"))
    edge = F.col("row_no") % ordered.CHUNK_ROWS == 0
    homes = F.when(edge, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    spread = rows.select(*ROW, "parts", F.explode(homes).alias("chunk"))
    inside = Window.partitionBy(*SHEET, "chunk").orderBy("row_no")
    below = F.lead(F.struct("row_no", "parts")).over(inside)
    paired = spread.withColumn("below", below).where(
        (F.col("below.row_no") == F.col("row_no") + 1) & (chunk_of(F.col("row_no")) == F.col("chunk"))
    )
    paired = paired.select(*ROW, F.col("parts"), F.col("below.parts").alias("lower"))

    def joined(upper: Column, lower: Column) -> Column:
        known = F.coalesce(upper["known"], F.lit(0)) + F.coalesce(lower["known"], F.lit(0))
        foreign = F.coalesce(upper["foreign"], F.lit(0)) + F.coalesce(lower["foreign"], F.lit(0))
        opened = F.coalesce(upper["open"], F.lit(False)) | F.coalesce(lower["open"], F.lit(False))
        same = F.coalesce(
            (upper["raw"] == lower["raw"]) & bound.reaches(upper["known"], upper["foreign"], upper["open"]), F.lit(False)
        )
        return bound.reaches(known, foreign, opened) | same

    def size(part: Column) -> Column:
        return F.coalesce(part["known"] + part["foreign"], F.lit(0))

    def close(upper: Column, lower: Column) -> Column:
        raw = F.concat_ws("", upper["raw"], lower["raw"])
        opened = F.coalesce(upper["open"], F.lit(False)) | F.coalesce(lower["open"], F.lit(False))
        same = (upper["raw"] == lower["raw"]) & bound.reaches_alias(upper["raw"], size(upper))
        return opened | bound.reaches_alias(raw, size(upper) + size(lower)) | F.coalesce(same, F.lit(False))

    enough = cfg.min_header_matches
    for test in (joined, lambda upper, lower: joined(upper, lower) & close(upper, lower)):
        count = F.size(F.filter(F.zip_with("parts", "lower", test), lambda p: p))
        paired = paired.withColumn("likely", computed_once(count)).where(F.col("likely") >= enough)
    return paired.drop("likely")


def _qualified(candidates: DataFrame, cfg: JobConfig) -> DataFrame:
    """Enough targets, enough anchors, all mandatory targets; with the quality of the find."""
    targets = F.transform("winners", lambda w: w["target"])
    anchors = F.array(*[F.lit(a) for a in cfg.header_anchors]).cast("array<string>")
    mandatory = [spec.name for spec in cfg.schema if spec.required]
    found = F.size("winners")
    mean = -F.aggregate("winners", F.lit(0.0), lambda total, w: total + w["loss"]) / found
    distance = F.abs(F.col("row_no") - cfg.expected_header_row)
    keep = (found >= cfg.min_header_matches) & (
        F.size(F.array_intersect(targets, anchors)) >= cfg.min_header_anchors
    )
    for name in mandatory:
        keep = keep & F.array_contains(targets, name)
    quality = 100 * found + mean - 0.2 * distance + 2 * (F.col("height") - 1)
    return candidates.where(keep).withColumn("distance", distance).withColumn("quality", quality)


def _is_number(text: Column) -> Column:
    return strip(text).rlike(r"^[0-9]+(\.[0-9]+)?$")


def _numeric_columns(parts: str) -> Column:
    """Columns of a row that hold a plain number."""
    numbers = F.transform(parts, lambda p, i: F.when(_is_number(p["raw"]), i))
    return F.filter(numbers, lambda i: i.isNotNull())


def _single_row_headers(rows: DataFrame, titles: DataFrame) -> DataFrame:
    cells = rows.select(*ROW, "parts", F.posexplode("parts").alias("col", "part"))
    cells = cells.where(F.col("part").isNotNull()).withColumn("raw", F.col("part.raw"))
    hit = F.struct("col", "target", "score")
    matched = broadcast_if_small(titles.where(F.col("target").isNotNull()).select("raw", "target", "score"))
    # Grouped by row: a list holds the cells of one row.
    found = cells.join(matched, "raw").groupBy(*ROW).agg(
        F.collect_list(hit).alias("hits"), F.first("parts").alias("parts")
    )
    columns = F.transform(
        "parts",
        lambda p, i: F.when(
            p.isNotNull(), F.struct(i.alias("col"), p["raw"].alias("compare"), strip(p["raw"]).alias("raw"))
        ),
    )
    return found.select(
        *ROW,
        F.lit(1).alias("height"),
        winners(F.col("hits")).alias("winners"),
        F.filter(columns, lambda c: c.isNotNull()).alias("titles"),
        _numeric_columns("parts").alias("numeric_cols"),
    )


def _two_row_headers(pairs: DataFrame, titles: DataFrame, cfg: JobConfig) -> DataFrame:
    mode = cfg.text_mode
    both = F.posexplode(F.zip_with("parts", "lower", lambda u, l: F.struct(u.alias("u"), l.alias("l"))))
    cells = pairs.select(*ROW, _numeric_columns("parts").alias("numeric_cols"), both.alias("col", "c")).select(
        *ROW,
        "numeric_cols",
        "col",
        F.col("c.u.raw").alias("upper_raw"),
        F.col("c.l.raw").alias("lower_raw"),
        (F.col("c.u.text") & F.col("c.l.text")).alias("both_text"),
    )
    cells = cells.where(F.col("upper_raw").isNotNull() | F.col("lower_raw").isNotNull())
    for side in ("upper", "lower"):
        known = titles.select(
            F.col("raw").alias(f"{side}_raw"), F.col("label").alias(f"{side}_label"), F.col("target").alias(f"{side}_target")
        )
        cells = cells.join(known, f"{side}_raw", "left")
        own = F.coalesce(F.col(f"{side}_label"), first_title(F.col(f"{side}_raw"), mode))
        cells = cells.withColumn(f"{side}_label", own)
    joined = F.array_join(F.array_distinct(F.array("upper_label", "lower_label")), " ")
    parts = F.array_join(F.array_distinct(F.array(strip(F.col("upper_raw")), strip(F.col("lower_raw")))), " ")
    cells = cells.withColumn("compare", joined).withColumn("shown", parts)
    cells = settle(cells)
    decided = score_titles(cells.select(F.col("compare").alias("raw")).distinct(), cfg, full=False)
    decided = decided.select(F.col("raw").alias("compare"), "target", "score")
    scored = cells.join(decided, "compare", "left")
    # A lower cell that completes a title split over both rows.
    longer = F.length(compact(folded(F.col("compare")))) > F.length(
        compact(F.coalesce(folded(F.col("upper_label")), F.lit("")))
    )
    completes = F.coalesce(F.col("both_text") & longer & (F.col("score") == 100), F.lit(False))
    lower_filled = F.col("lower_raw").isNotNull()
    grouped = scored.withColumn("completes", completes & lower_filled).groupBy(*ROW).agg(
        F.collect_list(F.struct("col", "target", "score", "completes")).alias("hits"),
        F.array_sort(
            F.collect_list(F.struct("col", "compare", F.col("shown").alias("raw")))
        ).alias("titles"),
        F.size(F.collect_set("upper_target")).alias("upper_matches"),
        F.size(F.collect_set("lower_target")).alias("lower_matches"),
        F.count(F.when(lower_filled, 1)).alias("lower_cells"),
        F.first("numeric_cols").alias("numeric_cols"),
    )
    grouped = grouped.withColumn("winners", winners(F.col("hits")))
    won = F.transform("winners", lambda w: w["col"])
    completed = F.size(F.filter("hits", lambda h: h["completes"] & F.array_contains(won, h["col"])))
    better = F.size("winners") > F.greatest("upper_matches", "lower_matches")
    whole = (completed > 0) & (completed == F.col("lower_cells"))
    return grouped.where(better | whole).select(
        *ROW, F.lit(2).alias("height"), "winners", "titles", "numeric_cols"
    )


def header_candidates(grid: DataFrame, cfg: JobConfig) -> DataFrame:
    """Every row that reads like a header, with its best height, in one pass over the grid."""
    rows = _row_parts(grid, cfg)
    single = rows.where(F.col("titles_possible") >= cfg.min_header_matches)
    bound = title_bound(cfg)
    likely = F.filter("parts", lambda p: bound.reaches(p["known"], p["foreign"], p["open"]))
    raws = single.select(F.explode(likely).alias("part"))
    pairs = None
    if 2 in cfg.header_heights:
        pairs = settle(_row_pairs(rows, cfg))
        for side in ("parts", "lower"):
            raws = raws.union(pairs.select(F.explode(side).alias("part")))
    raws = raws.where(F.col("part").isNotNull()).select("part.raw")
    titles = settle(score_titles(raws.distinct(), cfg, full=False))
    kinds = []
    for order, height in enumerate(cfg.header_heights):
        if height == 1:
            found = _single_row_headers(single, titles)
        else:
            found = _two_row_headers(pairs, titles, cfg)
        kinds.append(_qualified(found, cfg).withColumn("preference", F.lit(order)))
    candidates = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
    best = Window.partitionBy(*ROW).orderBy(F.desc("quality"), "preference")
    candidates = candidates.withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    id_cols = F.transform(
        F.filter("winners", lambda w: w["target"] == F.lit(cfg.id_column)), lambda w: w["col"]
    )
    return settle(candidates.withColumn("id_col", F.get(id_cols, F.lit(0))).drop("_rank", "preference"))


def first_headers(candidates: DataFrame, cfg: JobConfig) -> DataFrame:
    """Nearest to the expected row, then best quality, then topmost, inside the search range."""
    reach = candidates.where(F.col("row_no").between(cfg.search_start, cfg.search_end))
    nearest = Window.partitionBy(*SHEET).orderBy("distance", F.desc("quality"), "row_no")
    return reach.withColumn("_rank", F.row_number().over(nearest)).where("_rank = 1").drop("_rank")


def accepted_headers(candidates: DataFrame, cfg: JobConfig) -> DataFrame:
    """The first header of each sheet and every header repeated below it.

    A repeated header counts unless the row is already part of the header above it or its id
    cell, read with the columns of the header above it, is a plain number. What "above" means
    depends on earlier decisions, so they are repeated until none changes; the first undecided
    row is right after every round, and nearly always one round is enough.
    """
    first = first_headers(candidates, cfg).select(*SHEET, F.col("row_no").alias("first_row"))
    heads = candidates.join(first, SHEET).where(F.col("row_no") >= F.col("first_row"))
    heads = heads.withColumn("chunk", chunk_of(F.col("row_no"))).withColumn("accepted", F.lit(True))
    current = settle(heads)
    while True:
        state = F.when(
            F.col("accepted"),
            F.struct((F.col("row_no") + F.col("height")).alias("end"), F.coalesce("id_col", F.lit(-1)).alias("id_col")),
        )
        seen = last_before(current, SHEET, "chunk", "row_no", {"above": state})
        above = F.col("above_before.value")
        numeric_id = F.array_contains("numeric_cols", above["id_col"])
        keep = F.coalesce((F.col("row_no") >= above["end"]) & ~numeric_id, F.lit(True))
        step = settle(seen.withColumn("was", F.col("accepted")).withColumn("accepted", keep).drop("above_before"))
        if step.where(F.col("accepted") != F.col("was")).isEmpty():
            return step.where("accepted").drop("accepted", "was")
        current = step.drop("was")


def _loose_rows(rest: DataFrame, first: DataFrame, cfg: JobConfig) -> DataFrame:
    """Rows below the search range whose id cell, by the first header's id column, is no plain
    number: no other row can be a repeated header as long as that column stays. With headers of
    two rows, the row below each of them comes along."""
    known = rest.join(broadcast_if_small(first), SHEET)
    numeric = F.coalesce(_is_number(F.get("cells", F.col("first_id"))["v"]), F.lit(False))
    loose = known.where(~numeric).drop("first_id")
    if 2 not in cfg.header_heights:
        return loose
    own = settle(loose.select(*ROW))
    needed = own.union(own.select(*SHEET, F.col("row_no") + 1)).distinct()
    return rest.join(broadcast_if_small(needed), ROW, "left_semi")


def find_headers(grid: DataFrame, cfg: JobConfig) -> DataFrame:
    """All accepted headers. The first header of a sheet lies in the search range, which is a filter
    on the scan; below it only rows without a numeric id are looked at. Sheets in which a repeated
    header moves the id column are searched again with all their rows."""
    in_range = F.col("row_no") <= cfg.search_end
    top = header_candidates(grid.where(F.col("row_no") <= cfg.search_end + 1), cfg).where(in_range)
    first = settle(first_headers(top, cfg).select(*SHEET, F.col("id_col").alias("first_id")))
    rest = grid.where(~in_range).join(broadcast_if_small(first.select(*SHEET)), SHEET, "left_semi")
    below = header_candidates(_loose_rows(rest, first, cfg), cfg)
    candidates = settle(top.unionByName(below))
    accepted = accepted_headers(candidates, cfg)
    moved = accepted.join(first, SHEET).where(~F.col("id_col").eqNullSafe(F.col("first_id")))
    moved = settle(moved.select(*SHEET).distinct())
    if moved.isEmpty():
        return accepted
    sheets = broadcast_if_small(moved)
    again = header_candidates(rest.join(sheets, SHEET, "left_semi"), cfg).unionByName(top.join(sheets, SHEET, "left_semi"))
    return accepted.join(sheets, SHEET, "left_anti").unionByName(accepted_headers(settle(again), cfg))
