"""Row rules: fill-down, verdicts, duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwork.config import JobConfig
from gridwork.functions.cells import clean_cell, fingerprint, nonempty, null_cell, usable
from gridwork.functions.labels import fold_label, folds_to_one_of
from gridwork.operators.headers import ROW, SHEET
from gridwork.operators.mapping import named_cells
from gridwork.operators.ordered import BEFORE, last_before
from gridwork.session import Scratch, broadcast_if_small, computed_once, settle

FACTS = ["n_usable", "first_usable", "any_filled", "any_key", "id_cell"]

# Reasons a row is set aside.
REQUIRED_EMPTY = "ZORUNLU_ALAN_BOŞ: "
NO_RESULT, BLANK = "FORMÜL_SONUCU_YOK", "BOŞ"
FOOTER = "ALT_BİLGİ/TOPLAM"
TOO_FEW = "AZ_DOLU_ALAN"
NO_KEY = "ANAHTAR_ALAN_YOK"
BAD_ID = "KAYIT_NO_BİÇİMİ"
DUPLICATE = "TEKRAR_KAYIT"


def cell_of(entries: Column, name: str) -> Column:
    """The named cell of a row, NULL if the row has no such column."""
    return F.get(F.filter(entries, lambda e: e["k"] == name), F.lit(0))["c"]


def name_cells(placed: DataFrame, cfg: JobConfig) -> DataFrame:
    """Adds the named cells, whether the row is blank, and the first required column it lacks."""

    def clean(cell: Column, fmt: Column) -> Column:
        return clean_cell(cell, fmt, cfg.trim_text, cfg.keep_zero_formats)

    cells, formats = F.col("cells"), F.col("formats")
    rows = placed.withColumn("entries", named_cells(cells, formats, F.col("mapping"), F.col("row_no"), clean))
    rows = rows.withColumn("blank", ~F.exists("cells", nonempty))
    lacking = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(cfg.required_columns))):
        filled = F.exists(f"required_{i}", lambda col: usable(clean(F.get(cells, col), F.get(formats, col))))
        lacking = F.when(filled, lacking).otherwise(REQUIRED_EMPTY + name)
    return rows.withColumn("lacking", F.when(~F.col("blank"), lacking))


def _facts(rows: DataFrame, cfg: JobConfig) -> DataFrame:
    """What the rules read of a row's own cells, as a few narrow columns."""
    entries = F.col("entries")
    usable_at = F.filter(
        F.transform(entries, lambda e, i: F.when(usable(e["c"]), F.struct(i.alias("at"), e["c"]["v"].alias("text")))),
        lambda u: u.isNotNull(),
    )
    keys = F.array(*[F.lit(k) for k in cfg.require_any]).cast("array<string>")
    rows = rows.withColumn("_usable", usable_at)
    rows = rows.withColumn("n_usable", F.size("_usable")).withColumn("first_usable", F.get("_usable", F.lit(0)))
    rows = rows.withColumn("any_filled", F.exists(entries, lambda e: nonempty(e["c"])))
    rows = rows.withColumn(
        "any_key", F.exists(entries, lambda e: F.array_contains(keys, e["k"]) & usable(e["c"]))
    )
    id_cell = null_cell() if cfg.id_column is None else cell_of(entries, cfg.id_column)
    return rows.withColumn("id_cell", id_cell).drop("_usable")


def _reason(cfg: JobConfig, facts: dict[str, Column]) -> Column:
    """The first rule a row breaks, NULL for a good or a blank row."""
    id_cell, id_usable = facts["id_cell"], usable(facts["id_cell"])
    first_text = facts["first_usable"]["text"]
    probe = first_text if cfg.id_column is None else F.when(id_usable, id_cell["v"]).otherwise(first_text)
    footers = [fold_label(label) for label in cfg.footer_labels]
    # A text keeps its ASCII letters and digits when folded, so a long one cannot become a footer label.
    longest = max((len(label) for label in footers), default=0)
    short = F.length(F.regexp_replace(probe, "[^A-Za-z0-9]", "")) <= longest
    is_footer = F.coalesce(short & folds_to_one_of(probe, footers), F.lit(False))
    n_usable = facts["n_usable"]
    reason = F.when(F.col("lacking").isNotNull(), F.col("lacking"))
    reason = reason.when(n_usable == 0, F.when(facts["any_filled"], NO_RESULT).otherwise(BLANK))
    reason = reason.when(is_footer, FOOTER).when(n_usable < cfg.min_row_values, TOO_FEW)
    if cfg.require_any:
        reason = reason.when(~facts["any_key"], NO_KEY)
    if cfg.id_regex:
        id_text = F.col("row_no").cast("string") if cfg.id_column is None else F.coalesce(id_cell["v"], F.lit("None"))
        reason = reason.when(~id_text.rlike(rf"^(?:{cfg.id_regex})\z"), BAD_ID)
    return F.when(~F.col("blank"), reason)


def later_copies(rows: DataFrame, scope: str = "group", mark: str = "mark") -> DataFrame:
    """Ids of rows whose ``mark`` occurred earlier in ``scope``, first in source order kept.

    The firsts come from an aggregation that combines before the shuffle, and they are taken off
    by row id, so thousands of copies of one row never meet in one task.
    """
    place = F.struct("file_ord", "sheet_ord", "row_no", "file", "sheet")
    firsts = rows.groupBy(scope, mark).agg(F.min(place).alias("first"))
    firsts = firsts.select("first.file", "first.sheet", "first.row_no")
    return rows.select(*ROW).join(firsts, ROW, "left_anti")


def judge_rows(rows: DataFrame, cfg: JobConfig, taken_up: list[int] | None = None) -> DataFrame:
    """Named rows with their ``reason``; blank rows are gone. Fill-down is applied on the way; ``taken_up``
    then gets the number of rows that each of its rounds judged."""
    if cfg.fill_down:
        rows = _judge_filled(rows, cfg, taken_up)
        return rows.where(~F.col("blank")).drop("blank", "lacking")
    filled = rows.where(~F.col("blank"))
    judged = _facts(filled, cfg).withColumn("reason", computed_once(_reason(cfg, {f: F.col(f) for f in FACTS})))
    if not cfg.drop_duplicates:
        return judged.drop(*FACTS, "blank", "lacking")
    # Rows are judged once, into a narrow table; only the rejected ones come back to their cells.
    good = F.col("reason").isNull()
    mark = F.when(good, fingerprint(F.col("entries"), cfg.dedup_keys)).alias("mark")
    narrow = settle(judged.select("group", *ROW, "file_ord", "sheet_ord", "reason", mark))
    copies = later_copies(narrow.where(good)).withColumn("reason", F.lit(DUPLICATE))
    rejected = settle(narrow.where(~good).select(*ROW, "reason").unionByName(copies.select(*ROW, "reason")))
    return filled.join(broadcast_if_small(rejected), ROW, "left").drop("blank", "lacking")


# A mark is stored for each row, so it has as many bytes as tell any number of rows apart.
MARK_BYTES = 16
# The part of a run that lies in one chunk.
PIECE = ["file", "sheet", "chunk", "run"]
PLACE = ["file_ord", "sheet_ord", "row_no", "file", "sheet"]
CASE = ["group", *PLACE, "chunk", "run", "case", "good", "mark"]


def _judge_filled(rows: DataFrame, cfg: JobConfig, taken_up: list[int] | None = None) -> DataFrame:
    """Fill-down and verdicts together.

    A row is filled from the accepted rows above it, and whether a row is accepted depends on its filled
    values. Blank rows, headers and rows without a required value stop filling whatever is filled, so between
    them lie runs that don't fill each other. What a row is filled with depends only on where the last row
    above it was rejected, and as few cases differ as there are filled columns and one: all are judged
    beforehand, and going down a chunk picks one case per row. The first round knows no copies outside the
    chunk's rows that it goes through. Each further round takes up only the pieces of runs that hold a row
    whose verdict on copies, or whose last rejected row before the chunk, has turned out to be another. The
    first wrong row is right after every round and no row before it changes, so what no longer changes is the
    result of going row by row. ``taken_up`` gets the rows of each round.
    """
    fills = list(cfg.fill_down)
    scratch = Scratch()
    choices = scratch.keep(_choices(rows, fills, cfg), "choices")
    pieces = choices.select(*PIECE).distinct()
    across = Window.partitionBy("file", "sheet", "run")
    spans = settle(pieces.withColumn("n", F.count(F.lit(1)).over(across)).where("n > 1").drop("n"))
    alone = choices.withColumns({"known": F.lit(False), "entry": F.col("run")})
    base = state = scratch.keep(_walk(alone, local_copies=False), "walked")
    sizes = [base.count()] if taken_up is not None else []
    delta, touched = None, None
    while True:
        # Of the round before, only what has been judged again and the marks that have come or gone are read.
        scratch.drop_but(choices, base, delta, touched)
        wrong = _wrong_copies(state, touched, scratch) if cfg.drop_duplicates else None
        entries = _entries(state, spans)
        moved = state.join(broadcast_if_small(entries), PIECE).where("entry <> new_entry").select(*PIECE)
        wrong = moved if wrong is None else wrong.union(moved)
        wrong = settle(wrong.distinct())
        if wrong.isEmpty():
            break
        wrong_ = broadcast_if_small(wrong)
        again = choices.select(*CASE).join(wrong_, PIECE, "left_semi").join(broadcast_if_small(entries), PIECE, "left")
        again = again.withColumn("entry", F.coalesce("new_entry", "run")).drop("new_entry")
        if cfg.drop_duplicates:
            again = _known_copies(scratch.keep(again, "again"), state, wrong_, scratch)
        else:
            again = again.withColumn("known", F.lit(False))
        step = scratch.keep(_walk(again, local_copies=cfg.drop_duplicates), "step")
        if taken_up is not None:
            sizes.append(step.count())
        before = state.join(wrong_, PIECE, "left_semi").select(*ROW, F.col("mark").alias("was"))
        turned = step.join(before, ROW).where(~F.col("mark").eqNullSafe(F.col("was")))
        marks = turned.select("group", F.explode(F.array("mark", "was")).alias("mark")).where("mark IS NOT NULL").distinct()
        touched = scratch.keep(marks, "touched")
        # What has been judged again stands for itself; the rest is as the first round left it.
        delta = step if delta is None else scratch.keep(step.unionByName(delta.join(wrong_, PIECE, "left_anti")), "delta")
        fresh = broadcast_if_small(settle(delta.select(*PIECE).distinct()))
        state = base.join(fresh, PIECE, "left_anti").unionByName(delta)
    if taken_up is not None:
        taken_up.extend(sizes)
    filled = [f"filled_{i}" for i in range(len(fills))]
    reason = F.when(F.col("copy"), DUPLICATE).otherwise(F.col("reason")).alias("reason")
    chosen = state.select(*ROW, "case", "copy").join(choices.select(*ROW, "case", "reason", *filled), [*ROW, "case"])
    chosen = scratch.keep(chosen.select(*ROW, reason, *filled), "chosen")
    scratch.drop_but(chosen)
    joined = rows.join(chosen, ROW)

    def cell(e: Column) -> Column:
        value = e["c"]
        for i, name in enumerate(fills):
            value = F.when(e["k"] == name, F.col(f"filled_{i}")).otherwise(value)
        return F.struct(e["k"].alias("k"), value.alias("c"))

    return joined.withColumn("entries", F.transform("entries", cell)).drop(*filled)


def _choices(rows: DataFrame, fills: list[str], cfg: JobConfig) -> DataFrame:
    """Each row once per case: filled cells, first rule broken and, where copies are dropped, the ``mark`` that
    tells good rows apart, if the last rejected row above it is at ``case`` or later, but before the next case.
    """
    names = F.transform("entries", lambda e: e["k"])
    own = _facts(rows, cfg)
    for i, name in enumerate(fills):
        own = own.withColumn(f"own_{i}", cell_of(F.col("entries"), name))
        own = own.withColumn(f"at_{i}", F.array_position(names, name))
    keyed = F.filter("entries", lambda e: ~e["k"].isin(fills))
    fixed_keys = tuple(k for k in cfg.dedup_keys if k not in fills)
    skip_rest = bool(cfg.dedup_keys) and not fixed_keys
    rest = F.lit("") if skip_rest or not cfg.drop_duplicates else fingerprint(keyed, fixed_keys)
    cells = [c for i in range(len(fills)) for c in (f"own_{i}", f"at_{i}")]
    narrow = own.select(
        "group", *ROW, "chunk", "file_ord", "sheet_ord", "header_row", "blank", "lacking", *FACTS, *cells, rest.alias("rest")
    )
    stop = F.col("blank") | F.col("lacking").isNotNull()
    values = {"stop": F.when(stop, F.lit(True))}
    for i in range(len(fills)):
        values[f"fill_{i}"] = F.when(nonempty(F.col(f"own_{i}")) & ~stop, F.col(f"own_{i}"))
    seen = last_before(narrow, SHEET, "chunk", "row_no", values)
    seen = seen.withColumn("run", F.greatest(F.coalesce("stop_before.at", F.lit(-1)), "header_row").cast("long"))
    cases = [F.col("run")]
    for i in range(len(fills)):
        mapped = F.col(f"at_{i}") > 0
        open_ = mapped & ~nonempty(F.col(f"own_{i}")) & F.col("lacking").isNull() & ~F.col("blank")
        source = F.when(open_ & (F.col(f"fill_{i}_before.at") > F.col("run")), F.col(f"fill_{i}_before.at"))
        seen = seen.withColumn(f"_from_{i}", source)
        cases.append(F.col(f"_from_{i}"))
    seen = seen.withColumn("case", F.explode(F.array_compact(F.array_distinct(F.array(*cases)))))
    n_usable, any_key, first = F.col("n_usable"), F.col("any_key"), F.col("first_usable")
    any_filled, id_cell = F.col("any_filled"), F.col("id_cell")
    for i, name in enumerate(fills):
        takes = F.coalesce(F.col(f"_from_{i}") > F.col("case"), F.lit(False))
        seen = seen.withColumn(f"_got_{i}", takes)
        seen = seen.withColumn(f"filled_{i}", F.when(F.col(f"_got_{i}"), F.col(f"fill_{i}_before.value")).otherwise(F.col(f"own_{i}")))
        value, got = F.col(f"filled_{i}"), F.col(f"_got_{i}")
        n_usable = n_usable + (got & usable(value)).cast("int")
        any_filled = any_filled | got
        if name in cfg.require_any:
            any_key = any_key | (got & usable(value))
        if name == cfg.id_column:
            id_cell = value
        here = F.struct((F.col(f"at_{i}").cast("int") - 1).alias("at"), value["v"].alias("text"))
        first = F.least(first, F.when(got & usable(value), here))
    facts = dict(n_usable=n_usable, first_usable=first, any_filled=any_filled, any_key=any_key, id_cell=id_cell)
    judged = seen.withColumn("reason", computed_once(_reason(cfg, facts)))
    judged = judged.withColumn("good", F.col("reason").isNull() & ~F.col("blank"))
    mark = F.when(F.col("good"), _mark(fills, cfg)) if cfg.drop_duplicates else F.lit(None).cast("binary")
    filled = [f"filled_{i}" for i in range(len(fills))]
    return judged.select("group", *PLACE, "chunk", "run", "case", "good", "reason", mark.alias("mark"), *filled)


def _mark(fills: list[str], cfg: JobConfig) -> Column:
    listed = [i for i, name in enumerate(fills) if not cfg.dedup_keys or name in cfg.dedup_keys]
    parts = []
    for i in listed:
        value = F.col(f"filled_{i}")
        parts.append(value if cfg.dedup_keys else F.when(nonempty(value), value))
    text = F.to_json(F.struct("rest", *[p.alias(f"f{i}") for i, p in zip(listed, parts)]))
    return F.substring(F.unhex(F.sha2(text, 256)), 1, MARK_BYTES)


def _walk(cases: DataFrame, local_copies: bool) -> DataFrame:
    """One case per row, going down the rows of each chunk. ``known`` says which cases are copies of rows that
    are not walked over here, ``entry`` where the last rejected row before the chunk is."""

    def down(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(["row_no", "case"], ignore_index=True)
        columns = [chunk[c].tolist() for c in ("row_no", "case", "run", "entry", "good", "known", "mark")]
        seen, run, last = set(), None, 0
        picked, copies = [], []
        at, n = 0, len(chunk)
        rows_, cases_, runs, entries, goods, knowns, marks = columns
        while at < n:
            row = rows_[at]
            if runs[at] != run:
                run, last = runs[at], max(runs[at], entries[at])
            here = at
            while at < n and rows_[at] == row:
                if cases_[at] <= last:
                    here = at
                at += 1
            mark = marks[here]
            copy = goods[here] and (knowns[here] or (local_copies and mark in seen))
            if local_copies and goods[here]:
                seen.add(mark)
            if copy or not goods[here]:
                last = row
            picked.append(here)
            copies.append(copy)
        return chunk.iloc[picked].assign(copy=copies)[names]

    kept = ["group", *PLACE, "chunk", "run", "case", "entry", "good", "mark"]
    names = [*kept, "copy"]
    kinds = {f.name: f.dataType.simpleString() for f in cases.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", copy boolean"
    return cases.select(*kept, "known").groupBy("file", "sheet", "chunk").applyInPandas(down, schema)


def _entries(state: DataFrame, spans: DataFrame) -> DataFrame:
    """Where the last rejected row before each piece of a run over several chunks is."""
    stops = F.max(F.when(~F.col("good") | F.col("copy"), F.col("row_no"))).alias("stop")
    lasts = state.join(broadcast_if_small(spans), PIECE, "left_semi").groupBy(*PIECE).agg(stops)
    above = Window.partitionBy("file", "sheet", "run").orderBy("chunk").rowsBetween(*BEFORE)
    return settle(lasts.select(*PIECE, F.coalesce(F.max("stop").over(above), F.col("run")).alias("new_entry")))


def _wrong_copies(state: DataFrame, touched: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Pieces with a row that is taken for a copy and is none, or the other way round; only rows with a
    ``touched`` mark can have become so."""
    marked = state.where(F.col("mark").isNotNull())
    if touched is not None:
        marked = scratch.keep(marked.join(broadcast_if_small(touched), ["group", "mark"], "left_semi"), "marked")
    firsts = marked.groupBy("group", "mark").agg(F.min(F.struct(*PLACE)).alias("first")).select("first.*").select(*ROW, F.lit(True).alias("is_first"))
    told = marked.join(firsts, ROW, "left")
    return told.where(F.col("copy") == F.coalesce("is_first", F.lit(False))).select(*PIECE)


def _known_copies(again: DataFrame, state: DataFrame, pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """Cases with ``known``: an equal row stands before them, in a piece that is not taken up or in an earlier
    chunk. Equal rows of the same chunk that are taken up are met on the way."""
    marks = broadcast_if_small(scratch.keep(again.select("group", "mark").where(F.col("mark").isNotNull()).distinct(), "marks"))
    alike = state.join(marks, ["group", "mark"], "left_semi").join(pieces.withColumn("open", F.lit(True)), PIECE, "left")
    place = F.struct(*PLACE)
    held = F.min(F.when(F.col("open").isNull(), place)).alias("held")
    moving = F.min(F.when(F.col("open"), F.struct(*PLACE, "chunk"))).alias("moving")
    firsts = scratch.keep(alike.groupBy("group", "mark").agg(held, moving), "firsts")
    m = F.col("moving")
    elsewhere = (m["file"] != F.col("file")) | (m["sheet"] != F.col("sheet")) | (m["chunk"] != F.col("chunk"))
    earlier = F.struct(*[m[c].alias(c) for c in PLACE]) < place
    known = F.coalesce(F.col("held") < place, F.lit(False)) | F.coalesce(elsewhere & earlier, F.lit(False))
    return again.join(broadcast_if_small(firsts), ["group", "mark"], "left").withColumn("known", known).drop("held", "moving")
