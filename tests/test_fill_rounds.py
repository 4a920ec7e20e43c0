"""Fill-down under rules that read filled values: row by row, and by rounds over runs."""

from __future__ import annotations

import os
import random
from dataclasses import replace

from gridwork.config import JobConfig
from gridwork.operators import rows as rules
from gridwork.plans import harmonize as plan
from gridwork.session import checkpoint_dir
from gridtools import grid, sheet, value

CONFIG = replace(
    JobConfig(), fill_down=("Entity", "Panel"), min_row_values=3, drop_duplicates=True, dedup_keys=("Entity", "Panel", "Reviewer Name"), require_any=("No.",)
)
TITLES = ["No.", "Entity", "Panel", "Reviewer Name"]


def _row_by_row(sheets):
    """(file, row number, entity, panel) of the records, one row after the other."""
    marks, records = set(), []
    for name, lines in sheets:
        entity = panel = None
        for n, (number, own_entity, own_panel, reviewer) in lines:
            here = (own_entity or entity, own_panel or panel, reviewer)
            found = sum(x is not None for x in (number, *here))
            good = number is not None and number != "Total" and found >= 3 and here not in marks
            if (number, own_entity, own_panel, reviewer) == (None,) * 4 or not good:
                entity = panel = None
                continue
            marks.add(here)
            entity, panel = here[:2]
            records.append((name, n, *here[:2]))
    return records


def test_rounds_take_up_fewer_and_fewer_rows(spark, monkeypatch):
    rng = random.Random(5)
    sheets = []
    for name in ("a.xlsx", "b.xlsx"):
        lines = []
        for n in range(13, 413):
            own = [n if rng.random() < 0.95 else "Total", rng.choice([None, None, None, "E1", "E2"]), rng.choice([None, None, "P"]), rng.choice([None, "R1", "R2", f"R{n}"])]
            lines.append((n, [None] * 4 if rng.random() < 0.08 else own))
        sheets.append((name, lines))
    tables = [sheet([TITLES, *[row for _, row in lines]], file=name, first=12) for name, lines in sheets]
    taken_up = []
    monkeypatch.setattr(plan, "judge_rows", lambda rows, cfg: rules.judge_rows(rows, cfg, taken_up))
    result = plan.harmonize(grid(spark, *tables), CONFIG)
    got = [(r.file, r.row_no, value(r, "Entity"), value(r, "Panel")) for r in result.record.collect()]
    assert sorted(got, key=lambda r: r[:2]) == _row_by_row(sheets)
    assert taken_up[0] == 802 - 2 and len(taken_up) > 2
    # After the first round only runs with a changed verdict, and rows like them, are looked at.
    assert taken_up[-1] < taken_up[1] < taken_up[0]


def test_one_sheet_takes_few_rounds_however_long_its_chains_are(spark, monkeypatch):
    rng = random.Random(7)
    lines = [(n, [n, rng.choice([None, "E1", "E2"]), rng.choice([None, None, "P1", "P2"]), rng.choice([None, "R1", "R2", f"R{n}"])]) for n in range(13, 133)]
    taken_up = []
    monkeypatch.setattr(plan, "judge_rows", lambda rows, cfg: rules.judge_rows(rows, cfg, taken_up))
    result = plan.harmonize(grid(spark, sheet([TITLES, *[row for _, row in lines]], first=12)), CONFIG)
    got = sorted((r.row_no, value(r, "Entity"), value(r, "Panel")) for r in result.record.collect())
    assert got == [row[1:] for row in _row_by_row([("", lines)])]
    # Verdicts hang on each other row by row in one run without a blank row.
    assert taken_up[0] == 120 and len(taken_up) <= 3


def test_rounds_leave_only_their_result_on_disk(spark, monkeypatch):
    rng = random.Random(11)
    lines = [(n, [n, rng.choice([None, "E1", "E2"]), rng.choice([None, None, "P1", "P2"]), rng.choice([None, "R1", "R2", f"R{n}"])]) for n in range(13, 53)]
    folder = checkpoint_dir(spark).removeprefix("file:")
    sizes, left = [], []

    def judged(rows, cfg):
        before = set(os.listdir(folder))
        out = rules.judge_rows(rows, cfg, sizes)
        left.extend(set(os.listdir(folder)) - before)
        return out

    monkeypatch.setattr(plan, "judge_rows", judged)
    monkeypatch.setattr("gridwork.operators.ordered.CHUNK_ROWS", 20)
    result = plan.harmonize(grid(spark, sheet([TITLES, *[row for _, row in lines]], first=12)), CONFIG)
    got = sorted((r.row_no, value(r, "Entity"), value(r, "Panel")) for r in result.record.collect())
    assert got == [row[1:] for row in _row_by_row([("", lines)])]
    # Besides checkpoints of pieces, only what was chosen for each row.
    assert len(sizes) > 1 and [name.split("-")[0] for name in left if not name.startswith("rdd-")] == ["chosen"]
