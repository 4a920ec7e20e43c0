"""Titles, headers and row rules against tables written by hand from the rules."""

import random
from dataclasses import replace

import pytest
from gridtools import MISSING, grid, sheet

from gridwork.config import ColumnSpec, JobConfig, Workflow
from gridwork.operators import ordered
from gridwork.operators.headers import accepted_headers, find_headers, header_candidates
from gridwork.operators.matching import score_titles
from gridwork.plans.harmonize import harmonize

CFG = JobConfig()

# raw title, label it is known by, target, score. The score is 100 for equal letters, else 200 * common
# characters / all characters of the title and its closest alias, without blanks or with sorted words.
TITLES = [
    ("Panel", "Panel", "Panel", 100.0),
    ("panel adı", "panel adı", "Panel", 100.0),
    ("Panell", "Panell", "Panel", 90.91),  # panell, panel: 2 * 5 / 11
    ("Entityy", "Entityy", "Entity", 92.31),  # entityy, entity: 2 * 6 / 13
    ("Numarra", "Numarra", "No.", 92.31),  # numarra, numara: 2 * 6 / 13
    ("Reviewer Nam", "Reviewer Nam", "Reviewer Name", 96.0),  # nam reviewer, name reviewer: 2 * 12 / 25
    ("Open - Closed", "Open - Closed", "Open / Closed", 100.0),
    ("DEĞERLENDİREN", "DEĞERLENDİREN", "Reviewer Name", 100.0),
    ("ATAX", "ATAX", None, 66.67),  # ata is too short for likeness; atax, atano: 2 * 3 / 9
    ("No", "No", "No.", 100.0),
    ("Nu", "Nu", None, 0.0),
    ("***", "***", None, 0.0),
    # of several lines the first, the first two and so on are tried; the longest that is equal wins
    ("Panel\nexplained in the notes", "Panel", "Panel", 100.0),
    ("Reviewer\nName", "Reviewer Name", "Reviewer Name", 100.0),
    ("Reviewer\r\nsince 2020", "Reviewer", "Reviewer Name", 100.0),
]


def test_titles(spark):
    found = score_titles(spark.createDataFrame([(t[0],) for t in TITLES], "raw string"), CFG, True).collect()
    got = {r["raw"]: (r["raw"], r["label"], r["target"], r["score"]) for r in found}
    assert [got[t[0]] for t in TITLES] == TITLES


def test_two_targets_equally_near_are_none(spark):
    cfg = replace(CFG, schema=(ColumnSpec("Total price"), ColumnSpec("Total prize"), ColumnSpec("Remark")), header_anchors=(), require_any=(),
                  min_header_anchors=0, id_column=None, workflow=Workflow(enabled=False))
    rows = {r["raw"]: r for r in score_titles(spark.createDataFrame([("Total prixe",), ("Total pricee",)], "raw string"), cfg, True).collect()}
    near = rows["Total prixe"]  # prixe total has "pri" and "e total" in common with either: 2 * 10 / 22
    assert (near["target"], near["score"], near["margin"]) == (None, 90.91, 0.0)
    better = rows["Total pricee"]  # pricee total: 2 * 11 / 23 against 2 * 10 / 23
    assert (better["target"], better["score"], better["margin"]) == ("Total price", 95.65, 8.7)
    loose = replace(cfg, margin=10.0)
    assert score_titles(spark.createDataFrame([("Total pricee",)], "raw string"), loose, True).first()["target"] is None


# The rows of a sheet, and what each of them is as a header: height and columns.
HEADERS = [
    ([["No.", "Entity", "Panel"], [1, "E1", "P1"]], {1: (1, {"No.": 0, "Entity": 1, "Panel": 2})}),
    # two targets are too few
    ([["No.", "Entity", "Remark"]], {}),
    # of two equal titles the left one counts
    ([["Panel", "No.", "Entity", "Panel"]], {1: (1, {"Panel": 0, "No.": 1, "Entity": 2})}),
    # the lower row completes a title, so both rows are the header
    ([["No", "Reviewer", "Panel"], [None, "Name", None]], {1: (2, {"No.": 0, "Reviewer Name": 1, "Panel": 2})}),
    # the lower row adds nothing
    ([["No.", "Entity", "Panel"], ["x", "y", "z"]], {1: (1, {"No.": 0, "Entity": 1, "Panel": 2})}),
    # only both rows together have three targets
    ([["No.", "Entity", "Item"], [None, None, "Number"], [None, "ATA", "Panel"]], {}),
    ([["No.", "Entity", None], [None, None, "Panel"]], {1: (2, {"No.": 0, "Entity": 1, "Panel": 2})}),
]


def test_headers(spark):
    sheets = [sheet(rows, name=f"s{i}") for i, (rows, _) in enumerate(HEADERS)]
    found = {i: {} for i in range(len(HEADERS))}
    for r in header_candidates(grid(spark, *sheets), CFG).collect():
        found[int(r["sheet"][1:])][r["row_no"]] = (r["height"], {w["target"]: w["col"] for w in r["winners"]})
    assert found == {i: expected for i, (_, expected) in enumerate(HEADERS)}


def test_header_search_looks_at_few_rows_and_finds_all(spark):
    """Against the search over all rows; some sheets move the id column at a repeated header."""
    rng = random.Random(8)
    cfg = replace(CFG, expected_header_row=2, search_end=4)
    layouts = [["No.", "Entity", "Panel", "İnceleyen"], ["Panel", "No.", "Entity", "ş"], ["Sıra No", "Varlık", "Pannel", None]]
    sheets = []
    for s in range(14):
        rows = [["note"] if rng.random() < 0.5 else [None], layouts[s % 2 * 2]]
        for n in range(30):
            kind = rng.random()
            if kind < 0.06:
                rows.append(rng.choice(layouts if s % 3 == 0 else [layouts[s % 2 * 2]]))
            elif kind < 0.12:
                rows.append([rng.choice([None, "Ek", "total"]), "Entity", "Panel", "No."])
            else:
                rows.append([n + 1, rng.choice(["Entity", "E1", 7]), rng.choice(["P", 12, "Panel"]), rng.choice(["Ayşe", None])])
        sheets.append(sheet(rows, name=f"s{s}"))
    data = grid(spark, *sheets)
    shown = lambda df: sorted((r["sheet"], r["row_no"], r["height"], r["id_col"], str(r["winners"])) for r in df.collect())
    expected = shown(accepted_headers(header_candidates(data, cfg), cfg))
    assert shown(find_headers(data, cfg)) == expected and len(expected) > 20


NAMES = ["No.", "Entity", "Panel", "Reviewer Name"]
ROWS = [
    [1, "E1", "P1", "Ada"],  # 2
    [2, None, None, "Ali"],  # 3
    ["001", " ", "", None],  # 4
    [None, " ", None, None],  # 5, blank
    [3, None, None, None],  # 6
    ["total", "E9", "P9", None],  # 7, footer
    [4, None, "P2", None],  # 8
    [MISSING, None, None, None],  # 9
    ["x9", "E2", 0, False],  # 10
    [1, "E1", "P1", "Ada"],  # 11
    ["1", "E1", "P1", "Ada"],  # 12
]
FEW, EMPTY_RESULT, FOOTER, KEY, COPY = "AZ_DOLU_ALAN", "FORMÜL_SONUCU_YOK", "ALT_BİLGİ/TOPLAM", "KAYIT_NO_BİÇİMİ", "TEKRAR_KAYIT"

# Rules, and for each row the reason it is set aside for or the values it is kept with. Blank rows are
# neither; what they or rejected rows hold is not filled down.
RULES = [
    (
        dict(fill_down=("Entity", "Panel"), min_row_values=3),
        {
            2: ["1", "E1", "P1", "Ada"], 3: ["2", "E1", "P1", "Ali"], 4: ["001", "E1", "P1", None], 6: FEW, 7: FOOTER, 8: FEW,
            9: EMPTY_RESULT, 10: ["x9", "E2", "0", "False"], 11: ["1", "E1", "P1", "Ada"], 12: ["1", "E1", "P1", "Ada"],
        },
    ),
    (
        dict(min_row_values=2, id_regex="[0-9]+", drop_duplicates=True),
        {2: ["1", "E1", "P1", "Ada"], 3: ["2", None, None, "Ali"], 4: FEW, 6: FEW, 7: FOOTER, 8: ["4", None, "P2", None], 9: EMPTY_RESULT, 10: KEY, 11: COPY, 12: ["1", "E1", "P1", "Ada"]},
    ),
    (
        dict(fill_down=("Entity",), min_row_values=2, drop_duplicates=True, dedup_keys=("Entity", "Panel")),
        {
            # no cell and a blank text are different values of a key
            2: ["1", "E1", "P1", "Ada"], 3: ["2", "E1", None, "Ali"], 4: ["001", "E1", None, None], 6: FEW, 7: FOOTER, 8: ["4", None, "P2", None],
            9: EMPTY_RESULT, 10: ["x9", "E2", "0", "False"], 11: COPY, 12: COPY,
        },
    ),
    (
        dict(required_columns=("Reviewer Name", "Entity"), min_row_values=2),
        {2: ["1", "E1", "P1", "Ada"], 3: "ZORUNLU_ALAN_BOŞ: Entity", 4: "ZORUNLU_ALAN_BOŞ: Reviewer Name", 6: "ZORUNLU_ALAN_BOŞ: Reviewer Name",
         7: "ZORUNLU_ALAN_BOŞ: Reviewer Name", 8: "ZORUNLU_ALAN_BOŞ: Reviewer Name", 9: "ZORUNLU_ALAN_BOŞ: Reviewer Name",
         10: ["x9", "E2", "0", "False"], 11: ["1", "E1", "P1", "Ada"], 12: ["1", "E1", "P1", "Ada"]},
    ),
]


@pytest.mark.parametrize("case", range(len(RULES)))
@pytest.mark.parametrize("chunk", [3, 100_000])
def test_row_rules(spark, monkeypatch, case, chunk):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", chunk)
    rules, expected = RULES[case]
    cfg = replace(CFG, expected_header_row=1, search_end=1, header_heights=(1,), **rules)
    result = harmonize(grid(spark, sheet([NAMES, *ROWS], file="f.xlsx")), cfg)
    got = {}
    for r in result.record.collect():
        values = {k: v["v"] if v else None for k, v in r["values"].items()}
        got[r["row_no"]] = [None if (values.get(n) or "").strip() == "" else values[n] for n in NAMES]
    got |= {r["row_no"]: r["reason"] for r in result.quarantine.collect()}
    assert got == expected
