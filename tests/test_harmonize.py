from dataclasses import replace

import pytest
from gridtools import MISSING, grid, sheet, value

from gridwork.config import DEFAULT_SCHEMA, ColumnSpec, JobConfig
from gridwork.plans.harmonize import harmonize

HEADER = ["No.", "Entity", "Panel", "Custom", "Notes"]
RULES = JobConfig(
    schema=(*DEFAULT_SCHEMA, ColumnSpec("Custom")),
    expected_header_row=1,
    header_heights=(1,),
    min_row_values=1,
    require_any=(),
)


def run(spark, rows, cfg=RULES, header=HEADER):
    return harmonize(grid(spark, sheet([header, *rows])), cfg)


def codes(result):
    return {row["code"] for row in result.event.select("code").distinct().collect()}


def test_repeated_header_is_no_record(spark):
    rows = [["A", "Entity A", "Panel A"], ["No.", "Entity", "Panel"], ["B", "Entity B", "Panel B"]]
    cfg = JobConfig(expected_header_row=1, id_column=None)
    result = run(spark, rows, cfg, ["No.", "Entity", "Panel"])
    records = result.record.orderBy("row_no").collect()
    assert [value(r, "No.") for r in records] == ["A", "B"]
    assert "REPEATED_HEADER" in codes(result)


def test_empty_required_values_are_set_aside(spark):
    rows = [[v, None, None, None, "note", "unnamed"] for v in (None, "", " \t\n", MISSING)]
    result = run(spark, rows, replace(RULES, required_columns=("No.",)))
    assert result.record.count() == 0
    rejected = result.quarantine.orderBy("row_no").collect()
    assert [r["row_no"] for r in rejected] == [2, 3, 4, 5]
    assert {r["reason"] for r in rejected} == {"ZORUNLU_ALAN_BOŞ: No."}
    assert all("unnamed" in r["raw_row"] and "note" in r["mapped_data"] for r in rejected)
    assert rejected[0]["raw_row"] == '[null, null, null, null, "note", "unnamed"]'
    assert rejected[0]["mapped_data"] == (
        '{"No.": null, "Entity": null, "Panel": null, "Custom": null, "Ek | Notes": "note", '
        '"Ek | Başlıksız F": "unnamed"}'
    )
    assert "UNNAMED_COLUMN" in codes(result)


def test_zero_and_false_are_values(spark):
    rows = [[None, None, None, v] for v in ("text", 0, False)]
    result = run(spark, rows, replace(RULES, required_columns=("Custom",)))
    assert [value(r, "Custom") for r in result.record.orderBy("row_no").collect()] == ["text", "0", "False"]
    assert result.quarantine.count() == 0


def test_fill_down_cannot_rescue_a_required_cell(spark):
    rows = [[1, "E", "P"], [2, None, "P"], [3, "F", "P"]]
    result = run(spark, rows, replace(RULES, fill_down=("Entity",), required_columns=("Entity",)))
    assert [r["row_no"] for r in result.record.orderBy("row_no").collect()] == [2, 4]
    assert result.quarantine.first()["reason"] == "ZORUNLU_ALAN_BOŞ: Entity"


def test_required_columns_outside_the_schema(spark):
    rows = [[1, "E", "P", None, "note"], [2, "E", "P"], [None, "E", "P", None, "note"]]
    result = run(spark, rows, replace(RULES, required_columns=("No.", " notes ")))
    assert result.record.count() == 1 and result.quarantine.count() == 2


def test_missing_required_header_comes_before_other_rules(spark):
    result = run(spark, [["total", "E", "P"]], replace(RULES, required_columns=("Missing",)))
    assert result.record.count() == 0
    assert result.quarantine.first()["reason"] == "ZORUNLU_ALAN_BOŞ: Missing"


def test_blank_and_short_rows(spark):
    result = run(spark, [[None, " ", None], [1], [2, "E"]], replace(RULES, min_row_values=2))
    assert result.record.count() == 1
    assert [r["reason"] for r in result.quarantine.collect()] == ["AZ_DOLU_ALAN"]


def test_extra_only_row_is_a_record(spark):
    result = run(spark, [[None, None, None, None, "note"]])
    assert result.record.count() == 1 and result.quarantine.count() == 0


def test_row_number_as_id(spark):
    header = ["No.", "Entity", "Panel"]
    cfg = JobConfig(expected_header_row=11, id_column=None, id_regex="^12$")
    data = sheet([header, ["a", "E", "P"], ["b", "E", "P"], ["total", None, "x"]], first=11)
    result = harmonize(grid(spark, data), cfg)
    assert [r["row_no"] for r in result.record.collect()] == [12]
    assert [r["reason"] for r in result.quarantine.orderBy("row_no").collect()] == [
        "KAYIT_NO_BİÇİMİ",
        "ALT_BİLGİ/TOPLAM",
    ]


def test_two_row_header_and_split_titles(spark):
    rows = [
        ["Item", "Panel", "Reviewer", "Entity"],
        ["Number", None, "Name", None],
        [1, "P1", "Ada", "E1"],
    ]
    cfg = JobConfig(expected_header_row=1)
    result = harmonize(grid(spark, sheet(rows)), cfg)
    header = result.segment.first()
    assert (header["header_row"], header["height"], header["matched"]) == (1, 2, 4)
    record = result.record.first()
    assert record["row_no"] == 3 and value(record, "Reviewer Name") == "Ada" and value(record, "No.") == "1"


def test_header_alias_with_explanation_and_fuzzy_title(spark):
    header = ["No.", "Entitty", "Panel", "Open/Closed\nAçıklama", "My Company\nYanıt yazın", "Notes", "Notes"]
    result = run(spark, [["1", "E", "P", "open", "x", "n1", "n2"]], JobConfig(expected_header_row=1), header)
    mapping = {r["source_column"]: r for r in result.mapping.collect()}
    assert mapping["B"]["state"] == "SEZGİSEL" and mapping["B"]["target"] == "Entity"
    assert mapping["D"]["target"] == "Open / Closed" and mapping["D"]["title"] == "Open/Closed"
    assert mapping["E"]["target"] == "My Company"
    assert [mapping[c]["target"] for c in "FG"] == ["Ek | Notes", "Ek | Notes [2]"]
    assert value(result.record.first(), "Ek | Notes [2]") == "n2"


def test_one_source_column_per_target(spark):
    header = ["No.", "Entity", "Panel", "Entity"]
    result = run(spark, [["1", "E", "P", "E2"]], JobConfig(expected_header_row=1), header)
    states = {r["source_column"]: (r["state"], r["target"]) for r in result.mapping.collect()}
    assert states["B"] == ("TAM", "Entity") and states["D"] == ("ÇAKIŞMA", "Ek | Entity")
    assert "HEADER_REVIEW" in codes(result) and "MISSING_COLUMNS" in codes(result)


def test_sheet_without_header_is_skipped(spark):
    result = harmonize(grid(spark, sheet([["a", "b"], ["c", "d"]])), JobConfig())
    assert result.record.count() == 0
    assert {"HEADER_NOT_FOUND", "NO_DATA"} <= codes(result)


def test_duplicates_keep_the_first_across_files(spark):
    header = ["No.", "Entity", "Panel"]
    one = sheet([header, ["001", "E", "P"], ["001", "E", "P"]], file="a.xlsx")
    two = sheet([header, ["001", "E", "P"], [1, "E", "P"]], file="b.xlsx")
    cfg = JobConfig(expected_header_row=1, drop_duplicates=True)
    result = harmonize(grid(spark, one, two), cfg)
    kept = [(r["file"], r["row_no"]) for r in result.record.orderBy("file", "row_no").collect()]
    assert kept == [("a.xlsx", 2), ("b.xlsx", 3)]
    assert {r["reason"] for r in result.quarantine.collect()} == {"TEKRAR_KAYIT"}


def test_unreadable_files_leave_no_rows(spark):
    header = ["No.", "Entity", "Panel"]
    good = sheet([header, [1, "E", "P"]], file="good.xlsx")
    bad = sheet([header, [2, "E", "P"]], file="bad.xlsx")
    failures = spark.createDataFrame([("Test", "bad.xlsx", None, "broken")], "group string, file string, sheet string, detail string")
    result = harmonize(grid(spark, good, bad), JobConfig(expected_header_row=1), failures=failures)
    assert [r["file"] for r in result.record.collect()] == ["good.xlsx"]
    assert result.event.where("level = 'ERROR'").count() == 1


@pytest.mark.parametrize("change", [dict(min_header_matches=0), dict(required_columns=("",)), dict(group_mode="x")])
def test_bad_settings_are_refused(change):
    with pytest.raises(ValueError):
        replace(JobConfig(), **change).check()
