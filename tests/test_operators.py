from dataclasses import replace

import pytest
from gridtools import MISSING, grid, sheet
from pyspark.sql import functions as F

from gridwork.config import JobConfig, Workflow
from gridwork.functions.cells import MISSING_RESULT
from gridwork.operators import flatten, line_endings, ordered, patterns, profile, sections, stats, worklist
from gridwork.plans.harmonize import extra_columns_of, harmonize, wide
from gridwork.plans.report import run_report
from gridwork.sinks import outputs
from gridwork.sources import listing
from gridwork.sources.grid import group_by_sheet_name, merge_formulas, parse_failures, parse_texts, parsed_grid, text_grid
from gridwork.sources.issues import issue_rows, line_failures
from gridwork.sources.issues import needed_ids, read_issues

HEADER = ["No.", "Entity", "Panel"]
CFG = JobConfig(expected_header_row=1)


def records(spark, rows):
    cell = lambda v: None if v is None else ("int" if type(v) is int else "bool" if type(v) is bool else "text", str(v))
    data = [("g", {k: cell(v) for k, v in row.items()}) for row in rows]
    return spark.createDataFrame(data, "group string, values map<string,struct<t:string,v:string>>")


def flow(spark, rows, settings=Workflow()):
    record = records(spark, rows)
    groups = spark.createDataFrame([("g",), ("empty",)], "group string")
    table = {r["group"]: r for r in stats.workflow_rollup(record, groups, settings).collect()}
    assert all(table["empty"][c] == 0 for c in stats.FLOW_COUNTS)
    assert all(table["g"][c] == table["GENEL TOPLAM"][c] for c in stats.FLOW_COUNTS)
    return {c: table["g"][c] for c in stats.FLOW_COUNTS if table["g"][c]}


def test_workflow_counts(spark):
    opens = ["open", "  OpEn uzun\nclosed daha", "OPEN: x", "openDevam"]
    for company, turn in [(None, "our_company"), ("", "our_company"), (" \t\n", "our_company"), ("x", "other_company"), (0, "other_company"), (False, "other_company")]:
        assert flow(spark, [{"Open / Closed": s, "My Company": company} for s in opens]) == {"open": 4, turn: 4}
    assert flow(spark, [{"Open / Closed": "  CLOSED open"}, {"Open / Closed": "closed", "My Company": "x"}]) == {"closed": 2}
    unknown = [{"Open / Closed": v} for v in (None, "", "pending open", "reopened", 1, MISSING)]
    unknown += [{}, {"Open / Closed": "open"}, {"Open / Closed": "open", "My Company": MISSING}]
    assert flow(spark, unknown) == {"unknown_status": 7, "open": 2, "unknown_turn": 2}
    custom = Workflow("Entity", "Panel", " Aktif ", " Bitti ")
    rows = [{"Entity": "AKTIF", "Panel": None}, {"Entity": "aktif: b", "Panel": "c"}, {"Entity": "bitti"}]
    assert flow(spark, rows, custom) == {"open": 2, "our_company": 1, "other_company": 1, "closed": 1}


@pytest.mark.parametrize("bad", [dict(status_column="x"), dict(company_column="Open / Closed"), dict(open_prefix=" "), dict(open_prefix="CLO"), dict(closed_prefix="op")])
def test_bad_workflow_settings(bad):
    with pytest.raises(ValueError):
        replace(JobConfig(), workflow=replace(Workflow(), **bad)).check()


def test_top_categories(spark):
    counts = spark.createDataFrame([("b", 3), ("A", 3), ("c", 1), (stats.OTHER, 1), ("d", 1)], "label string, count long")
    got = [(r["place"], r["label"], r["count"]) for r in stats.top_categories(counts, 2).orderBy("place").collect()]
    assert got == [(1, "A", 3), (2, "b", 3), (3, stats.OTHER + "*", 3)]
    assert stats.top_categories(counts, 5).count() == 5


def test_report_with_statuses(spark):
    rows = [["No.", "Entity", "Panel", "Open/Closed\nAçıklama", "My Company"], [1, "E", "P", " OpEn: x", None], [2, "E", "P", "OPEN\nclosed", "y"],
            [3, "E", "P", "Closed: x", None], [4, "E", "P", "CLOSED", "y"], [5, "E", "P", "pending open", None],
            [6, "E", "P", "open", MISSING_RESULT + " =A2"], ["total", None, None, "open", None]]
    lost = sheet([["No.", "Entity", "Panel", "Open / Closed"], [7, "E", "P", "open"]], group="Grup A", name="Eksik", ord=1)
    data = grid(spark, sheet(rows, group="Grup A", missing={7: [(4, "=A2")]}), lost)
    groups = spark.createDataFrame([("Grup A", 1), ("Boş grup", 0)], "group string, files_found long")
    r = harmonize(data, CFG, groups=groups)
    table = {x["group"]: [x[c] for c in ("open", "closed", "our_company", "other_company", "unknown_status", "unknown_turn")]
             for x in stats.workflow_rollup(r.record, r.groups, r.cfg.workflow).collect()}
    assert table == {"GENEL TOPLAM": [4, 2, 1, 1, 1, 2], "Grup A": [4, 2, 1, 1, 1, 2], "Boş grup": [0] * 6}
    per_group = stats.group_stats(r.record, r.groups, r.segment, r.event, r.quarantine, r.cfg.schema)
    figures = {x["group"]: (x["records"], x["files"], x["sheets"], x["quarantined"]) for x in per_group.collect()}
    assert figures == {"Grup A": (7, 1, 2, 1), "Boş grup": (0, 0, 0, 0)}
    total = stats.report_totals(per_group, r.segment, r.event).first()
    assert (total["records"], total["errors"], total["verdict"], total["processed_files"]) == (7, 0, "review", 1)
    codes = {x["code"] for x in r.event.collect()}
    assert {"EMPTY_GROUP", "FORMULA_CACHE_MISSING", "QUARANTINED_ROWS", "SHEET_DONE"} <= codes


def test_sheet_name_groups(spark):
    def file(path, *sheets):
        return [row for name, number in sheets for row in sheet([HEADER, [number, f"E{number}", "P"]], group=None, file=path, name=name)]

    data = grid(spark, file("Kök.xlsx", ("Data", 1)), file("Grup A/a.xlsx", ("Data", 2), ("Diğer", 20)), file("Grup B/b.xlsx", ("data", 3)))
    data = group_by_sheet_name(data.withColumn("file_ord", F.lower("file")))
    r = harmonize(data, CFG)
    kept = r.record.orderBy("file_ord", "row_no").select("group", F.col("values")["No."]["v"].alias("no")).collect()
    assert [(x["group"], x["no"]) for x in kept if x["group"] == "Data"] == [("Data", "2"), ("Data", "3"), ("Data", "1")]
    assert {x["group"] for x in kept} == {"Data", "Diğer"}


def test_excluded_sheets(spark):
    data = grid(spark, sheet([HEADER, [1, "E", "P"]], name="Cover"), sheet([HEADER, [2, "E", "P"]], name="Secret", visible=False), sheet([HEADER, [3, "E", "P"]], name="Data"))
    r = harmonize(data, replace(CFG, exclude_sheets=("co*",), include_hidden_sheets=False))
    assert [x["sheet"] for x in r.record.collect()] == ["Data"]
    assert r.event.where("code = 'SHEET_EXCLUDED'").count() == 2


def test_parts_keep_source_order(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 5)
    rows = [("hot", f"f{i % 3}", i % 2, i) for i in range(200)] + [("cold", "f0", 0, 1)]
    df = spark.createDataFrame(rows, "group string, file_ord string, sheet_ord int, row_no long")
    got = {(r["group"], r["row_no"]): r["part"] for r in ordered.part_numbers(df, "group", 30).collect()}
    order = sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[1:])
    assert [got["hot", r[3]] for r in order] == [i // 30 + 1 for i in range(200)] and got["cold", 1] == 1


def test_sections(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 4)
    rows = [(1, 1, 10, "before")]
    for s in range(1, 103):
        rows += [(1, 3 * s, 1, f" Title {s}: a/b\r"), (1, 3 * s + 1, 2, "deeper"), (1, 3 * s + 2, 10, f"text {s}")]
    rows.append((2, 1, 2, "no heading"))
    df = spark.createDataFrame(rows, "doc_id long, para_no long, level int, text string")
    got = sections.section_texts(df, 1).orderBy("section").collect()
    assert len(got) == 102 and {r["doc_id"] for r in got} == {1}
    assert got[0]["file_name"] == "01_Title 1_ a_b" and got[101]["file_name"] == "102_Title 102_ a_b"
    assert got[4]["text"] == " Title 5: a/b\r\ndeeper\ntext 5" and got[4]["paragraphs"] == 3
    assert sections.section_texts(df, 3).count() == 0
    parts = sections.section_texts(df, 1, part_paragraphs=2).where("section = 1").orderBy("part").collect()
    assert [p["paragraphs"] for p in parts] == [2, 1]


def test_line_endings(spark):
    contents = [b"a\r\nb", b"a\nb", b"a\rb\xff\xc3\r\n", b"\x00\r\n", b""]
    files = spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)] + [("gone", None)], "path string, content binary")
    got = {r["path"]: (bytes(r["new_content"]), r["changed"]) for r in line_endings.normalize_files(files).collect()}
    assert got == {"0": (b"a\nb", True), "1": (b"a\nb", False), "2": (b"a\rb\xff\xc3\n", True), "4": (b"", False)}
    assert tuple(line_endings.change_counts(line_endings.normalize_files(files)).first()) == (4, 2)


def test_pattern_report(spark):
    files = spark.createDataFrame([(f"d/img_{i:03d}.jpg",) for i in range(8)] + [("d/img_7.PNG",), ("x/note",)], "path string")
    groups = {(r["mode"], r["pattern"]): r for r in patterns.pattern_groups(files, ignore_suffix=True).collect()}
    assert groups["literal", "img_<NUM:3>"]["count"] == 8
    assert groups["literal", "img_<NUM:3>"]["examples"] == " | ".join(f"d/img_{i:03d}.jpg" for i in range(5))
    assert groups["structural", "<WORD>"]["extensions"] == "<NO_EXT>:1"
    top = patterns.top_patterns(patterns.pattern_groups(files, min_count=2), "structural", 1).collect()
    assert [(r["pattern"], r["count"]) for r in top] == [("<WORD>_<NUM:3>.jpg", 8)]


def test_conversion_worklist(spark):
    files = spark.createDataFrame([("a.webm",), ("sub/b.webm",), ("c.WEBM",), ("d.mov",)], "path string")
    existing = spark.createDataFrame([("a.mp3",)], "path string")
    plan = lambda **o: {r["path"]: (r["target_path"], r["action"], r["delete_source"]) for r in worklist.conversion_worklist(files, existing, ".webm", "MP3", **o).collect()}
    assert plan() == {"a.webm": ("a.mp3", "skip", False)}
    assert plan(recursive=True, delete_source=True) == {"a.webm": ("a.mp3", "skip", False), "sub/b.webm": ("sub/b.mp3", "convert", True)}
    assert plan(overwrite=True)["a.webm"][1] == "convert"
    with pytest.raises(ValueError):
        worklist.conversion_worklist(files, existing, "webm", "docx")


def test_field_resolution(spark):
    catalogue = spark.createDataFrame([("summary", "Summary", "string"), ("cf_1", "Points", "number"), ("cf_2", "Twice", "string"), ("cf_3", "twice", "string")], "id string, name string, type string")
    fields = flatten.resolve_fields(catalogue, ["Issue Key", "URL", " points ", "CF_2"])
    assert [(f.kind, f.field_id, f.type) for f in fields] == [("key", None, None), ("url", None, None), ("field", "cf_1", "number"), ("field", "cf_2", "string")]
    assert needed_ids(fields) == ["cf_1", "cf_2"] and needed_ids(fields[:2]) == ["summary"]
    for bad in (["Twice"], ["Nothing"], ["Summary", "summary "], []):
        with pytest.raises(ValueError):
            flatten.resolve_fields(catalogue, bad)


def test_issue_source(spark, tmp_path):
    path = tmp_path / "issues.jsonl"
    path.write_text('{"key": "A-1", "fields": {"summary": "s", "cf_1": 2.5}}\nnot json\n{"key": "A-2", "fields": {}}\n', encoding="utf-8")
    fields = [flatten.Field("Key", "key"), flatten.Field("URL", "url"), flatten.Field("Sum", "field", "summary", "string"), flatten.Field("P", "field", "cf_1", "number")]
    rows = flatten.flatten_issues(read_issues(spark, str(path)), fields, "https://x/", typed=True).orderBy("Key.v").collect()
    assert [tuple(c["v"] for c in r) for r in rows] == [("A-1", "https://x/browse/A-1", "s", "2.5"), ("A-2", "https://x/browse/A-2", "", "")]
    assert rows[0]["P"]["t"] == "float"


def test_length_profile(spark):
    df = spark.createDataFrame([("ab\ncdef", None), ("x", "2024-01-01")], "a string, d string").withColumn("d", F.to_timestamp("d"))
    assert {r["column"]: r["longest_line"] for r in profile.length_profile(df).collect()} == {"a": 4, "d": 19}
    widths = {r["column"]: r["width"] for r in profile.column_widths(df.withColumn("Description", F.lit("y" * 90))).collect()}
    assert widths == {"a": 12, "d": 21, "Description": 55}


def test_formula_merge(spark):
    keys = "file string, sheet string, row_no long, "
    cell = "array<struct<t:string,v:string>>"
    formulas = spark.createDataFrame([("f", "s", 1, [("formula", "=A1"), ("formula", "=B1"), ("int", "3")]), ("f", "s", 2, [("formula", "=C")])], keys + f"formulas {cell}")
    values = spark.createDataFrame([("f", "s", 1, [("int", "5"), None, ("int", "3"), ("text", "x")]), ("f", "s", 3, [("text", "y")])], keys + f"values {cell}")
    got = {r["row_no"]: ([c["v"] if c else None for c in r["cells"]], [tuple(m) for m in r["missing"]]) for r in merge_formulas(formulas, values).collect()}
    assert got == {1: (["5", MISSING_RESULT + " =B1", "3", "x"], [(1, "=B1")]), 2: ([MISSING_RESULT + " =C"], [(0, "=C")]), 3: (["y"], [])}


def test_listing_rules(spark):
    paths = ["a/x.csv", "a/.git/y.csv", "a/sub/z.CSV", "a/~$t.csv", "b/note.md", ".h/q.csv", "root.csv", "a/out/gridwork-output.marker/part-0", "a/out/records/r.csv"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    kept, skipped = listing.skip_own_outputs(files, listing.own_outputs(files))
    assert {r["path"] for r in skipped.collect()} == {"a/out/gridwork-output.marker/part-0", "a/out/records/r.csv"}
    source = listing.acceptable(listing.visible_files(kept), CFG)
    grouped, left = listing.assign_groups(source, CFG)
    assert [r["path"] for r in grouped.orderBy("file_ord").collect()] == ["a/x.csv", "a/sub/z.CSV"] and [r["path"] for r in left.collect()] == ["root.csv"]
    named, left = listing.assign_groups(source, replace(CFG, include_root_files=True, root_group="A"))
    assert {r["path"]: r["group"] for r in named.collect()}["root.csv"] == "A_" and left.count() == 0
    names = spark.createDataFrame([("a",), ("empty",)], "group string")
    assert {r["group"]: r["files_found"] for r in listing.listed_groups(grouped, names).collect()} == {"a": 2, "empty": 0}


def test_files_to_report(spark, tmp_path):
    root = tmp_path / "src" / "Grup A"
    root.mkdir(parents=True)
    (root / "one file.csv").write_text('No.,Entity,"Panel\nexplained"\n1,"E, ""x""",P\n\n2,E,P\r\n,,\n', encoding="utf-8")
    source = str(tmp_path / "src")
    files, _ = listing.assign_groups(listing.acceptable(listing.list_files(spark, source), CFG), CFG)
    data = text_grid(listing.read_texts(files, spark, source))
    assert [r["row_no"] for r in data.orderBy("row_no").collect()] == [1, 2, 3, 4, 5]
    result = harmonize(data, replace(CFG, header_heights=(1,)))
    flat = wide(result.record, CFG, extra_columns_of(result, "Grup A")).orderBy("row_no").collect()
    assert [(r["No."], r["Entity"], r["Panel"], r["row_no"]) for r in flat] == [("1", 'E, "x"', "P", 2), ("2", "E", "P", 4)]
    target = str(tmp_path / "out")
    outputs.write_report(result, target, source)
    stored = spark.read.parquet(target + "/records")
    assert stored.count() == 2 and {"group", "part", "extras"} <= set(stored.columns)
    assert {r["type"] for r in spark.read.json(target + "/audit").select("type").distinct().collect()} == {"event", "header"}
    with pytest.raises(FileExistsError):
        outputs.write_report(result, target, source)
    outputs.write_report(result, target, source, overwrite=True, audit_only=True)
    # the earlier records went with the earlier output
    assert not outputs.path_exists(spark, target + "/records") and outputs.path_exists(spark, target + "/audit")
    with pytest.raises(ValueError):
        outputs.check_target(spark, source, None, overwrite=True)
    with pytest.raises(ValueError):
        outputs.check_target(spark, "file:" + str(tmp_path), source, overwrite=True)
    bad = replace(result, event=result.event.limit(1).withColumn("level", F.lit("ERROR")), cfg=replace(CFG, fail_on_error=True))
    with pytest.raises(outputs.QualityGateError):
        outputs.write_report(bad, target, source, overwrite=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out", "src"]


def test_folder_to_report(spark, tmp_path):
    (tmp_path / "src" / "A").mkdir(parents=True)
    (tmp_path / "src" / "B").mkdir()
    (tmp_path / "src" / "A" / "x.csv").write_text("No.,Entity,Panel\n1,E,P\n2,E,\n")
    (tmp_path / "src" / "A" / "bad.csv").write_text('No.,"Entity\n')
    (tmp_path / "src" / "top.csv").write_text("No.,Entity,Panel\n9,E,P\n")
    (tmp_path / "src" / "B" / "note.md").write_text("none")
    cfg = replace(CFG, expected_header_row=1, header_heights=(1,))
    found = run_report(spark, str(tmp_path / "src"), str(tmp_path / "out"), cfg)
    assert (found.files, found.records, found.errors) == (2, 2, 1)
    events = {(r["code"], r["file"], r["group"]) for r in spark.read.json(str(tmp_path / "out" / "audit")).where("type = 'event'").collect()}
    assert {("ROOT_FILE_SKIPPED", "top.csv", None), ("FILE_READ_FAILED", "A/bad.csv", "A"), ("EMPTY_GROUP", None, "B")} <= events
    with pytest.raises(outputs.QualityGateError):
        run_report(spark, str(tmp_path / "src"), str(tmp_path / "strict"), replace(cfg, fail_on_error=True))
    assert not (tmp_path / "strict").exists()


def test_columns_are_written_by_type(spark):
    header = ["No.", "Entity", "Panel", "Notes"]
    data = grid(spark, sheet([header, [1, 2.5, "x", True], [2, 3, "y", False], [3, None, "z", None]]))
    result = harmonize(data, replace(CFG, expected_header_row=1, header_heights=(1,)))
    kinds = dict(outputs.record_parts(result.record, CFG).dtypes)
    assert (kinds["No."], kinds["Entity"], kinds["Panel"]) == ("bigint", "double", "string")
    rows = outputs.record_parts(result.record, CFG).orderBy("row_no").collect()
    assert [(r["No."], r["Entity"]) for r in rows] == [(1, 2.5), (2, 3.0), (3, None)]
    assert rows[0]["extras"]["Ek | Notes"]["t"] == "bool"


def texts(spark, *bodies):
    return spark.createDataFrame([("G", f"f{i}.csv", f"f{i}.csv", b) for i, b in enumerate(bodies)], "group string, file string, file_ord string, text string")


def test_malformed_files_fail_as_a_whole(spark):
    wide_line = ",".join(str(i) for i in range(20_000))
    files = texts(spark, 'a,b\nx,"abc\n', 'a,b\n"q"b,c\n', wide_line, None, "", 'x,""\r"y\n""z"""\r\n')
    parsed = parse_texts(files)
    bad = {r["file"]: r["detail"] for r in parse_failures(parsed).collect()}
    assert set(bad) == {"f0.csv", "f1.csv", "f3.csv"} and bad["f3.csv"] == "file could not be read"
    rows = {(r["file"], r["row_no"]): [c["v"] if c else None for c in r["cells"]] for r in parsed_grid(parsed).collect()}
    assert rows["f2.csv", 1] == wide_line.split(",")
    assert rows["f5.csv", 1] == ["x", None] and rows["f5.csv", 2] == ['y\n"z"'] and len(rows) == 3
    result = harmonize(parsed_grid(parsed), CFG, failures=parse_failures(parsed))
    failed = result.event.where("code = 'FILE_READ_FAILED'").collect()
    assert {(r["file"], r["level"]) for r in failed} == {(f, "ERROR") for f in bad}


def test_paths_below_a_root_that_repeats_itself(spark, tmp_path):
    root = tmp_path / "in"
    deep = root / "g1" / str(root).lstrip("/") / "deep"
    deep.mkdir(parents=True)
    (deep / "x.csv").write_text("a\n")
    (root / "g2").mkdir()
    (root / "g2" / "a+b %41.csv").write_text("b\n")
    (root / "top.csv").write_text("c\n")
    found = listing.list_files(spark, str(root))
    below = "g1/" + str(root).lstrip("/") + "/deep/x.csv"
    assert {r["path"] for r in found.collect()} == {below, "g2/a+b %41.csv", "top.csv"}
    for name in ("Root (top", "Root (top)"):
        files, _ = listing.assign_groups(found, replace(CFG, include_root_files=True, root_group=name))
        read = {r["file"]: (r["group"], r["text"]) for r in listing.read_texts(files, spark, "file:" + str(root)).collect()}
        assert read == {below: ("g1", "a\n"), "g2/a+b %41.csv": ("g2", "b\n"), "top.csv": (name, "c\n")}


def test_lines_that_are_no_issues(spark):
    lines = spark.createDataFrame([('{"key": "A-1", "fields": {}}',), ("{broken",), ("",)], "value string")
    assert [r["key"] for r in issue_rows(lines).collect()] == ["A-1"]
    assert [r["detail"] for r in line_failures(lines).collect()] == ["not JSON: {broken"]


def test_quality_gate(spark):
    event = spark.createDataFrame([("ERROR",)], "level string")
    outputs.quality_gate(event, CFG)
    with pytest.raises(outputs.QualityGateError):
        outputs.quality_gate(event, replace(CFG, fail_on_error=True))
