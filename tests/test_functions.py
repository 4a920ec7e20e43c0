import datetime

import pytest
from gridtools import MISSING
from pyspark.sql import functions as F

from gridwork.functions import cells as C
from gridwork.functions import issues as I
from gridwork.functions import labels as L
from gridwork.functions import paths as P
from gridwork.functions import text as X
from gridwork.functions.patterns import add_patterns


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, folded",
    [("İnceleyen Adı", "inceleyen adi"), ("  Open/Closed__x ", "open closed x"), ("STRASSE ẞß", "strasse ssss"),
     ("soft­hyphen", "softhyphen"), ("ﬁne Ça²", "fine ca2"), ("***", ""), ("No.", "no")],
)
def test_folded_titles(spark, raw, folded):
    assert L.fold_label(raw) == folded
    assert one(spark, L.folded(F.col("v")), raw) == folded


def test_title_candidates(spark):
    raw = "\n Name \r\nof\n\nReviewer more"
    assert one(spark, L.title_candidates(F.col("v"), "smart", 3), raw) == ["Name", "Name of", "Name of Reviewer"]
    assert one(spark, L.title_candidates(F.col("v"), "first_line", 3), raw) == ["Name"]
    assert one(spark, L.title_candidates(F.col("v"), "full", 3), " a\nb ") == ["a\nb"]
    assert one(spark, L.title_candidates(F.col("v"), "smart", 3), " \n ") == [""]


CELL = "struct<t:string,v:string>"


@pytest.mark.parametrize(
    "cell, fmt, shown",
    [(("int", "7"), "000", ("text", "007")), (("int", "-7"), "000", ("text", "-07")), (("int", "12345"), "000", ("text", "12345")),
     (("float", "7.0"), "00", ("text", "07")), (("float", "7.5"), "00", ("float", "7.5")), (("float", "NaN"), "00", ("text", "nan")),
     (("float", "-Infinity"), None, ("text", "-inf")), (("int", "1000000000000000"), "General", ("text", "1000000000000000")),
     (("int", "999999999999999"), None, ("int", "999999999999999")), (("text", " \t a b "), "000", ("text", "a b")),
     (("bool", "True"), "00", ("bool", "True"))],
)
def test_clean_cells(spark, cell, fmt, shown):
    df = spark.createDataFrame([(cell, fmt)], f"c {CELL}, f string")
    got = df.select(C.clean_cell(F.col("c"), F.col("f")).alias("x")).first()["x"]
    assert (got["t"], got["v"]) == shown


@pytest.mark.parametrize(
    "cell, label",
    [(None, "(Boş)"), (("text", " \n"), "(Boş)"), (("text", MISSING), "(Formül sonucu okunamadı)"), (("float", "3.0"), "3"),
     (("float", "3.5"), "3.5"), (("datetime", "2024-01-02 03:04:05"), "2024-01-02T03:04:05"), (("date", "2024-01-02"), "2024-01-02"),
     (("bool", "False"), "False"), (("int", "0"), "0")],
)
def test_category_names(spark, cell, label):
    assert one(spark, C.category_text(F.col("v")), cell, CELL) == label


def test_fingerprints_tell_types_apart(spark):
    rows = [("text", "1"), ("int", "1"), ("text", "1")]
    df = spark.createDataFrame([(r,) for r in rows], f"c {CELL}")
    entry = F.array(F.struct(F.lit("No.").alias("k"), F.col("c").alias("c")))
    marks = [r["m"] for r in df.select(C.fingerprint(entry).alias("m")).collect()]
    assert marks[0] == marks[2] != marks[1]


def test_column_letters(spark):
    wanted = {0: "A", 25: "Z", 26: "AA", 51: "AZ", 701: "ZZ", 702: "AAA", 16383: "XFD", 18277: "ZZZ", 18278: "AAAA"}
    df = spark.createDataFrame([(i,) for i in wanted], "i int").select("i", C.column_letters(F.col("i")).alias("x"))
    assert {r["i"]: r["x"] for r in df.collect()} == wanted


def test_moments_and_durations(spark):
    assert one(spark, C.day_fraction(F.expr("INTERVAL '1 12:00:00' DAY TO SECOND"))) == 1.5
    assert one(spark, C.moment_text(F.to_timestamp(F.lit("2024-01-02 00:00:00")))) == "2024-01-02"
    assert one(spark, C.moment_text(F.to_timestamp(F.lit("2024-01-02 01:00:00")))) == "2024-01-02 01:00:00"
    assert one(spark, C.moment_text(F.to_timestamp(F.lit("2024-01-02 01:00:00")), F.lit("2024-01-02T01:00:00+03:00"))) == "2024-01-02T01:00:00+03:00"


def test_long_texts(spark):
    assert len(one(spark, X.limit_text(F.col("v")), "x" * 32768)) == 32762
    assert one(spark, X.limit_text(F.col("v")), "x" * 32767) == "x" * 32767
    assert [len(p) for p in one(spark, X.pieces(F.col("v")), "x" * 60001)] == [30000, 30000, 1]
    assert one(spark, X.pieces(F.col("v")), "") == [""]
    assert one(spark, X.unix_lines(F.col("v")), "a\r\nb\rc\n") == "a\nb\rc\n"


@pytest.mark.parametrize("title, name", [("a/b: c?", "a_b_ c_"), ("  x \n y\t", "x y"), (" ", "untitled"), ("z" * 99, "z" * 80)])
def test_safe_file_names(spark, title, name):
    assert one(spark, X.safe_file_name(F.col("v")), title) == name


@pytest.mark.parametrize(
    "name, parts",
    [("archive.tar.gz", ("archive", ".tar.gz")), ("a.B.TAR.GZ", ("a.B", ".TAR.GZ")), (".hidden", (".hidden", "")), ("x.y.z", ("x.y", ".z")),
     ("noext", ("noext", "")), ("dot.", ("dot.", "")), ("..x", (".", ".x")), (".tar.gz", ("", ".tar.gz"))],
)
def test_name_parts(spark, name, parts):
    got = one(spark, P.name_parts(F.col("v")), name)
    assert (got["stem"], got["suffix"]) == parts


def test_media_names(spark):
    assert one(spark, P.media_format(F.col("v")), ".MP4") == "mp4" and one(spark, P.media_format(F.col("v")), "doc") is None
    assert one(spark, P.media_class(F.col("v")), "flac") == "audio" and one(spark, P.media_class(F.col("v")), "ts") == "video"
    assert one(spark, P.with_suffix(F.col("v"), F.lit("mp3")), "a.b/c.d.webm") == "a.b/c.d.mp3"


PATTERNS = [
    ("a 123e4567-e89b-12d3-a456-426614174000.txt", "a <UUID>.txt", "<WORD> <UUID>.txt"),
    ("log 2024-01-02.csv", "log <DATE:YYYY-MM-DD>.csv", "<WORD> <DATE:YYYY-MM-DD>.csv"),
    ("log20240102x.csv", "log<DATE:YYYYMMDD>x.csv", "<WORD><DATE:YYYYMMDD><WORD>.csv"),
    ("20240102_1230.jpg", "<DATETIME:YYYYMMDD_HHMM>.jpg", "<DATETIME:YYYYMMDD_HHMM>.jpg"),
    ("2024_01_02-12.30.45.jpg", "<DATETIME:YYYY_MM_DD_HH.MM.SS>.jpg", "<DATETIME:YYYY_MM_DD_HH.MM.SS>.jpg"),
    ("02.01.2024.txt", "<DATE:DD.MM.YYYY>.txt", "<DATE:DD.MM.YYYY>.txt"),
    ("app-v1.2.3-final.zip", "app-<VERSION>-final.zip", "<WORD>-<VERSION>-<WORD>.zip"),
    ("x_12:30:45.txt", "x_<TIME:HH:MM:SS>.txt", "<WORD>_<TIME:HH:MM:SS>.txt"),
    ("x123045.txt", "x<NUM:6>.txt", "<WORD><NUM:6>.txt"),
    ("a001", "a<NUM:3><NO_EXT>", "<WORD><NUM:3><NO_EXT>"),
    ("Ölçüm Şubat 7.tar.gz", "ölçüm şubat <NUM:1>.tar.gz", "<WORD> <WORD> <NUM:1>.tar.gz"),
    ("9 1 2024-13-01 20.txt", "<NUM:1> <NUM:1> <NUM:4>-<NUM:2>-<NUM:2> <NUM:2>.txt", "<NUM:1> <NUM:1> <NUM:4>-<NUM:2>-<NUM:2> <NUM:2>.txt"),
]


def test_name_patterns(spark):
    df = spark.createDataFrame([(f"dir.x/{n}",) for n, _, _ in PATTERNS], "path string")
    got = {r["path"][6:]: (r["literal"], r["structural"]) for r in add_patterns(df).collect()}
    assert got == {n: (a, b) for n, a, b in PATTERNS}
    kept = add_patterns(df.where("path like '%Ölçüm%'"), case_sensitive=True, ignore_suffix=True).first()
    assert kept["literal"] == "Ölçüm Şubat <NUM:1>"


ISSUE_VALUES = [
    ("null", None, ""), ('"text"', None, "text"), ("5", None, "5"), ("1.50", None, "1.5"), ("true", None, "True"),
    ('{"displayName": "Ada", "name": "x"}', None, "Ada"), ('{"value": "Opt", "name": "x"}', None, "Opt"), ('{"name": "Open", "id": 1}', None, "Open"),
    ('{"key": "P-1"}', None, "P-1"), ('{"other": 1}', None, '{"other":1}'), ('["a", "", null, {"name": "b"}, 0, false]', None, "a\nb\n0\nFalse"),
    ('["a", ["b", ["c"]]]', None, "a\nb\nc"), ('{"name": null, "key": "k"}', None, None),
    ('"2024-01-02T03:04:05.000+0300"', "datetime", "2024-01-02 03:04:05"), ('"2024-01-02T03:04:05Z"', "datetime", "2024-01-02 03:04:05"),
    ('"not a date"', "datetime", "not a date"), ('"2024-01-02"', "date", "2024-01-02"), ('"2024-02-31"', "date", "2024-02-31"),
    ('{"comments": [{"author": {"displayName": "", "name": "bob"}, "created": "now", "body": {"type": "doc", "content": [{"type": "paragraph",'
     ' "content": [{"type": "text", "text": "hi "}]}]}}, {"body": "plain"}]}', None, "bob [now]\nhi\n\nplain"),
    ('{"type": "doc", "content": [{"type": "heading", "content": [{"type": "text", "text": "T  "}]}, {"type": "bulletList", "content": ['
     '{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}]},'
     ' {"type": "rule"}, {"type": "text", "text": 7}]}', None, "T\nab\n7"),
]


@pytest.mark.parametrize("declared", [None, "datetime", "date"])
def test_issue_values(spark, declared):
    cases = [(v, t) for v, d, t in ISSUE_VALUES if d == declared]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, j string").withColumn("v", F.parse_json("j"))
    texts = I.add_value_texts(df, [F.col("v")], "t")
    got = texts.select("i", I.value_text(F.get("t", F.lit(0)), declared).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [t for _, t in cases]


def test_documents_and_lists_of_any_depth(spark):
    node = '{"type": "text", "text": "x "}'
    for _ in range(200):
        node = '{"type": "paragraph", "content": [%s]}' % node
    assert one(spark, I.document_text(F.parse_json("v")), node) == "x\n"
    deep = '["a", [[[[["b", 1]], null]]], {"name": {"k": 1.50}}]'
    df = spark.createDataFrame([(deep,), ('"%s"' % ("y" * 40_000),)], "j string").select(F.parse_json("j").alias("v"))
    got = [r["x"] for r in I.add_value_texts(df, [F.col("v")], "t").select(I.value_text(F.get("t", F.lit(0)), None).alias("x")).collect()]
    assert got[0].split("\n")[:3] == ["a", "b", "1"] and got[1] == "y" * 40_000


def test_numbers_are_shown_without_exponent(spark):
    cases = ["12345678.9", "0.0005", "123456789012345678901", "3.0", "-1e-7", "1E+9", "7", "0.00"]
    df = spark.createDataFrame([(i, "[%s]" % v, v) for i, v in enumerate(cases)], "i int, list string, j string")
    texts = I.add_value_texts(df, [F.parse_json("list"), F.parse_json("j")], "t").orderBy("i").select("t").collect()
    for case, row in zip(cases, texts):
        assert all("E" not in t["text"] and "e" not in t["text"] and float(t["text"]) == float(case) for t in row["t"]), case
    assert [r["t"][1]["text"] for r in texts[:4]] == cases[:4]


def test_status_and_priority_classes(spark):
    for text, status in [("Done", "done"), ("in progress now", "progress"), ("BLOCKED", "blocked"), ("Incomplete", "done"), ("Open", None)]:
        assert one(spark, I.status_class(F.col("v")), text) == status
    assert one(spark, I.priority_class(F.col("v")), "Highest") == "high" and one(spark, I.priority_class(F.col("v")), "Low") is None
