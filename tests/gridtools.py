"""Small grids for the tests."""

from gridwork.functions.cells import MISSING_RESULT
from gridwork.sources.grid import MISSING_DDL

SCHEMA = (
    "group string, file string, file_ord string, sheet string, sheet_ord int, visible boolean, row_no long, "
    f"cells array<struct<t:string,v:string>>, formats array<string>, missing {MISSING_DDL}"
)
MISSING = MISSING_RESULT + " =A1"


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, int):
        return ("int", str(value))
    if isinstance(value, float):
        return ("float", repr(value))
    return ("text", value)


def sheet(rows, group="Test", file="source.xlsx", name="Data", ord=0, visible=True, first=1, missing=None):
    missing = missing or {}
    return [
        (group, file, file, name, ord, visible, n, [cell(v) for v in row], [], missing.get(n, []))
        for n, row in enumerate(rows, first)
    ]


def grid(spark, *sheets):
    return spark.createDataFrame([row for s in sheets for row in s], SCHEMA)


def value(record, name):
    got = record["values"].get(name)
    return None if got is None else got["v"]
