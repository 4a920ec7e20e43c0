"""Issue field values: nested JSON in, one typed cell out.

Values are ``VARIANT`` columns. Scalars are plain expressions; nested values go through one
Arrow-batched function (``functions/trees.py``). A table of issues is flattened in one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwork.functions.cells import BLANKS, CELL, make_cell, plain_number, strip
from gridwork.functions.text import limit_text
from gridwork.functions.trees import NAMING_KEYS, field_texts, tree_texts
from gridwork.session import computed_once, once

# Words in a status or a priority and the class they stand for.
DONE_WORDS = ("Done", "Closed", "Resolved", "Complete")
PROGRESS_WORDS = ("In Progress",)
BLOCKED_WORDS = ("Blocked",)
HIGH_WORDS = ("Highest", "Critical", "Blocker")


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _list(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _scalar_kind(value: Column) -> Column:
    return F.substring_index(F.schema_of_variant(value), "(", 1)


def scalar_text(value: Column) -> Column:
    """Text of a JSON scalar, NULL for null: numbers without exponent, True and False spelled so."""
    return kind_text(value, _scalar_kind(value))


def kind_text(value: Column, kind: Column) -> Column:
    """The same for a scalar of known kind."""
    shown = plain_number(_text(value, "$"))
    # A value such as 3.0 comes without its fraction; whole numbers arrive here beyond 18 digits only.
    short = ~F.contains(shown, F.lit(".")) & (F.length(shown) <= 18)
    number = F.when(short, F.concat(shown, F.lit(".0"))).otherwise(shown)
    return (
        F.when(kind == "STRING", _text(value, "$"))
        .when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), number)
        .when(kind == "BOOLEAN", F.initcap(_text(value, "$")))
        .otherwise(_text(value, "$"))
    )


def _kind(value: Column, json: Column) -> Column:
    """``OBJECT``, ``ARRAY`` or the kind of a scalar. The first character of its JSON tells all but the kinds of
    numbers apart, without a walk through the content."""
    first = F.substring(json, 1, 1)
    kind = F.when(first == "{", "OBJECT").when(first == "[", "ARRAY").when(first == '"', "STRING")
    return kind.when(first.isin("t", "f"), "BOOLEAN").when(first == "n", "VOID").otherwise(_scalar_kind(value))


def shaped(value: Column) -> Column:
    """``struct<value, json, kind>``; see ``_kind``. NULL has no kind."""

    def told(pair: Column) -> Column:
        kind = F.when(pair["json"].isNotNull(), _kind(pair["value"], pair["json"]))
        return F.struct(pair["value"].alias("value"), pair["json"].alias("json"), kind.alias("kind"))

    return once(once(value, lambda v: F.struct(v.alias("value"), F.to_json(v).alias("json"))), told)


def document_text(node: Column) -> Column:
    """Plain text of a document tree of any depth."""
    return tree_texts(F.to_json(node), BLANKS)


#: Scalars whose text is that of the JSON; numbers with a fraction keep the digits they are written with, which
#: is left to the function for nested values.
PLAIN_KINDS = ("STRING", "VOID", "BOOLEAN", "BIGINT", "INT", "SMALLINT", "TINYINT")


def _plain(value: Column, kind: Column) -> Column:
    """``struct<done, text>`` of a scalar."""
    done = kind.isin(*PLAIN_KINDS)
    return F.struct(F.coalesce(done, F.lit(False)).alias("done"), F.when(done, kind_text(value, kind)).alias("text"))


def _named(value: Column) -> Column:
    """``struct<done, text>`` of an object that is no document and whose first naming key holds a scalar."""
    first = F.coalesce(*[F.try_variant_get(value, f"$.{key}", "variant") for key in NAMING_KEYS])
    document = F.coalesce(_text(value, "$.type") == "doc", F.lit(False))
    nothing = F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("text"))
    return F.when(document | first.isNull(), nothing).otherwise(once(shaped(first), lambda s: _plain(s["value"], s["kind"])))


def _item(value: Column) -> Column:
    return once(shaped(value), lambda s: F.when(s["kind"] == "OBJECT", _named(s["value"])).otherwise(_plain(s["value"], s["kind"])))


def _listed(value: Column) -> Column:
    """``struct<done, text>`` of a list of scalars and named objects, a line each."""

    def joined(items: Column) -> Column:
        lines = F.filter(F.transform(items, lambda i: i["text"]), lambda t: t.isNotNull() & (t != ""))
        return F.struct(F.forall(items, lambda i: i["done"]).alias("done"), F.array_join(lines, "\n").alias("text"))

    return once(F.transform(_list(value, "$"), _item), joined)


def _flat(shape: Column) -> Column:
    """``struct<done, text>``: the text of a scalar, a named object or a flat list, where there is one."""
    value, kind = shape["value"], shape["kind"]
    nothing = F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("text"))
    scalar = F.struct(F.lit(True).alias("done"), kind_text(value, kind).alias("text"))
    # The first comment tells most lists without writing them out as JSON.
    comments = F.try_variant_get(value, "$.comments[0]", "variant").isNotNull() | F.coalesce(
        F.substring(F.to_json(F.try_variant_get(value, "$.comments", "variant")), 1, 1) == "[", F.lit(False)
    )
    named = F.when(comments, nothing).otherwise(_named(value))
    return F.when(kind == "OBJECT", named).when(kind == "ARRAY", _listed(value)).otherwise(scalar)


def add_value_texts(df: DataFrame, values: list[Column], out: str) -> DataFrame:
    """Adds ``out``, an array of ``struct<kind, text>`` for several VARIANT values. Scalars, named objects and
    flat lists stay in the JVM; documents, comments, and lists and objects with nested content leave it."""
    shapes, nested = f"{out}_shapes", f"{out}_nested"
    # One expression for all values, however many fields are read.
    shape = lambda s: F.struct(s["json"].alias("json"), s["kind"].alias("kind"), _flat(s).alias("flat"))
    df = df.withColumn(shapes, computed_once(F.transform(F.array(*values), lambda v: once(shaped(v), shape))))
    inner = F.transform(shapes, lambda s: F.when(~s["flat"]["done"], s["json"]))
    df = df.withColumn(nested, field_texts(inner, BLANKS))

    def text_of(s: Column, t: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), F.when(s["flat"]["done"], s["flat"]["text"]).otherwise(t).alias("text"))

    return df.withColumn(out, computed_once(F.zip_with(shapes, nested, text_of))).drop(shapes, nested)


def parse_moment(text: Column) -> Column:
    """ISO moment without its zone; the clock reading stays. NULL if it is none."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), trimmed.try_cast("timestamp_ntz"))


def parse_day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def _moment_shown(moment: Column) -> Column:
    micros = F.date_format(moment, ".SSSSSS")
    return F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.when(micros != ".000000", micros).otherwise(""))


def value_text(shape: Column, declared: str | None, limited: bool = False) -> Column:
    """Output text from ``struct<kind, text>`` of a value and the declared type of the field. Texts
    are whole unless ``limited`` to what a spreadsheet cell holds."""
    kind, text = shape["kind"], shape["text"]
    string = F.when(kind == "STRING", text)
    shown = F.when(kind.isNull() | (kind == "VOID"), "")
    if declared == "datetime":
        shown = shown.when(parse_moment(string).isNotNull(), _moment_shown(parse_moment(string)))
    if declared == "date":
        shown = shown.when(parse_day(string).isNotNull(), F.date_format(parse_day(string), "yyyy-MM-dd"))
    return shown.otherwise(limit_text(text) if limited else text)


def value_cell(shape: Column, declared: str | None, limited: bool = False) -> Column:
    """The same as a typed cell."""
    kind = shape["kind"]
    string = F.when(kind == "STRING", shape["text"])
    name = F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
    name = name.when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), "float").when(kind == "BOOLEAN", "bool")
    if declared == "datetime":
        name = name.when(parse_moment(string).isNotNull(), "datetime")
    if declared == "date":
        name = name.when(parse_day(string).isNotNull(), "date")
    return make_cell(name.otherwise("text"), value_text(shape, declared, limited)).cast(CELL)


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lowered, F.lit(word.lower()))
    return found


def status_class(text: Column) -> Column:
    return (
        F.when(_mentions(text, DONE_WORDS), "done")
        .when(_mentions(text, PROGRESS_WORDS), "progress")
        .when(_mentions(text, BLOCKED_WORDS), "blocked")
    )


def priority_class(text: Column) -> Column:
    return F.when(_mentions(text, HIGH_WORDS), "high")
