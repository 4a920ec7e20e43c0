"""Typed cells: ``struct<t:string, v:string>`` with a type name and a text rendering.

Type names are ``text int float bool date datetime time duration``. A missing cell is a NULL
struct or a NULL ``v``. Booleans read ``True``/``False``, moments ``yyyy-MM-dd HH:mm:ss``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

CELL = T.StructType([T.StructField("t", T.StringType()), T.StructField("v", T.StringType())])
CELL_DDL = "struct<t:string,v:string>"

# The marker text of a formula without a stored result, the two display names for
# values that cannot be grouped, and the characters that count as blank space in text.
MISSING_RESULT = "[FORMÜL SONUCU OKUNAMADI]"
EMPTY_CATEGORY = "(Boş)"
UNREADABLE_CATEGORY = "(Formül sonucu okunamadı)"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Drop blank characters, line breaks included, on both ends."""
    return F.btrim(text, F.lit(BLANKS))


def null_cell() -> Column:
    return F.lit(None).cast(CELL)


def make_cell(kind: str | Column, text: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(text.isNotNull(), F.struct(kind.alias("t"), text.alias("v"))).otherwise(null_cell())


def text_cell(text: Column) -> Column:
    return make_cell("text", text.cast("string"))


def plain_number(text: Column) -> Column:
    """The text of a number without exponent; a fraction keeps one digit at least. Numbers beyond the
    38 digits that decimals have keep their exponent."""
    wide = F.coalesce(text.try_cast("decimal(38,18)").cast("string"), text.try_cast("decimal(38,0)").cast("string"))
    tiny = F.abs(text.try_cast("double")) < 1e-17
    exact = F.when(~tiny | (text.try_cast("double") == 0), F.regexp_replace(wide, r"(\.[0-9]*?)0+$", "$1"))
    shown = F.when(exact.endswith("."), F.concat(exact, F.lit("0"))).when(exact.contains("."), exact).otherwise(F.concat(exact, F.lit(".0")))
    return F.when(text.rlike("[eE]"), F.coalesce(shown, text)).otherwise(text)


def typed_cell(value: Column, kind: T.DataType) -> Column:
    """A cell from a Spark column of the given type."""
    if isinstance(kind, T.BooleanType):
        return make_cell("bool", F.when(value, "True").when(~value, "False"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return make_cell("int", value.cast("string"))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return make_cell("float", plain_number(value.cast("string")))
    if isinstance(kind, T.DateType):
        return make_cell("date", F.date_format(value, "yyyy-MM-dd"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(value, ".SSSSSS")
        return make_cell("datetime", F.concat(whole, F.when(micros == ".000000", "").otherwise(micros)))
    if isinstance(kind, T.DayTimeIntervalType):
        return make_cell("duration", value.cast("string"))
    return make_cell("text", value.cast("string"))


def nonempty(cell: Column) -> Column:
    """Holds a value: zero and false do, blank text does not."""
    text = cell["v"]
    # Most values begin with a printable ASCII character, which settles it.
    return F.coalesce(F.ascii(text).between(33, 126) | (strip(text) != ""), F.lit(False))


def usable(cell: Column) -> Column:
    """Holds a value that is not the marker of a formula without a result."""
    marked = (cell["t"] == "text") & cell["v"].startswith(MISSING_RESULT)
    return nonempty(cell) & ~F.coalesce(marked, F.lit(False))


def clean_cell(cell: Column, number_format: Column, trim_text: bool = True, keep_zeros: bool = True) -> Column:
    """Source cell to output cell: text trimmed, zero-padded number formats and numbers that
    would lose digits turned into text."""
    kind, text = cell["t"], cell["v"]
    lowered = F.lower(text)
    infinite = (kind == "float") & lowered.isin("nan", "inf", "-inf", "infinity", "-infinity")
    infinite_text = F.regexp_replace(lowered, "infinity", "inf")
    whole = F.when(kind == "int", F.regexp_extract(text, r"^-?[0-9]+$", 0)).when(
        kind == "float", F.expr("NULL") if not keep_zeros else _whole_number(text)
    )
    whole = F.when(whole != "", whole)
    negative = F.when(whole.startswith("-"), 1).otherwise(0)
    digits = F.regexp_replace(whole, "^-", "")
    room = F.length(number_format) - negative
    padded = F.concat(
        F.when(negative == 1, "-").otherwise(""), F.lpad(digits, F.greatest(F.length(digits), room), "0")
    )
    long_number = (kind == "int") & (F.length(text) >= 16) & (F.length(F.regexp_replace(text, "^-?0*", "")) >= 16)
    result = F.when((kind == "text"), make_cell("text", strip(text) if trim_text else text))
    result = result.when(infinite, make_cell("text", infinite_text))
    if keep_zeros:
        zero_format = F.coalesce(number_format.rlike("^0{2,20}$"), F.lit(False))
        result = result.when(zero_format & whole.isNotNull(), make_cell("text", padded))
    return result.when(long_number, make_cell("text", text)).otherwise(cell)


def _whole_number(text: Column) -> Column:
    """Integer text of a floating number without fraction, else NULL."""
    number = text.try_cast("double")
    exact = number.try_cast("decimal(38,0)")
    return F.when(number == F.floor(number), exact.cast("string"))


def category_text(cell: Column) -> Column:
    """Display name of a value when rows are counted by it."""
    kind, text = cell["t"], cell["v"]
    return (
        F.when(~nonempty(cell), EMPTY_CATEGORY)
        .when(~usable(cell), UNREADABLE_CATEGORY)
        .when(kind == "float", F.coalesce(_whole_number(text), text))
        .when(kind == "datetime", F.replace(text, F.lit(" "), F.lit("T")))
        .otherwise(strip(text))
    )


def json_text(text: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def cell_json(cell: Column) -> Column:
    """One cell as a JSON value."""
    kind, text = cell["t"], cell["v"]
    return F.coalesce(
        F.when(kind.isin("int", "float"), text).when(kind == "bool", F.lower(text)).otherwise(json_text(text)),
        F.lit("null"),
    )


def row_json(cells: Column) -> Column:
    """A physical row as a JSON array."""
    return F.concat(F.lit("["), F.array_join(F.transform(cells, cell_json), ", "), F.lit("]"))


def entries_json(entries: Column) -> Column:
    """Named cells ``array<struct<k, c>>`` as a JSON object in entry order."""
    parts = F.transform(entries, lambda e: F.concat(json_text(e["k"]), F.lit(": "), cell_json(e["c"])))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def fingerprint(entries: Column, keys: tuple[str, ...] = ()) -> Column:
    """Digest of names, types and values: text ``001`` and number ``1`` differ. Without keys all
    nonempty entries take part."""
    if keys:
        wanted = F.array(*[F.lit(k) for k in keys])
        listed = F.transform(
            wanted,
            lambda k: F.struct(k.alias("k"), F.get(F.filter(entries, lambda e: e["k"] == k), F.lit(0))["c"].alias("c")),
        )
    else:
        listed = F.array_sort(F.filter(entries, lambda e: nonempty(e["c"])))
    typed = F.transform(listed, lambda e: F.struct(e["k"].alias("k"), e["c"]["t"].alias("t"), e["c"]["v"].alias("v")))
    return F.sha2(F.to_json(typed, {"ignoreNullFields": "false"}), 256)


def column_letters(index: Column) -> Column:
    """0 → A, 25 → Z, 26 → AA, up to four letters."""
    def letter(value: Column) -> Column:
        return F.char(F.lit(65) + value)

    def digit(first: int, size: int) -> Column:
        return F.when(index >= first, letter(F.pmod(F.floor((index - first) / size), F.lit(26)))).otherwise("")

    # The n-letter names start at index 26 + 26² + … with n − 1 terms.
    return F.concat(digit(18278, 17576), digit(702, 676), digit(26, 26), letter(F.pmod(index, F.lit(26))))


def day_fraction(duration: Column) -> Column:
    """A day-time interval as a fraction of a day."""
    return _seconds(duration) / 86400


def _seconds(duration: Column) -> Column:
    day, hour = F.extract(F.lit("DAY"), duration), F.extract(F.lit("HOUR"), duration)
    minute, second = F.extract(F.lit("MINUTE"), duration), F.extract(F.lit("SECOND"), duration)
    return day * 86400 + hour * 3600 + minute * 60 + second.cast("double")


def moment_text(moment: Column, zone_text: Column | None = None) -> Column:
    """Output text of a moment: the ISO text is kept when it carries a zone, midnight is a date."""
    midnight = F.date_format(moment, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
    plain = F.when(midnight, F.date_format(moment, "yyyy-MM-dd")).otherwise(
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    )
    return plain if zone_text is None else F.coalesce(zone_text, plain)
