"""Text lengths per column, for column widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridwork.functions.text import lines

# Length of a moment, bounds and least widths.
MOMENT_LENGTH = 19
NARROWEST, WIDEST = 12, 55


def rendered_length(value: Column, kind: T.DataType) -> Column:
    """Length of the longest line of a value as text."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.when(value.isNotNull(), F.lit(MOMENT_LENGTH)).otherwise(0)
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.array_max(F.transform(lines(text), F.length))


def length_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, longest_line`` in one pass over all rows."""
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    longest = df.agg(*[F.max(rendered_length(F.col(c), kinds[c])).cast("long").alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("longest_line")) for c in columns])
    return longest.select(F.inline(pairs)).select("column", F.coalesce("longest_line", F.lit(0)).alias("longest_line"))


def column_width(header: Column, longest: Column, kind: Column | None = None) -> Column:
    """Display width of a column from its title, its longest line and its kind (``key``, ``url``,
    ``datetime``, ``date``)."""
    name = F.lower(header)
    kind = F.lit("") if kind is None else F.coalesce(kind, F.lit(""))
    width = F.greatest(F.length(header), longest) + 2
    width = F.greatest(width, F.when(F.contains(name, F.lit("summary")), 35).otherwise(0))
    wordy = F.contains(name, F.lit("description")) | F.contains(name, F.lit("comment"))
    width = F.greatest(width, F.when(wordy, 45).otherwise(0))
    width = F.greatest(width, F.when(kind == "key", 14).when(kind == "url", 35).when(kind.isin("datetime", "date"), 18).otherwise(0))
    return F.least(F.greatest(width, F.lit(NARROWEST)), F.lit(WIDEST))


def column_widths(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Widths judged by all rows in one pass."""
    profile = length_profile(df)
    given = F.create_map(*[F.lit(x) for pair in (kinds or {"": ""}).items() for x in pair])
    return profile.select("column", column_width(F.col("column"), F.col("longest_line"), given[F.col("column")]).alias("width"))
