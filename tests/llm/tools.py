"""Small tables with awkward rows for the tests of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Names that the operators use for their own columns.
CLASHING = ("row", "id", "size", "rank", "q", "licenses", "class", "list", "node", "units", "place", "source_key", "lang_key", "word")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text[, lang[, source]]) as documents, with extra columns whose names clash."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    docs = spark.createDataFrame(full, DOCS)
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def messy(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return documents(
        spark,
        [
            (1, "One two three four five six."),
            (1, "One two three four five six."),
            (1, "other words under the same id"),
            (2, None),
            (3, ""),
            (4, " \n\t "),
            (5, long),
            (6, "short", None, None),
            (None, "no id here", "en", None),
            (None, "no id here", "en", None),
            (7, "Ünï ☃ 日本 🙂 <|endoftext|> it's", "xx", "t"),
        ],
    )


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
