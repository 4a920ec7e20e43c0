"""Line-ending cleanup of whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwork.functions.text import unix_lines


def is_binary(content: Column) -> Column:
    """A NUL byte makes a file binary."""
    return F.contains(content, F.lit(bytes([0])))


def normalized_bytes(content: Column) -> Column:
    """CRLF to LF on the bytes, whatever the encoding: Latin-1 maps every byte to one character."""
    return F.encode(unix_lines(F.decode(content, "ISO-8859-1")), "ISO-8859-1")


def normalize_files(files: DataFrame) -> DataFrame:
    """``path, content`` files that are text, with the new content and whether it changed.
    Binary and unreadable (NULL) files are left out."""
    kept = files.where(F.col("content").isNotNull() & ~is_binary(F.col("content")))
    new = kept.withColumn("new_content", normalized_bytes(F.col("content")))
    return new.withColumn("changed", F.col("new_content") != F.col("content"))


def normalize_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """The same for decoded text columns."""
    kept = df.where(F.col(text).isNotNull() & ~F.contains(text, F.lit("\x00")))
    return kept.withColumn("new_text", unix_lines(F.col(text))).withColumn("changed", F.col("new_text") != F.col(text))


def change_counts(normalized: DataFrame) -> DataFrame:
    return normalized.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.col("changed").cast("long")), F.lit(0)).alias("converted")
    )
