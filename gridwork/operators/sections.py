"""Paragraph sequences split into sections at headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwork.functions.cells import strip
from gridwork.functions.text import safe_file_name
from gridwork.operators.ordered import chunk_of, last_before


def section_paragraphs(paragraphs: DataFrame, level: int = 1) -> DataFrame:
    """Every paragraph from the first heading of ``level`` on, with its section.

    Input ``doc_id, para_no, level, text``. Adds ``section`` (1, 2, …), ``title`` and
    ``file_name``. What precedes the first heading is dropped; documents without one vanish.
    """
    parts = paragraphs.withColumn("_chunk", chunk_of(F.col("para_no")))
    is_heading = F.col("level") == level
    title = F.when(is_heading, strip(F.col("text")))
    number = {"section": is_heading.cast("int")}
    seen = last_before(parts, ["doc_id"], "_chunk", "para_no", {"title": title}, number)
    seen = seen.where(F.col("section") > 0)
    own_title = F.coalesce(title, F.col("title_before.value"))
    return seen.select(
        "doc_id",
        "para_no",
        "level",
        "text",
        "section",
        own_title.alias("title"),
        section_file_name(F.col("section"), own_title).alias("file_name"),
        F.when(is_heading, F.col("para_no")).otherwise(F.col("title_before.at")).alias("first_para"),
    )


def section_file_name(number: Column, title: Column) -> Column:
    """Two-digit number and title; the number grows past 99."""
    return F.concat(F.format_string("%02d", number.cast("long")), F.lit("_"), safe_file_name(title))


def section_texts(paragraphs: DataFrame, level: int = 1, part_paragraphs: int | None = None) -> DataFrame:
    """One text per section, ``part`` 1. Where sections may outgrow a task, ``part_paragraphs`` asks for
    parts of that many paragraphs, or ``section_paragraphs`` gives the rows without joining them."""
    rows = section_paragraphs(paragraphs, level)
    if part_paragraphs is None:
        part = F.lit(1)
    else:
        part = F.floor((F.col("para_no") - F.col("first_para")) / part_paragraphs) + 1
    listed = F.array_sort(F.collect_list(F.struct("para_no", "text")))
    return (
        rows.withColumn("part", part.cast("long"))
        .groupBy("doc_id", "section", "title", "file_name", "part")
        .agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("paragraphs"))
    )
