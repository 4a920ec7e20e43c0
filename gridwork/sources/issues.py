"""Issue records from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwork.operators.flatten import Field
from gridwork.session import broadcast_if_small, computed_once, settle


def issue_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """``key, fields`` with ``fields`` as VARIANT; lines that are no JSON are left to
    ``line_failures``."""
    parsed = lines.select(F.try_parse_json(line).alias("issue")).where(F.col("issue").isNotNull())
    return parsed.select(
        F.try_variant_get("issue", "$.key", "string").alias("key"),
        F.try_variant_get("issue", "$.fields", "variant").alias("fields"),
    )


def line_failures(lines: DataFrame, line: str = "value", file: Column | None = None) -> DataFrame:
    """``group, file, sheet, row_no, detail`` of the lines that are no JSON; blank lines are none."""
    text = F.col(line)
    # Lines may be costly to make, and a filter on what is read of them would make them anew for each use.
    told = lines.withColumn("_bad", computed_once((F.trim(text) != "") & F.try_parse_json(line).isNull()))
    bad = told.where("_bad")
    nothing = F.lit(None).cast("string")
    detail = F.concat(F.lit("not JSON: "), F.substring(text, 1, 80))
    return bad.select(nothing.alias("group"), (nothing if file is None else file).alias("file"), nothing.alias("sheet"), F.lit(None).cast("long").alias("row_no"), detail.alias("detail"))


def checked_issues(lines: DataFrame, line: str = "value", file: str = "file") -> tuple[DataFrame, DataFrame]:
    """Issues of the files whose lines are all JSON, with their ``file``, and the failures of the others, of
    which no line is kept: one row per bad line, as ``harmonize`` takes them. """
    failures = settle(line_failures(lines, line, F.col(file)))
    bad = broadcast_if_small(settle(failures.select(F.col("file").alias(file)).distinct()))
    issue = computed_once(F.try_parse_json(line)).alias("issue")
    parsed = lines.join(bad, file, "left_anti").select(file, issue).where(F.col("issue").isNotNull())
    return parsed.select(
        file, F.try_variant_get("issue", "$.key", "string").alias("key"), F.try_variant_get("issue", "$.fields", "variant").alias("fields")
    ), failures


def read_checked_issues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Issues and failures of all files below a path; see ``checked_issues``."""
    return checked_issues(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of all lines below a path that are JSON; ``read_checked_issues`` also names the others and sets
    their files aside."""
    return issue_rows(spark.read.text(path))


def needed_ids(fields: list[Field]) -> list[str]:
    """The field ids to read, each once; ``summary`` if only the key and the address are wanted."""
    ids = list(dict.fromkeys(f.field_id for f in fields if f.field_id is not None))
    return ids or ["summary"]


def pick(issues: DataFrame, project: Column, created: Column) -> DataFrame:
    """Issues that satisfy the project predicate, newest first."""
    return issues.where(project).orderBy(created.desc())
