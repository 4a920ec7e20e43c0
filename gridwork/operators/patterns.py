"""Pattern groups over file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridwork.functions.patterns import add_patterns
from gridwork.session import stored

EXAMPLES = 5


def _long(files: DataFrame, path: str, case_sensitive: bool, ignore_suffix: bool) -> DataFrame:
    """Every file twice: under its literal and its structural pattern. Both modes share a pass, and counts and
    examples its result, as the rules cost far more than to write and read what they find."""
    named = stored(add_patterns(files.select(F.col(path).alias("path")), "path", case_sensitive, ignore_suffix), "patterns")
    modes = F.array(
        F.struct(F.lit("literal").alias("mode"), F.col("literal").alias("pattern")),
        F.struct(F.lit("structural").alias("mode"), F.col("structural").alias("pattern")),
    )
    return named.select("path", "extension", F.inline(modes))


def pattern_groups(
    files: DataFrame,
    path: str = "path",
    min_count: int = 1,
    case_sensitive: bool = False,
    ignore_suffix: bool = False,
    examples: int = EXAMPLES,
) -> DataFrame:
    """``mode, count, pattern, extensions, examples``: the report of both modes."""
    long = _long(files, path, case_sensitive, ignore_suffix)
    counted = long.groupBy("mode", "pattern", "extension").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "extension")))
    shown = F.transform(ranked, lambda e: F.concat(e["extension"], F.lit(":"), (-e["less"]).cast("string")))
    # One list entry per suffix of the pattern, already counted.
    groups = counted.groupBy("mode", "pattern").agg(
        F.sum("n").alias("count"), F.array_join(shown, "; ").alias("extensions")
    )
    groups = groups.where(F.col("count") >= min_count)
    return groups.join(_examples(long, examples), ["mode", "pattern"]).select(
        "mode", "count", "pattern", "extensions", "examples"
    )


def _examples(long: DataFrame, size: int) -> DataFrame:
    """The smallest paths per pattern. The rank limit is applied in every task before the shuffle,
    so a pattern that holds a third of all files sends a few rows per task."""
    ranked = Window.partitionBy("mode", "pattern").orderBy("path")
    few = long.select("mode", "pattern", "path").withColumn("rank", F.row_number().over(ranked))
    few = few.where(F.col("rank") <= size)
    listed = F.array_join(F.sort_array(F.collect_list("path")), " | ")
    return few.groupBy("mode", "pattern").agg(listed.alias("examples"))


def top_patterns(groups: DataFrame, mode: str, top: int) -> DataFrame:
    """The most frequent patterns of one mode; ties by pattern."""
    return groups.where(F.col("mode") == mode).orderBy(F.desc("count"), "pattern").limit(top)


def report_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("count"), "mode", "pattern")


def extension_counts(files: DataFrame, path: str = "path", case_sensitive: bool = False) -> DataFrame:
    """Files per suffix label, and the number of all files beside it."""
    named = add_patterns(files.select(F.col(path).alias("path")), "path", case_sensitive)
    counts = named.groupBy("extension").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count"))
    return counts.withColumn("total", total.scalar()).orderBy(F.desc("count"), "extension")
