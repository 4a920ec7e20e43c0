"""From a folder of text files to a written report, in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession, functions as F

from gridwork.config import JobConfig
from gridwork.plans.harmonize import event, harmonize
from gridwork.session import settle
from gridwork.sinks.outputs import check_target, recover_output, write_report
from gridwork.sources.grid import group_by_sheet_name, parse_failures, parse_texts, parsed_grid
from gridwork.sources.listing import (
    acceptable,
    assign_groups,
    list_files,
    listed_groups,
    own_outputs,
    read_texts,
    skip_own_outputs,
    visible_files,
)


@dataclass(frozen=True)
class Counters:
    """What a run found and set aside."""

    files: int
    records: int
    quarantined: int
    warnings: int
    errors: int


def run_report(
    spark: SparkSession, source: str, target: str, cfg: JobConfig | None = None, delimiter: str = ",", overwrite: bool = False, audit_only: bool = False
) -> Counters:
    """Lists a folder, reads its text files, harmonizes them and writes records and audit tables.

    Files of earlier outputs and, unless wanted, files beside the folders are skipped with an event. A
    file that can't be read or parsed gives an error event and no rows; in strict mode nothing is
    written then."""
    cfg = (cfg or JobConfig()).check()
    # A target that can't be written is known before any work.
    recover_output(spark, target)
    check_target(spark, target, source, overwrite)
    everything = settle(list_files(spark, source))
    kept, skipped = skip_own_outputs(everything, own_outputs(everything))
    files, left_out = assign_groups(acceptable(visible_files(kept), cfg), cfg)
    files = settle(files)
    seen = skipped.withColumn("file", F.col("path"))
    outside = left_out.withColumn("file", F.col("path"))
    events = event(seen, "INFO", "PREVIOUS_REPORT_SKIPPED", "part of an earlier output").unionByName(
        event(outside, "WARNING", "ROOT_FILE_SKIPPED", "not inside a folder")
    )
    parsed = settle(parse_texts(read_texts(files, spark, source), delimiter))
    grid = parsed_grid(parsed)
    groups = None
    if cfg.group_mode == "sheet_name":
        grid = group_by_sheet_name(grid)
    else:
        names = kept.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("group")).where("group != ''")
        groups = listed_groups(files, names)
    result = harmonize(grid, cfg, groups=groups, failures=parse_failures(parsed), listing_events=events)
    write_report(result, target, source, overwrite, audit_only)
    levels = result.event.agg(*[F.count(F.when(F.col("level") == level, 1)) for level in ("WARNING", "ERROR")]).first()
    return Counters(files.count(), result.record.count(), result.quarantine.count(), *levels)
