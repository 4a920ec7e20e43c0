"""Output datasets: records per group and part, audit lines, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwork.config import JobConfig
from gridwork.operators.ordered import part_numbers
from gridwork.plans.harmonize import Harmonized
from gridwork.sources.listing import MARKER, qualified


class QualityGateError(RuntimeError):
    """The job found errors and its settings forbid an output with errors."""


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def check_target(spark: SparkSession, target: str, source: str | None, overwrite: bool) -> None:
    """Refuses to replace anything but an earlier output of this library, and to write into the
    sources."""
    target = qualified(spark, target)
    if source is not None:
        inside = qualified(spark, source) + "/"
        if inside.startswith(target + "/"):
            raise ValueError("the output would replace its sources")
    if not path_exists(spark, target):
        return
    if not overwrite:
        raise FileExistsError(f"output exists: {target}")
    if not path_exists(spark, f"{target}/{MARKER}"):
        raise ValueError(f"not an earlier output, so it is not overwritten: {target}")


def quality_gate(event: DataFrame, cfg: JobConfig) -> None:
    """In strict mode stop before the write if any error was logged."""
    if cfg.fail_on_error and not event.where(F.col("level") == "ERROR").isEmpty():
        raise QualityGateError("errors were logged; no output is written")


def mark_output(spark: SparkSession, target: str) -> None:
    spark.range(1).select(F.lit("gridwork").alias("value")).write.mode("overwrite").text(f"{target}/{MARKER}")


# Spark types of cell types; whole and other numbers together are floating.
COLUMN_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz"}


def column_types(record: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """The Spark type of each column: that of its cells if they agree, else text. One pass; what
    comes to the driver is one short list per column."""
    kinds = record.agg(*[F.collect_set(F.when(F.col("values")[n]["v"].isNotNull(), F.col("values")[n]["t"])).alias(f"c{i}") for i, n in enumerate(names)])
    found = dict(zip(names, kinds.first()))
    types = {}
    for name, held in found.items():
        kind = "float" if set(held) == {"int", "float"} else held[0] if len(held) == 1 else "text"
        types[name] = COLUMN_TYPES.get(kind, "string")
    return types


def typed_columns(record: DataFrame, names: Sequence[str]) -> list[Column]:
    """The named values as columns of their types. A value that its column's type can't hold exactly,
    such as a whole number of more digits, makes the query fail rather than lose it."""
    return [F.col("values")[n]["v"].cast(kind).alias(n) for n, kind in column_types(record, names).items()]


def record_parts(record: DataFrame, cfg: JobConfig) -> DataFrame:
    """Schema columns by type, preserved columns as a map of typed cells, provenance, and the output
    part of each row."""
    numbered = part_numbers(record, "group", cfg.max_rows_per_part)
    known = F.array(*[F.lit(n) for n in cfg.names])
    extras = F.map_filter("values", lambda k, v: ~F.array_contains(known, k))
    columns = typed_columns(record, cfg.names)
    return numbered.select("group", "part", *columns, extras.alias("extras"), "file", "sheet", "row_no", "file_ord", "sheet_ord")


def write_records(record: DataFrame, cfg: JobConfig, path: str, mode: str = "errorifexists") -> None:
    """One folder per group and part. A part is bounded, so it is one task even if one group holds
    most rows; rows keep their source order inside it."""
    parts = record_parts(record, cfg)
    spread = parts.repartition("group", "part").sortWithinPartitions("group", "part", "file_ord", "sheet_ord", "row_no")
    spread.drop("file_ord", "sheet_ord").write.mode(mode).partitionBy("group", "part").parquet(path)


def audit_lines(result: Harmonized) -> DataFrame:
    """Events, header decisions and quarantined rows in one table, told apart by ``type``."""
    tagged = [
        part.select(F.lit(kind).alias("type"), "*")
        for kind, part in (("event", result.event), ("header", result.mapping), ("quarantine", result.quarantine))
    ]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)


def write_audit(result: Harmonized, path: str, mode: str = "errorifexists") -> None:
    audit_lines(result).write.mode(mode).json(path)


def write_csv_report(groups: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pattern report with a header line, in report order; without a byte order mark."""
    groups.orderBy(F.desc("count"), "mode", "pattern").select(
        "mode", "count", "pattern", "extensions", "examples"
    ).write.mode(mode).option("header", True).csv(path)


def write_texts(normalized: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rewritten files as a new dataset; sources are never changed in place."""
    normalized.write.mode(mode).parquet(path)


def write_report(
    result: Harmonized, target: str, source: str | None = None, overwrite: bool = False, audit_only: bool = False
) -> None:
    """Audit tables and records, or the audit tables alone. The quality gate comes before any write.
    Everything is written beside the target and moved there when it is complete, so an earlier
    output is replaced as a whole or not at all; its marker is written last."""
    spark = result.record.sparkSession
    check_target(spark, target, source, overwrite)
    if not audit_only:
        quality_gate(result.event, result.cfg)
    staged = f"{target.rstrip('/')}-{uuid.uuid4().hex}.staged"
    write_audit(result, f"{staged}/audit")
    if not audit_only:
        write_records(result.record, result.cfg, f"{staged}/records")
    mark_output(spark, staged)
    publish(spark, staged, target, lambda: check_target(spark, target, source, overwrite))


def _rename(spark: SparkSession, old: str, new: str) -> bool:
    system, place = _file_system(spark, old)
    return system.rename(place, _file_system(spark, new)[1])


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)


def _journal(target: str) -> str:
    return f"{target.rstrip('/')}.journal"


def _aside(target: str) -> str:
    return f"{target.rstrip('/')}.previous"


def recover_output(spark: SparkSession, target: str) -> None:
    """Ends what an interrupted ``publish`` began, as its journal says: without a new output in place the
    earlier one comes back, else the earlier one goes. Nothing happens without a journal."""
    if not path_exists(spark, _journal(target)):
        return
    if path_exists(spark, _aside(target)):
        if path_exists(spark, target):
            _delete(spark, _aside(target))
        elif not _rename(spark, _aside(target), target):
            raise OSError(f"the earlier output is at {_aside(target)} and could not be moved back")
    _delete(spark, _journal(target))


def publish(spark: SparkSession, staged: str, target: str, check: Callable[[], None] = lambda: None) -> None:
    """Puts a finished output in the place of an earlier one, which is renamed aside before and deleted only
    when the new one is in place. A journal beside them tells a later call what to end if this one is cut off;
    a move that fails brings the earlier output back at once."""
    recover_output(spark, target)
    check()
    earlier = path_exists(spark, target)
    if earlier:
        if path_exists(spark, _aside(target)):
            raise FileExistsError(f"not made by this library, so it is not deleted: {_aside(target)}")
        spark.range(1).select(F.lit(staged).alias("value")).write.mode("overwrite").text(_journal(target))
        if not _rename(spark, target, _aside(target)):
            _delete(spark, _journal(target))
            raise OSError(f"the output stays at {staged}; {target} could not be moved aside")
    moved = False
    try:
        moved = _rename(spark, staged, target)
    finally:
        # Whatever cut the move off: one of the two outputs is in place.
        recover_output(spark, target)
    if not moved:
        raise OSError(f"the output stays at {staged}; it could not be moved to {target}")
