"""Summaries of a harmonize job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwork.config import ColumnSpec, Workflow
from gridwork.functions.cells import category_text, nonempty, strip, usable

# The remainder bucket and the total row of reports.
OTHER = "Diğer kategoriler (toplam)"
GRAND_TOTAL = "GENEL TOPLAM"
FLOW_COUNTS = ["open", "closed", "our_company", "other_company", "unknown_status", "unknown_turn"]


def workflow_class(values: Column, flow: Workflow) -> tuple[Column, Column]:
    """Status (``open``, ``closed``, ``unknown_status``) and, for open rows, whose turn it is.

    ``values`` is the map of named cells: a company column the row does not have is unknown, one
    that is empty means our turn.
    """
    status, company = values[flow.status_column], values[flow.company_column]
    text = F.when((status["t"] == "text") & usable(status), F.lower(strip(status["v"])))
    text = F.coalesce(text, F.lit(""))
    state = (
        F.when(text.startswith(flow.closed_prefix.strip().lower()), "closed")
        .when(text.startswith(flow.open_prefix.strip().lower()), "open")
        .otherwise("unknown_status")
    )
    unread = ~F.map_contains_key(values, flow.company_column) | (nonempty(company) & ~usable(company))
    turn = F.when(unread, "unknown_turn").when(nonempty(company), "other_company").otherwise("our_company")
    return state, F.when(state == "open", turn)


def workflow_rollup(record: DataFrame, groups: DataFrame, flow: Workflow) -> DataFrame:
    """Counts per group and in total. Groups without records give zeros."""
    state, turn = workflow_class(F.col("values"), flow)
    tagged = record.select("group", state.alias("state"), turn.alias("turn"))
    # Two levels: the rows combine per class before anything is summed up.
    counted = tagged.groupBy("group", "state", "turn").agg(F.count(F.lit(1)).alias("n"))
    sums = [
        F.coalesce(F.sum(F.when((F.col("state") == c) | (F.col("turn") == c), F.col("n"))), F.lit(0)).alias(c)
        for c in FLOW_COUNTS
    ]
    per_group = counted.groupBy("group").agg(*sums)
    listed = groups.select("group").distinct().join(per_group, "group", "left").fillna(0, FLOW_COUNTS)
    rolled = listed.rollup("group").agg(
        F.grouping_id().alias("level"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FLOW_COUNTS]
    )
    label = F.when(F.col("level") == 1, GRAND_TOTAL).otherwise(F.col("group"))
    return rolled.select(label.alias("group"), (F.col("level") == 1).alias("is_total"), *FLOW_COUNTS)


def group_stats(
    record: DataFrame,
    groups: DataFrame,
    segment: DataFrame,
    event: DataFrame,
    quarantine: DataFrame,
    schema: tuple[ColumnSpec, ...],
) -> DataFrame:
    """Records, files, tables, filled share, warnings and quarantined rows per group. Each side is
    aggregated on its own before the join."""
    filled = sum((F.coalesce(usable(F.col("values")[s.name]), F.lit(False)).cast("long") for s in schema), F.lit(0))
    records = record.groupBy("group").agg(F.count(F.lit(1)).alias("records"), F.sum(filled).alias("filled"))
    files = segment.groupBy("group", "file", "sheet").agg(F.count(F.lit(1)).alias("_n"))
    files = files.groupBy("group", "file").agg(F.count("_n").alias("sheets")).groupBy("group")
    files = files.agg(F.count("file").alias("files"), F.sum("sheets").alias("sheets"))
    warned = event.where(F.col("level").isin("WARNING", "ERROR")).groupBy("group").agg(F.count(F.lit(1)).alias("warnings"))
    set_aside = quarantine.groupBy("group").agg(F.count(F.lit(1)).alias("quarantined"))
    table = groups.select("group", F.col("files_found").alias("found"))
    for side in (records, files, warned, set_aside):
        table = table.join(side, "group", "left")
    table = table.fillna(0, ["records", "filled", "files", "sheets", "warnings", "quarantined"])
    possible = F.col("records") * len(schema)
    return table.select(
        "group",
        "records",
        "files",
        "found",
        "sheets",
        "filled",
        possible.alias("possible"),
        share(F.col("filled"), possible).alias("completeness"),
        "warnings",
        "quarantined",
    )


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def report_totals(stats: DataFrame, segment: DataFrame, event: DataFrame) -> DataFrame:
    """The figures of the whole report in one row."""
    sums = stats.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("found_files"),
        F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"),
        F.coalesce(F.sum("possible"), F.lit(0)).alias("possible"),
        F.coalesce(F.sum("quarantined"), F.lit(0)).alias("quarantined"),
    )
    files = segment.select("file").distinct().agg(F.count("file").alias("processed_files"))
    levels = event.agg(
        F.count(F.when(F.col("level") == "WARNING", 1)).alias("warnings"),
        F.count(F.when(F.col("level") == "ERROR", 1)).alias("errors"),
    )
    row = sums.withColumns(
        {
            "processed_files": files.scalar(),
            "warnings": levels.select("warnings").scalar(),
            "errors": levels.select("errors").scalar(),
        }
    )
    return row.withColumn("completeness", share(F.col("filled"), F.col("possible"))).withColumn(
        "verdict", verdict(F.col("errors"), F.col("warnings"), F.col("quarantined"))
    )


def verdict(errors: Column, warnings: Column, quarantined: Column) -> Column:
    return F.when(errors > 0, "incomplete").when((warnings > 0) | (quarantined > 0), "review").otherwise("ok")


def event_counts(event: DataFrame) -> DataFrame:
    return event.groupBy("level", "code").agg(F.count(F.lit(1)).alias("count"))


def category_counts(record: DataFrame, dimension: str | None = None) -> DataFrame:
    """Records per value of a column, or per group without one."""
    label = F.col("group") if dimension is None else category_text(F.col("values")[dimension])
    return record.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"))


def top_categories(counts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent labels in order, the rest summed up in one more row.

    The rest is the grand total less the top, so only the top is ever sorted; it is found per
    task first. Returns ``place, label, count``.
    """
    order = [F.desc("count"), F.lower("label"), F.col("label")]
    top = counts.orderBy(*order).limit(limit)
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    # The label of the rest grows by * until no category is called like it.
    alike = F.col("label").rlike("^" + OTHER.replace("(", r"\(").replace(")", r"\)") + r"\**$")
    everything = counts.agg(
        F.sum("count").alias("all"),
        F.count(F.lit(1)).alias("labels"),
        F.collect_set(F.when(alike, F.length("label"))).alias("taken"),
    )
    lengths = F.sequence(F.lit(len(OTHER)), F.lit(len(OTHER)) + F.size("taken"))
    rest = everything.where(F.col("labels") > limit).select(
        F.lit(limit + 1).cast("long").alias("place"),
        F.rpad(F.lit(OTHER), F.array_min(F.array_except(lengths, F.col("taken"))), "*").alias("label"),
        (F.col("all") - top.agg(F.sum("count")).scalar()).alias("count"),
    )
    return ranked.select("place", "label", "count").unionByName(rest)
