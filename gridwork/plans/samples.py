"""Inputs for the registered queries, derived by Spark from whole benchmark tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwork.config import DEFAULT_SCHEMA, ColumnSpec, JobConfig
from gridwork.functions.cells import MISSING_RESULT, make_cell, null_cell, text_cell
from gridwork.session import computed_once, stored
from gridwork.sources.grid import grid_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The layout of the sample inputs: splits go by bytes, but rows by row groups, of which a table of millions
    of rows may have one, so the rows are dealt to all cores. Tables of many splits are left as they are."""
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def dealt(df: DataFrame, name: str) -> DataFrame:
    """The same for inputs that many jobs read: what few splits hold is dealt once, not anew by each job, which
    would wait each time for the few tasks that read it."""
    wide = spread(df)
    return df if wide is df else stored(wide, name)


def whole(value: Column) -> Column:
    return make_cell("int", value.cast("string"))


def choose(key: Column, *options: Column) -> Column:
    """Option number ``key`` modulo their count."""
    branch = F.when(key % len(options) == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        branch = branch.when(key % len(options) == i, option)
    return branch


# Three layouts of the same sheet: plain titles, a header over two rows with a title lost, other
# spellings without a company column.
TITLES_A = ["No.", "Entity", "Panel", "Reviewer Name", "Open / Closed", "My Company", "Notes"]
TITLES_B = [
    ["Panel", "Item", "Reviewer", "Open/Closed\nAçıklama", "Kurum", None],
    ["Name", "Number", "Name", None, None, None],
]
TITLES_B_AGAIN = ["Panel Name", "Number", "Reviewer Name", "Open/Closed", "Entity", None]
TITLES_C = ["Sıra No", "Varlık", "Pannel", "İnceleyen", "Open Closed", "Notes", "Notes"]
ORDERS_CONFIG = JobConfig()


def titles_row(titles: list[str | None]) -> Column:
    return F.array(*[null_cell() if t is None else text_cell(F.lit(t)) for t in titles])


def orders_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets: a file per year, a sheet per quarter, a row per order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.year("o_orderdate").alias("y"),
        F.quarter("o_orderdate").alias("q"),
    )
    orders = dealt(orders, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    number = F.when(key % 97 == 5, text_cell(F.lit("total"))).otherwise(whole(key))
    entity = text_cell(F.concat(F.lit("Customer#"), cust.cast("string")))
    panel = text_cell(F.col("o_orderpriority"))
    reviewer = text_cell(F.concat(F.lit(" Clerk "), (cust % 50).cast("string"), F.lit(" ")))
    status = text_cell(
        F.when(F.col("o_orderstatus") == "O", "  OpEn: waiting").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("pending open")
    )
    company = choose(cust, null_cell(), text_cell(F.lit(" ")), text_cell(F.lit("Ours")), text_cell(F.lit(MISSING_RESULT + " =A1")))
    note = F.when(key % 3 == 0, text_cell(F.concat(F.lit("note "), key.cast("string")))).otherwise(null_cell())
    layout = F.col("y") % 3
    data = (
        F.when(layout == 0, F.array(number, entity, panel, reviewer, status, company, note))
        .when(layout == 1, F.array(panel, number, reviewer, status, entity, note))
        .otherwise(F.array(number, entity, panel, reviewer, status, note, text_cell(F.lit("second"))))
    )
    again = F.when(layout == 0, titles_row(TITLES_A)).when(layout == 1, titles_row(TITLES_B_AGAIN)).otherwise(titles_row(TITLES_C))
    rows = orders.withColumn("row_no", key + 13).withColumn("cells", F.when(key % 500 == 250, again).otherwise(data))
    sheets = orders.select("y", "q").distinct()
    head = sheets.withColumn("row_no", F.lit(12)).withColumn(
        "cells",
        F.when(layout == 0, titles_row(TITLES_A)).when(layout == 1, titles_row(TITLES_B[1])).otherwise(titles_row(TITLES_C)),
    )
    upper = sheets.where(layout == 1).withColumn("row_no", F.lit(11)).withColumn("cells", titles_row(TITLES_B[0]))
    columns = ["y", "q", "row_no", "cells"]
    everything = reduce(DataFrame.unionByName, [part.select(*columns) for part in (rows, head, upper)])
    year = F.concat(F.lit("Y"), F.col("y").cast("string"))
    file = F.concat(year, F.lit("/orders.xlsx"))
    quarter = F.concat(F.lit("Q"), F.col("q").cast("string"))
    return grid_rows(everything, F.col("cells"), F.col("row_no"), file, quarter, group=year, sheet_ord=F.col("q"))


CUSTOMER_CONFIG = replace(
    JobConfig(),
    schema=(*DEFAULT_SCHEMA, ColumnSpec("Custom")),
    required_columns=("Custom",),
    id_regex="[0-9]+",
    drop_duplicates=True,
    dedup_keys=("Entity", "Panel", "Reviewer Name"),
)


def customer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sheets, a file per nation, with rows that break each rule in turn."""
    nation = table(spark, sf_dir, "nation")
    customer = dealt(table(spark, sf_dir, "customer"), "customer")
    key, kind = F.col("c_custkey"), F.col("c_custkey") % 20
    blank, custom = null_cell(), text_cell(F.lit("c"))
    name, segment = text_cell(F.lit("E")), text_cell(F.col("c_mktsegment"))
    reviewer = whole(F.floor("c_acctbal"))
    full = F.array(whole(key), name, segment, reviewer, custom, text_cell(F.col("c_name")))
    cells = (
        F.when(kind == 0, F.array(blank, text_cell(F.lit(" \t")), blank, blank, blank, blank))
        .when(kind == 1, F.array(text_cell(F.lit(" Genel  TOPLAM: ")), name, segment, blank, custom, blank))
        .when(kind == 2, F.array(blank, blank, blank, blank, custom, blank))
        .when(kind == 3, F.array(blank, blank, blank, blank, custom, text_cell(F.col("c_name"))))
        .when(kind == 4, F.array(whole(key), name, segment, reviewer, text_cell(F.lit(MISSING_RESULT + " =B1")), blank))
        .when(kind == 5, F.array(text_cell(F.concat(F.lit("x"), key.cast("string"))), name, segment, reviewer, custom, blank))
        .otherwise(full)
    )
    titles = titles_row(["No.", "Entity", "Panel", "Reviewer Name", "Custom", "Remark"])
    rows = customer.select(F.col("c_nationkey").alias("n"), (key + 13).alias("row_no"), cells.alias("cells"))
    head = nation.select(F.col("n_nationkey").alias("n"), F.lit(12).alias("row_no"), titles.alias("cells"))
    everything = head.unionByName(rows).join(F.broadcast(nation), F.col("n") == F.col("n_nationkey"))
    region = F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))
    file = F.concat(F.lit("nation_"), F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(".xlsx"))
    return grid_rows(everything, F.col("cells"), F.col("row_no"), file, F.lit("Data"), group=region)


FILL_CONFIG = replace(JobConfig(), fill_down=("Entity", "Panel"), require_any=("No.",), min_row_values=1)
# Here a filled value can decide whether a row stays, and with it what later rows are filled with.
FILL_DEPENDENT_CONFIG = replace(FILL_CONFIG, min_row_values=3, drop_duplicates=True, dedup_keys=("Entity", "Panel", "Reviewer Name"))


def fill_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in one sheet, with gaps in two columns, blank rows and total rows."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "orders")
    key = F.col("o_orderkey")
    number = F.when(key % 61 == 7, text_cell(F.lit("Total"))).otherwise(whole(key))
    entity = F.when(key % 4 == 0, text_cell(F.concat(F.lit("E"), F.col("o_custkey").cast("string")))).otherwise(null_cell())
    panel = F.when(key % 7 == 0, text_cell(F.col("o_orderpriority"))).otherwise(text_cell(F.lit(" ")))
    reviewer = F.when(key % 5 == 0, null_cell()).otherwise(text_cell(F.col("o_orderstatus")))
    blank = F.array(*[null_cell() for _ in range(4)])
    cells = F.when(key % 43 == 11, blank).otherwise(F.array(number, entity, panel, reviewer))
    rows = orders.select((key + 13).alias("row_no"), cells.alias("cells"))
    # The header stands above the order with the lowest key.
    titles = titles_row(["No.", "Entity", "Panel", "Reviewer Name"])
    head = orders.agg(F.min("o_orderkey")).select(F.lit(12).cast("long").alias("row_no"), titles.alias("cells"))
    return grid_rows(rows.unionByName(head), F.col("cells"), F.col("row_no"), F.lit("all.xlsx"), F.lit("Data"))


def issue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers as nested issue records: ``key, fields`` (JSON text)."""
    orders, customer = spread(table(spark, sf_dir, "orders")), table(spark, sf_dir, "customer")
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    number = F.col("o_orderkey").cast("string")

    def paragraph(*texts: Column) -> Column:
        nodes = F.array(*[F.struct(F.lit("text").alias("type"), t.alias("text")) for t in texts])
        return F.struct(F.lit("paragraph").alias("type"), nodes.alias("content"))

    document = F.struct(
        F.lit("doc").alias("type"),
        F.array(paragraph(F.lit("Order "), number, F.lit("  ")), paragraph(F.col("c_name"))).alias("content"),
    )
    comments = F.struct(
        F.array(
            F.struct(
                F.struct(F.col("c_name").alias("displayName")).alias("author"),
                day.alias("created"),
                F.col("o_orderpriority").alias("body"),
            ),
            F.struct(
                F.struct(F.lit("").alias("displayName")).alias("author"), F.lit("").alias("created"), F.lit("later").alias("body")
            ),
        ).alias("comments")
    )
    status = F.when(F.col("o_orderstatus") == "F", "Closed").when(F.col("o_orderstatus") == "O", "In Progress").otherwise("Blocked")
    due = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.lit("soon"))
    fields = F.struct(
        F.concat(F.lit("Order "), number).alias("summary"),
        F.struct(F.lit(1).alias("id"), status.alias("name")).alias("status"),
        F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "Highest").otherwise(F.col("o_orderpriority")).alias("value")).alias("priority"),
        F.struct(F.col("c_name").alias("displayName"), F.col("c_custkey").alias("key")).alias("assignee"),
        F.concat(day, F.lit("T03:04:05.000+0300")).alias("created"),
        due.alias("duedate"),
        F.array(F.col("c_mktsegment"), F.lit(""), F.col("o_orderstatus")).alias("labels"),
        F.col("o_custkey").alias("customfield_10016"),
        (F.col("o_orderstatus") == "F").alias("customfield_10017"),
        # Written with an exponent as soon as it has eight digits.
        F.round(F.col("o_totalprice") * 1000).alias("customfield_10018"),
        document.alias("description"),
        comments.alias("comment"),
    )
    return both.select(F.concat(F.lit("ORD-"), number).alias("key"), computed_once(F.to_json(fields)).alias("fields"))


def field_catalogue(issues: DataFrame) -> DataFrame:
    """Field ids with names and types. Ids come from the records; the wording is the sample's."""
    # Most records have the same fields, so their lists are told apart before they are taken to pieces.
    lists = issues.select(F.json_object_keys("fields").alias("ids")).distinct()
    ids = lists.select(F.explode("ids").alias("id")).distinct()
    names = {
        "customfield_10016": "Story Points",
        "customfield_10017": "Released",
        "customfield_10018": "Estimate",
        "duedate": "Due date",
        "comment": "Comment",
    }
    kinds = {"created": "datetime", "duedate": "date", "customfield_10016": "number", "labels": "array"}
    name = reduce(lambda c, kv: c.when(F.col("id") == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    kind = reduce(lambda c, kv: c.when(F.col("id") == kv[0], kv[1]), kinds.items(), F.when(F.lit(False), ""))
    return ids.select("id", name.otherwise(F.initcap("id")).alias("name"), kind.otherwise("string").alias("type"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with one file per order, its name in one of five styles."""
    key = F.col("o_orderkey").cast("string")
    day = F.col("o_orderdate")
    digest = F.md5(key.cast("binary"))
    uuid = F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"), F.substring(digest, 14, 3),
        F.lit("-a"), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12), F.lit(".json"),
    )
    style = F.substring("o_orderpriority", 1, 1)
    name = (
        F.when(style == "1", uuid)
        .when(style == "2", F.concat(F.lit("IMG_"), F.date_format(day, "yyyyMMdd"), F.lit("_1230 "), key, F.lit(".JPG")))
        .when(style == "3", F.concat(F.lit("scan "), F.date_format(day, "dd.MM.yyyy"), F.lit(" 12:30:45 "), key, F.lit(".pdf")))
        .when(style == "4", F.concat(F.lit("report_"), F.date_format(day, "yyyy-MM-dd"), F.lit("_v1.2_"), key, F.lit(".tar.gz")))
        .otherwise(F.concat(F.lit("Ölçüm notes-"), key))
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"))
    return orders.select(F.concat(F.col("o_orderstatus"), F.lit("/"), name).alias("path"))
