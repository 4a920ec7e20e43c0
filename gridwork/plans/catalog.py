"""The registered queries: every operator on whole benchmark tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwork.config import ColumnSpec, JobConfig, Workflow
from gridwork.functions import cells as C
from gridwork.functions.issues import add_value_texts, document_text, priority_class, status_class
from gridwork.functions.paths import media_class, name_parts
from gridwork.functions.text import limit_text, pieces, safe_file_name
from gridwork.operators import flatten, line_endings, matching, patterns, profile, rows, sections, stats, worklist
from gridwork.operators.ordered import part_numbers
from gridwork.plans import audits, samples
from gridwork.plans.harmonize import Harmonized, harmonize
from gridwork.plans.report import run_report
from gridwork.plans.samples import table
from gridwork.session import checkpoint_dir, computed_once, settle
from gridwork.sinks.outputs import audit_lines
from gridwork.sources import listing
from gridwork.sources.grid import group_by_sheet_name, merge_formulas
from gridwork.sources.issues import pick


# Harmonize


def _orders(spark: SparkSession, sf_dir: str, keep_rows: bool = False) -> Harmonized:
    return harmonize(samples.orders_grid(spark, sf_dir), samples.ORDERS_CONFIG, keep_rows=keep_rows)


def harmonize_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge all order sheets and count open, closed and whose turn it is, per year and in total."""
    result = _orders(spark, sf_dir)
    return stats.workflow_rollup(result.record, result.groups, result.cfg.workflow)


def harmonize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _orders(spark, sf_dir)
    value = {name: F.col("values")[name]["v"] for name in (*result.cfg.names, "Ek | Notes", "Ek | Notes [2]", "Ek | Başlıksız F")}
    names = ["no", "entity", "panel", "ata", "reviewer", "status", "company", "notes", "notes_2", "untitled"]
    return result.record.select(
        "group", "file", "sheet", "row_no", *[v.alias(n) for v, n in zip(value.values(), names)]
    ).withColumnRenamed("group", "grp")


def harmonize_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = _orders(spark, sf_dir).mapping
    return mapping.select(
        "file", "sheet", F.col("header_row").cast("long").alias("header_row"), "height", "source_column", "title", "target", "state"
    )


def harmonize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.event_counts(_orders(spark, sf_dir, keep_rows=True).event)


def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _orders(spark, sf_dir, keep_rows=True)
    table = stats.group_stats(r.record, r.groups, r.segment, r.event, r.quarantine, r.cfg.schema)
    return table.withColumn("completeness", F.round("completeness", 6)).withColumnRenamed("group", "grp")


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _orders(spark, sf_dir, keep_rows=True)
    per_group = stats.group_stats(r.record, r.groups, r.segment, r.event, r.quarantine, r.cfg.schema)
    totals = stats.report_totals(per_group, r.segment, r.event)
    return totals.withColumn("completeness", F.round("completeness", 6))


def row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason of every rejected customer row, with the row as JSON."""
    result = harmonize(samples.customer_grid(spark, sf_dir), samples.CUSTOMER_CONFIG, keep_rows=True)
    return result.quarantine.withColumnRenamed("group", "grp")


def audit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = harmonize(samples.customer_grid(spark, sf_dir), samples.CUSTOMER_CONFIG, keep_rows=True)
    label = F.coalesce("code", "state", F.split("reason", ":")[0])
    return audit_lines(result).groupBy("type", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill two columns from above in one sheet that holds every order."""
    return _filled(spark, sf_dir, samples.FILL_CONFIG)


def fill_down_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheet under rules that read the filled values, duplicates among them."""
    return _filled(spark, sf_dir, samples.FILL_DEPENDENT_CONFIG)


def _filled(spark: SparkSession, sf_dir: str, cfg: JobConfig) -> DataFrame:
    result = harmonize(samples.fill_grid(spark, sf_dir), cfg, keep_rows=False)
    value = F.col("values")
    return result.record.select(
        "row_no",
        value["No."]["v"].alias("no"),
        F.trim(value["Entity"]["v"]).alias("entity"),
        F.nullif(F.trim(value["Panel"]["v"]), F.lit("")).alias("panel"),
        value["Reviewer Name"]["v"].alias("reviewer"),
    )


def sheet_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group order sheets by name over all files, and keep their rows per group."""
    grid = samples.orders_grid(spark, sf_dir)
    mixed = grid.withColumn("sheet", F.when(F.col("file") > "Y1997", F.lower("sheet")).otherwise(F.col("sheet")))
    grouped = group_by_sheet_name(mixed)
    return grouped.groupBy(F.col("group").alias("grp")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("file").alias("files"), F.countDistinct("sheet").alias("spellings")
    )


def _part_schema() -> JobConfig:
    names = ("Small Ring", "Red Widget", "Blue Bolt", "Green Gear")
    return replace(JobConfig(), schema=tuple(ColumnSpec(n) for n in names), min_header_matches=1, header_anchors=(), min_header_anchors=0,
                   require_any=(), id_column=None, workflow=Workflow(enabled=False)).check()


def header_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name equals a declared title, whatever case, punctuation and later lines."""
    raw = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(" - "))), F.lit("\n"), F.col("p_type"))
    part = table(spark, sf_dir, "part").withColumn("raw", raw)
    decided = matching.score_titles(part.select("raw"), _part_schema(), full=False)
    exact = decided.where(F.col("score") == 100).select("raw", "target", "state")
    return part.join(exact, "raw").groupBy("target", "state").agg(F.count(F.lit(1)).alias("parts"))


# Summaries


def _order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "  OpEn since") .when(F.col("o_orderstatus") == "F", "CLOSED: done").otherwise("pending open")
    company = samples.choose(
        F.col("o_custkey"), C.null_cell(), C.text_cell(F.lit(" ")), C.text_cell(F.lit("x")), samples.whole(F.lit(0)),
        C.text_cell(F.lit(C.MISSING_RESULT + " =A1")),
    )
    with_company = F.create_map(F.lit("Open / Closed"), C.text_cell(status), F.lit("My Company"), company)
    without = F.create_map(F.lit("Open / Closed"), C.text_cell(status))
    return orders.select(
        F.col("o_orderpriority").alias("group"),
        F.when(key % 11 == 0, without).otherwise(with_company).alias("values"),
    )


def workflow_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = _order_records(spark, sf_dir)
    groups = record.select("group").union(table(spark, sf_dir, "region").select("r_name"))
    return stats.workflow_rollup(record, groups, Workflow())


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled cells of customer records per nation; suppliers in debt stand for quarantined rows."""
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    schema = (ColumnSpec("name"), ColumnSpec("balance"), ColumnSpec("segment"))
    values = F.create_map(
        F.lit("name"), C.text_cell(F.col("c_name")),
        F.lit("balance"), C.typed_cell(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), customer.schema["c_acctbal"].dataType),
        F.lit("segment"), C.text_cell(F.nullif("c_mktsegment", F.lit("MACHINERY"))),
    )
    group = F.col("n_name").alias("group")
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    record = people.select(group, F.col("c_mktsegment").alias("file"), values.alias("values"))
    segment = record.select("group", "file", F.lit("Data").alias("sheet"))
    debtors = supplier.where("s_acctbal < 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(group)
    warned = people.where("c_acctbal < 0").select(group, F.lit("WARNING").alias("level"))
    groups = nation.select(group, F.col("n_regionkey").cast("long").alias("files_found"))
    found = stats.group_stats(record, groups, segment.distinct(), warned, debtors, schema)
    return found.withColumn("completeness", F.round("completeness", 6)).withColumnRenamed("group", "grp")


def topn_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten customers with most orders, and all others together."""
    orders = table(spark, sf_dir, "orders")
    values = F.create_map(F.lit("customer"), C.typed_cell(F.col("o_custkey"), orders.schema["o_custkey"].dataType))
    record = orders.select(F.col("o_orderpriority").alias("group"), values.alias("values"))
    return stats.top_categories(stats.category_counts(record, "customer"), 10)


def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("group"))
    return stats.top_categories(stats.category_counts(events), 3)


def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names of mixed values: whole floats, blanks, unreadable results, days."""
    lineitem = table(spark, sf_dir, "lineitem")
    kinds = {f.name: f.dataType for f in lineitem.schema.fields}
    day = F.to_date("l_shipdate")
    value = samples.choose(
        F.col("l_partkey"), C.typed_cell(F.col("l_quantity"), kinds["l_quantity"]), C.text_cell(F.lit(" \n")),
        C.text_cell(F.lit(C.MISSING_RESULT + " =B2")), C.text_cell(F.concat(F.lit("  "), F.col("l_returnflag"), F.lit(" "))),
        C.make_cell("date", F.date_format(day, "yyyy-MM-dd")),
    )
    record = lineitem.select(F.col("l_linestatus").alias("group"), F.create_map(F.lit("x"), value).alias("values"))
    return stats.category_counts(record, "x")


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose exact text came before in the same source."""
    docs = table(spark, sf_dir, "documents")
    entry = F.array(F.struct(F.lit("text").alias("k"), C.text_cell(F.col("text")).alias("c")))
    marked = docs.select(
        F.col("source").alias("group"), F.col("lang").alias("file_ord"), F.lit(0).alias("sheet_ord"), F.col("doc_id").alias("row_no"),
        F.col("lang").alias("file"), F.lit("Data").alias("sheet"), C.fingerprint(entry).alias("mark"),
    )
    return rows.later_copies(marked).select(F.col("file").alias("lang"), F.col("row_no").alias("doc_id"))


def cell_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number formats, long numbers and blanks around text, over all line items."""
    item = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    value = samples.choose(
        part, samples.whole(part), samples.whole(-part), C.make_cell("float", F.concat(part.cast("string"), F.lit(".0"))),
        C.make_cell("int", F.concat(F.lit("9000000000"), F.lpad(part.cast("string"), 8, "0"))),
        C.text_cell(F.concat(F.lit("\t "), F.col("l_returnflag"), F.lit("\n"))), C.make_cell("float", F.lit("NaN")),
    )
    number_format = F.when(F.col("l_linenumber") % 2 == 0, "000000").otherwise("General")
    cells_ = item.select(computed_once(value).alias("cell"), number_format.alias("fmt"))
    cleaned = cells_.select(computed_once(C.clean_cell(F.col("cell"), F.col("fmt"))).alias("cell"))
    shown = cleaned.select(F.col("cell.t").alias("kind"), F.col("cell.v").alias("shown"))
    return shown.groupBy("kind", "shown").agg(F.count(F.lit(1)).alias("n"))


def out_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output part of every order: at most 1,000 orders of a status per part, in source order."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("file_ord"),
        F.month("o_orderdate").alias("sheet_ord"), F.col("o_orderkey").alias("row_no"),
    )
    return part_numbers(orders, "grp", 1000).select("grp", "row_no", F.col("part").cast("long").alias("part"))


# Names, listings, worklists


def pattern_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pattern_groups(samples.order_files(spark, sf_dir), min_count=2)


def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = patterns.pattern_groups(samples.order_files(spark, sf_dir), min_count=2, ignore_suffix=True)
    return patterns.top_patterns(groups, "structural", 5).select("count", "pattern", "extensions")


def extension_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.extension_counts(table(spark, sf_dir, "pages"), "url")


def _document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    name = samples.choose(
        key, F.concat(key, F.lit(".csv")), F.concat(key, F.lit(".CSV")), F.concat(F.lit("~$"), key, F.lit(".csv")),
        F.concat(key, F.lit(".tar.gz")), F.concat(F.lit("."), key, F.lit(".csv")), F.concat(key, F.lit(".tmp.csv")), key.cast("string"),
    )
    folder = F.when(key % 13 == 0, F.concat("source", F.lit("/.git/"))).when(key % 17 == 0, F.lit("")).otherwise(
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"))
    )
    return table(spark, sf_dir, "documents").select(F.concat(folder, name).alias("path"))


def listing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files per group out of a listing with hidden, excluded and temporary files."""
    cfg = replace(JobConfig(), include_root_files=True, root_group="src1")
    files = listing.acceptable(listing.visible_files(_document_listing(spark, sf_dir)), cfg)
    grouped, _ = listing.assign_groups(files, cfg)
    return listing.listed_groups(grouped).withColumnRenamed("group", "grp")


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV files in a folder per nation, some of them malformed, run through the whole job
    and read back from what it wrote."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    place = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").alias("nation"), F.col("c_custkey").alias("No."), F.col("c_name").alias("Entity"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("Panel"), F.col("c_acctbal").alias("Balance"),
    )
    people.repartition("nation").write.partitionBy("nation").option("header", True).csv(f"{place}/in")
    broken = nation.where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("nation"), F.lit('No.,Entity,Panel\n1,"open,x').alias("value"))
    broken.write.mode("append").partitionBy("nation").option("lineSep", "\n").format("text").save(f"{place}/in")
    cfg = JobConfig(expected_header_row=1, search_end=1, header_heights=(1,), extensions=(".csv", ".txt"), require_any=())
    run_report(spark, f"{place}/in", f"{place}/out", cfg)
    records = spark.read.parquet(f"{place}/out/records")
    audit = spark.read.json(f"{place}/out/audit").where("type = 'event' AND level = 'ERROR'").groupBy("group").agg(F.count("*").alias("errors"))
    found = records.groupBy("group").agg(
        F.count("*").alias("records"), F.sum(F.col("`No.`").cast("long")).alias("keys"), F.count("Panel").alias("panels"),
        F.round(F.sum(F.col("extras")["Ek | Balance"]["v"].cast("double")), 2).alias("balance"),
    )
    return found.join(audit, "group", "left").select(F.substring("group", 8, 9).cast("long").alias("nation"), "records", "keys", "panels", "balance", F.coalesce("errors", F.lit(0)).alias("errors"))


def skip_own_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left after folders with an output marker are skipped, per first folder."""
    files = _document_listing(spark, sf_dir)
    markers = table(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/" + listing.MARKER)).alias("path")
    ).where("lang = 'de'").distinct()
    everything = files.union(markers)
    kept, skipped = listing.skip_own_outputs(everything, listing.own_outputs(everything))
    first = F.regexp_extract("path", "^[^/]*", 0)
    both = kept.select(first.alias("top"), F.lit("kept").alias("outcome")).union(skipped.select(first, F.lit("skipped")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("files"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", safe_file_name(F.col("url")).alias("name"))


def name_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _document_listing(spark, sf_dir)
    parts = name_parts(F.regexp_extract("path", "[^/]*$", 0))
    return files.select("path", parts["stem"].alias("stem"), parts["suffix"].alias("suffix"))


def _media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    suffix = F.when(key % 3 == 0, ".mp4").when(key % 3 == 1, ".webm").otherwise(".WEBM")
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), key, suffix).alias("path"), key.alias("doc_id"))


def worklist_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convert all webm files but those a label row says are done already."""
    files, done = _media_listing(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    existing = files.join(done, "doc_id", "left_semi").select(F.regexp_replace("path", r"\.[^.]+$", ".mp3").alias("path"))
    plan = worklist.conversion_worklist(files.select("path"), existing, ".WebM", "mp3", recursive=True, delete_source=True)
    return plan.select("path", "target_path", "media", "action", "delete_source")


def worklist_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, done = _media_listing(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    results = files.join(done.withColumn("ok", F.lit(True)), "doc_id", "left").fillna(False, ["ok"])
    return worklist.outcome_counts(results)


def media_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.regexp_extract("path", r"\.[^.]+$", 0)
    return _media_listing(spark, sf_dir).groupBy(media_class(suffix).alias("media")).agg(F.count(F.lit(1)).alias("files"))


# Texts


def sections_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations split at user turns."""
    turns = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "user", 1).otherwise(10)
    paragraphs = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_no"), level.alias("level"), "text")
    return sections.section_texts(paragraphs, 1).select("doc_id", "section", "file_name", "part", "paragraphs", "text")


def sections_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut at closing tags and before main headings, split at the main heading."""
    marked = F.replace("html", F.lit("<h1>"), F.lit("</<h1>"))
    blocks = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(marked, "</")).alias("para_no", "text"))
    heading = F.startswith("text", F.lit("<h1>"))
    headed = blocks.withColumns({"level": F.when(heading, 1).otherwise(10), "text": F.when(heading, F.substring("text", 5, 2**30)).otherwise(F.col("text"))})
    return sections.section_paragraphs(headed, 1).groupBy("doc_id", "section", "file_name").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars")
    )


def eol_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as byte files, every other with CRLF, every tenth binary."""
    key = F.col("doc_id")
    text = F.when(key % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    content = F.when(key % 10 == 3, F.concat(F.encode(text, "UTF-8"), F.lit(bytes([0])))).otherwise(F.encode(text, "UTF-8"))
    files = table(spark, sf_dir, "documents").select(key.cast("string").alias("path"), content.alias("content"))
    return line_endings.normalize_files(files).select("path", F.md5("new_content").alias("digest"), "changed")


def eol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return line_endings.change_counts(line_endings.normalize_texts(table(spark, sf_dir, "documents").select(text.alias("text"))))


def truncate_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.md5(limit_text(F.col("text")).cast("binary")).alias("limited"), F.posexplode(pieces(F.col("text"))).alias("piece_no", "piece")
    ).select("doc_id", "limited", "piece_no", F.md5(F.col("piece").cast("binary")).alias("piece"))


def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest line per column of two whole tables."""
    orders = profile.length_profile(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    docs = profile.length_profile(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"])
    return orders.union(docs)


def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display widths judged by all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("Comment text"), "source", F.col("lang").alias("Summary of language"))
    return profile.column_widths(docs, {"doc_id": "key"})


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations as day fractions and moments as report texts."""
    events = table(spark, sf_dir, "events")
    gap = F.col("ts") - F.date_trunc("DAY", "ts")
    shown = C.moment_text(F.when(F.col("event_id") % 2 == 0, F.date_trunc("DAY", "ts")).otherwise(F.col("ts")))
    return events.select("event_id", F.round(C.day_fraction(gap), 9).alias("fraction"), shown.alias("shown"))


# Issues


REQUESTED = ["Key", "URL", "Summary", "Status", "priority", "Assignee", "Created", "Due date", "Labels", "Story Points",
             "Released", "Estimate", "Description", "Comment"]
SERVER = "https://tracker.example.com/"


def issue_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = samples.issue_json(spark, sf_dir)
    fields = flatten.resolve_fields(settle(samples.field_catalogue(issues)), REQUESTED)
    flat = flatten.flatten_issues(issues, fields, SERVER)
    named = flat.select(*[F.col(c).alias(c.lower().replace(" ", "_")) for c in flat.columns])
    return named.withColumn("status_class", status_class(F.col("status"))).withColumn("priority_class", priority_class(F.col("priority")))


def field_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = samples.issue_json(spark, sf_dir)
    wide = flatten.named_fields(issues, settle(samples.field_catalogue(issues)), ["Summary", "Story Points", "Released", "Labels"])
    return wide.select("key", F.col("Summary").alias("summary"), F.col("Story Points").alias("points"), F.col("Released").alias("released"), F.col("Labels").alias("labels"))


def issue_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of one project in order of creation, as picked from the source."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    picked = pick(orders, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))
    return picked.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


def doc_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as document trees, one list item per line, and back to text."""
    node = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))
    leaf = lambda line: F.struct(F.lit("text").alias("type"), F.concat(line, F.lit("  ")).alias("text"))
    items = F.transform(F.split("text", "\n"), lambda line: node("listItem", F.array(node("paragraph", F.array(leaf(line))))))
    tree = node("doc", F.array(node("bulletList", items)))
    parsed = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.parse_json(F.to_json(tree)).alias("tree"))
    return parsed.select("conv_id", "turn", C.strip(document_text(F.col("tree"))).alias("text"))


def comment_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two comments per order line made of JSON, rendered as a thread."""
    author = F.struct(F.lit("").alias("displayName"), F.concat(F.lit("supplier "), F.col("l_suppkey")).alias("name"))
    first = F.struct(author.alias("author"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("created"), F.col("l_returnflag").alias("body"))
    bare = F.struct(F.lit("").alias("displayName"), F.lit("").alias("name"))
    second = F.struct(bare.alias("author"), F.lit("").alias("created"), F.concat(F.lit("qty "), F.col("l_linenumber")).alias("body"))
    lines = samples.spread(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_linenumber"))
    threads = lines.select(F.parse_json(F.to_json(F.struct(F.array(first, second).alias("comments")))).alias("v"))
    texts = add_value_texts(threads, [F.col("v")], "texts")
    return texts.groupBy(F.get("texts", F.lit(0))["text"].alias("thread")).agg(F.count(F.lit(1)).alias("n"))


def formula_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula grid and a value grid with rows and cells missing on either side, aligned."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    ids = [F.col("o_orderstatus").alias("file"), F.lit("Data").alias("sheet"), key.alias("row_no")]
    formula = C.make_cell("formula", F.concat(F.lit("=A"), key.cast("string")))
    formulas = orders.where(key % 5 != 0).select(*ids, F.array(samples.whole(key), formula).alias("formulas"))
    value = F.when(key % 3 == 0, C.null_cell()).otherwise(C.text_cell(F.col("o_orderpriority")))
    values = orders.where(key % 7 != 0).select(*ids, F.array(samples.whole(key), value, C.text_cell(F.lit("tail"))).alias("values"))
    merged = merge_formulas(formulas, values)
    return merged.select("file", "row_no", C.row_json(F.col("cells")).alias("cells"), F.size("missing").alias("missing"),
                         F.get(F.col("missing"), F.lit(0))["formula"].alias("formula"))


QUERIES = {
    f.__name__: f
    for f in (
        harmonize_workflow, harmonize_records, harmonize_mapping, harmonize_events, group_report, report_totals, row_rules,
        audit_union, fill_down, fill_down_dependent, sheet_name_groups, header_exact, workflow_rollup, completeness, topn_other,
        top_groups, category_names, dedup_keep_first, cell_cleaning, out_parts, pattern_groups, top_patterns,
        extension_distribution, listing_groups, written_report, skip_own_outputs, safe_names, name_splits, worklist_plan, worklist_outcome,
        media_classes, sections_chat, sections_html, eol_normalize, eol_counts, truncate_chunk, field_profile, column_widths,
        moments, issue_flatten, field_naming, issue_pick, doc_tree_text, comment_threads, formula_merge,
    )
} | audits.QUERIES
