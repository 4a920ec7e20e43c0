"""Nested issue records to one flat, typed row per issue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridwork.functions.cells import BLANKS, make_cell
from gridwork.functions.issues import add_value_texts, value_cell, value_text
from gridwork.functions.trees import record_texts
from gridwork.session import computed_once

# Names that mean the record key and its address.
SPECIAL_FIELDS = {
    "key": "key",
    "issue key": "key",
    "jira key": "key",
    "url": "url",
    "issue url": "url",
    "jira url": "url",
}


@dataclass(frozen=True)
class Field:
    """A requested column: its title, and where its value comes from."""

    header: str
    kind: str
    field_id: str | None = None
    type: str | None = None


def _folded(name: Column) -> Column:
    return F.lower(F.trim(name))


def resolve_fields(catalogue: DataFrame, requested: list[str]) -> list[Field]:
    """Requested names to field ids: special names first, then ids, then unique names.

    ``catalogue`` has ``id, name, type``. Only matching catalogue rows come to the driver, as many
    as names were requested.
    """
    if not requested:
        raise ValueError("no fields were requested")
    folded = [name.strip().casefold() for name in requested]
    if len(set(folded)) != len(folded):
        raise ValueError("a field is requested twice")
    listed = catalogue.select(
        "id", "type", _folded(F.col("id")).alias("id_key"), _folded(F.coalesce("name", "id")).alias("name_key")
    )
    wanted = listed.where(F.col("id_key").isin(folded) | F.col("name_key").isin(folded))
    by_id: dict[str, tuple] = {}
    by_name: dict[str, tuple] = {}
    names = wanted.groupBy("name_key").agg(
        F.count(F.lit(1)).alias("fields"), F.min("id").alias("id"), F.min_by("type", "id").alias("type"), F.max("id").alias("last_id")
    )
    for row in wanted.where(F.col("id_key").isin(folded)).collect():
        by_id[row["id_key"]] = (row["id"], row["type"])
    for row in names.where(F.col("name_key").isin(folded)).collect():
        by_name[row["name_key"]] = (row["fields"], row["id"], row["type"], row["last_id"])
    resolved = []
    for header, key in zip(requested, folded):
        if key in SPECIAL_FIELDS:
            resolved.append(Field(header, SPECIAL_FIELDS[key]))
        elif key in by_id:
            resolved.append(Field(header, "field", *by_id[key]))
        elif key not in by_name:
            raise ValueError(f"unknown field: {header!r}")
        elif by_name[key][0] > 1:
            raise ValueError(f"{header!r} names several fields, {by_name[key][1]} to {by_name[key][3]}; request one by its id")
        else:
            resolved.append(Field(header, "field", by_name[key][1], by_name[key][2]))
    return resolved


def issue_url(server: str, key: Column) -> Column:
    return F.concat(F.lit(server.rstrip("/") + "/browse/"), key)


def flatten_issues(
    issues: DataFrame, fields: list[Field], server: str, typed: bool = False, limited: bool = False
) -> DataFrame:
    """One column per requested field, in the requested order, from ``key`` and ``fields`` (JSON
    text or VARIANT). Values are texts, or typed cells with ``typed``, and whole unless ``limited`` to
    what a spreadsheet cell holds.

    Only the requested fields are made into texts, and nothing is shuffled.
    """
    rows = issues
    read = [f for f in fields if f.kind == "field"]
    if read and dict(issues.dtypes)["fields"] == "variant":
        rows = add_value_texts(rows, [F.try_variant_get("fields", _member(f.field_id), "variant") for f in read], "_texts")
    elif read:
        rows = rows.withColumn("_texts", computed_once(record_texts(F.col("fields"), [f.field_id for f in read], BLANKS)))
    columns = []
    for field in fields:
        if field.kind == "field":
            shape = F.get("_texts", F.lit(read.index(field)))
            value = value_cell(shape, field.type, limited) if typed else value_text(shape, field.type, limited)
        else:
            value = F.col("key") if field.kind == "key" else issue_url(server, F.col("key"))
            value = make_cell("text", value) if typed else value
        columns.append(value.alias(field.header))
    return rows.select(*columns)


def long_fields(issues: DataFrame) -> DataFrame:
    """One row ``key, field_id, value`` per field of every issue."""
    parsed = issues.select("key", computed_once(F.try_parse_json("fields")).alias("fields"))
    return issues.sparkSession.sql(
        "SELECT i.key, f.key AS field_id, f.value FROM {issues} i, LATERAL variant_explode(i.fields) f", issues=parsed
    )


def _member(field_id: str) -> str:
    """The path of a member, whatever characters its name has but both kinds of quotes."""
    return f'$["{field_id}"]' if "'" in field_id else f"$['{field_id}']"


def named_fields(issues: DataFrame, catalogue: DataFrame, requested: list[str]) -> DataFrame:
    """Field ids replaced by catalogue names and pivoted to one row per issue. Names the catalogue
    has twice are refused; fields it does not have are left out."""
    doubled = catalogue.groupBy(_folded(F.col("name")).alias("name_key")).count().where("count > 1")
    keys = [name.strip().casefold() for name in requested]
    clash = doubled.where(F.col("name_key").isin(keys)).first()
    if clash is not None:
        raise ValueError(f"the catalogue has several fields named {clash['name_key']!r}")
    names = catalogue.select("id", _folded(F.col("name")).alias("name_key")).where(F.col("name_key").isin(keys))
    ids = {row["name_key"]: row["id"] for row in names.collect()}
    read = [k for k in keys if k in ids]
    # The wanted fields are read where the issue is; dealt by field, all values of one would meet in a task.
    texts = record_texts(F.col("fields"), [ids[k] for k in read], BLANKS) if read else F.lit(None)
    rows = issues.select("key", computed_once(texts).alias("_texts"))
    items = [F.get("_texts", F.lit(i)) for i in range(len(read))]
    rows = rows.where(F.exists("_texts", lambda t: t["kind"].isNotNull())) if read else rows.where(F.lit(False))
    first = [F.first(F.when(t["kind"].isNotNull(), F.struct(t["text"].alias("text"))), ignorenulls=True)["text"].alias(k) for t, k in zip(items, read)]
    wide = rows.groupBy("key").agg(*first) if read else rows.select("key")
    shown = [(F.col(f"`{k}`") if k in ids else F.lit(None).cast("string")).alias(name) for k, name in zip(keys, requested)]
    return wide.select("key", *shown)
