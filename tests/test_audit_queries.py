"""Registered queries on small tables whose keys and fields are awkward."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwork.operators import flatten
from gridwork.plans import audits, samples


def test_header_line_comes_first_whatever_the_keys(spark, tmp_path):
    keys = [-3, -2, 0, 1, 2, 5]
    rows = [(k, n, "BUILDING") for n in (0, 1, 2, 3) for k in keys]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.grp: (r.records, r.files, r.keys) for r in audits.sheet_name_files(spark, str(tmp_path)).collect()}
    assert got == {"parts": (12, 2, 6), "rest": (6, 1, 3), "skip": (0, 1, 0)}


def test_named_fields_meet_no_task_by_field(spark):
    issues = [("A", '{"f1": "x", "f2": null, "o": 1}'), ("B", '{"f2": [1, {"name": "n"}]}'), ("C", '{"o": 2}'), ("D", '{"f1": 1.50}')]
    issues = spark.createDataFrame(issues, "key string, fields string")
    names = spark.createDataFrame([("f1", "One", ""), ("f2", " Two ", ""), ("o", "Other", "")], "id string, name string, type string")
    wide = flatten.named_fields(issues, names, ["two", "One", "Gone"])
    assert sorted(map(tuple, wide.collect())) == [("A", None, "x", None), ("B", "1\nn", None, None), ("D", None, "1.5", None)]
    # A join on the field would bring all values of one to one task.
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_documents_of_a_language_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    docs = spark.range(0, 400, 1, 4).select(F.when(F.col("id") % 50 == 0, "de").otherwise("en").alias("lang"), F.col("id").cast("string").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    place = f"{tmp_path}/out"
    monkeypatch.setattr(audits, "_fresh", lambda spark, name: place)
    got = sorted(tuple(r) for r in audits.hidden_listing(spark, str(tmp_path)).collect())
    assert got == [("de", False, 1), ("de", True, 1), ("en", False, 1), ("en", True, 1)]
    assert spark.read.parquet(f"{place}/open").count() == 400
    assert len(list((tmp_path / "out" / "open" / "lang=en").glob("*.parquet"))) > 1


def test_sample_inputs_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    orders = spark.range(0, 4000, 1, 1).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"),
        F.lit("1995-01-02").cast("timestamp").alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    for made in (samples.order_files, samples.fill_grid, samples.orders_grid):
        held = made(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().where("count > 100").count()
        assert held >= spark.sparkContext.defaultParallelism
