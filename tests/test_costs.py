"""Plans that work a costly value out once, however often it is used."""

from pyspark.sql import functions as F

from gridwork.functions.patterns import add_patterns
from gridwork.operators import flatten
from gridwork.operators.patterns import pattern_groups
from gridwork.plans import samples
from gridwork.sources.issues import line_failures


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_made_once(spark):
    lines = spark.range(3).select(F.repeat(F.concat(F.lit("{"), F.col("id").cast("string")), 2).alias("value"))
    failures = line_failures(lines)
    assert plan(failures).count("repeat(") == 1
    assert [r["detail"] for r in failures.orderBy("detail").collect()] == ["not JSON: {0{0", "not JSON: {1{1", "not JSON: {2{2"]


def test_parts_of_a_date_are_read_without_its_rule(spark):
    names = spark.createDataFrame([("a20240102.x",), ("b_2024-01-02T0304.x",), ("c2024.01.02 03-04-05.x",), ("20240102030405",)], "path string")
    patterns = add_patterns(names, "path", case_sensitive=True)
    # The rule is run to mark dates and to list them, for both patterns together.
    assert plan(patterns).count("(?:19|20)") <= 4
    got = {r["path"]: r["literal"] for r in patterns.collect()}
    assert got == {
        "a20240102.x": "a<DATE:YYYYMMDD>.x", "b_2024-01-02T0304.x": "b_<DATETIME:YYYY-MM-DD_HHMM>.x",
        "c2024.01.02 03-04-05.x": "c<DATETIME:YYYY.MM.DD_HH-MM-SS>.x", "20240102030405": "<DATETIME:YYYYMMDD_HHMMSS><NO_EXT>",
    }


def test_rules_run_once_for_counts_and_examples(spark):
    names = spark.createDataFrame([("a 1.x",), ("a 2.x",), ("b3.x",)], "path string")
    groups = pattern_groups(names, min_count=2)
    assert "regexp_replace" not in plan(groups)
    got = sorted((r["mode"], r["count"], r["pattern"], r["extensions"], r["examples"]) for r in groups.collect())
    assert got == [("literal", 2, "a <NUM:1>.x", ".x:2", "a 1.x | a 2.x"), ("structural", 2, "<WORD> <NUM:1>.x", ".x:2", "a 1.x | a 2.x")]


def test_records_of_text_are_read_once_and_like_variants(spark):
    records = [
        '{"a": 3.0, "b": [1.50, -0, {"name": 7}], "c": {"z": {"k": 2}, "a": 1e3}}', '{"a": 1e400, "b": "\\ud83d", "c": [[true], null, "x"]}',
        '{"a": 1, "a": 2, "b": 1}', '[{"a": 1}]', '{"a": 1} tail', '{"a": NaN}', None, '{"a": null, "b": {"type": "doc", "content": ["t "]}}',
        '{"a": 9223372036854775808, "b": 9223372036854775807, "c": 123456789012345678901234567890.5000000000000}', '{"a": 01}', "{",
        '{"a": false, "b": {"comments": [{"author": {"name": "n"}, "body": 1.0e-7}, 5]}, "c": {"comments": 0.00}}',
    ]
    issues = spark.createDataFrame([(str(i), r) for i, r in enumerate(records)], "key string, fields string")
    fields = [flatten.Field("k", "key"), *[flatten.Field(c, "field", c) for c in "abc"]]
    of_text, of_variants = (
        flatten.flatten_issues(df, fields, "https://x", typed=True) for df in (issues, issues.withColumn("fields", F.try_parse_json("fields")))
    )
    assert "variant" not in plan(of_text)
    assert sorted(of_text.collect()) == sorted(of_variants.collect())


def test_customers_are_dealt_once(spark):
    assert "Repartition" not in plan(samples.customer_grid(spark, "/root/testdata/sf0.001"))


def test_orders_are_dealt_once(spark):
    for grid in (samples.orders_grid, samples.fill_grid):
        assert "Repartition" not in plan(grid(spark, "/root/testdata/sf0.001"))
