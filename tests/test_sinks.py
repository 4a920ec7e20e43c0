"""Outputs that replace earlier ones, part numbers of a hot group, and files with broken lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridwork.operators import ordered
from gridwork.sinks import outputs
from gridwork.sources.issues import read_checked_issues, read_issues


def _written(spark, path, text):
    spark.createDataFrame([(text,)], "value string").write.text(f"{path}/data")
    outputs.mark_output(spark, path)


def _held(spark, path):
    return [r.value for r in spark.read.text(f"{path}/data").collect()]


def test_a_failed_move_leaves_the_earlier_output(spark, tmp_path, monkeypatch):
    target, staged = str(tmp_path / "out"), str(tmp_path / "new")
    _written(spark, target, "old")
    _written(spark, staged, "new")
    rename = outputs._rename
    monkeypatch.setattr(outputs, "_rename", lambda s, old, new: False if old == staged else rename(s, old, new))
    with pytest.raises(OSError, match="could not be moved"):
        outputs.publish(spark, staged, target)
    assert _held(spark, target) == ["old"] and _held(spark, staged) == ["new"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["new", "out"]
    monkeypatch.undo()
    outputs.publish(spark, staged, target)
    assert _held(spark, target) == ["new"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_an_interrupted_move_is_ended_later(spark, tmp_path, monkeypatch):
    target, staged = str(tmp_path / "out"), str(tmp_path / "new")
    _written(spark, target, "old")
    _written(spark, staged, "new")
    rename, recover = outputs._rename, outputs.recover_output

    def killed(s, old, new):
        if old == staged:
            raise KeyboardInterrupt
        return rename(s, old, new)

    # The process goes between the two moves, and nothing is tidied.
    monkeypatch.setattr(outputs, "_rename", killed)
    monkeypatch.setattr(outputs, "recover_output", lambda s, t: None)
    with pytest.raises(KeyboardInterrupt):
        outputs.publish(spark, staged, target)
    assert not outputs.path_exists(spark, target)
    monkeypatch.undo()
    recover(spark, target)
    assert _held(spark, target) == ["old"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["new", "out"]
    # With the new output in place, the earlier one goes.
    rename(spark, target, f"{target}.previous")
    rename(spark, staged, target)
    spark.range(1).select(F.lit("x").alias("value")).write.text(f"{target}.journal")
    recover(spark, target)
    assert _held(spark, target) == ["new"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_a_group_of_a_million_chunks_lies_in_many_ranges(spark):
    rows = spark.range(1_000_000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 1_000_000).alias("chunk"), F.lit(2).alias("n"))
    dealt = ordered.ranged(rows, ["g", "chunk"])
    largest = dealt.groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest < 600_000
    out = ordered.total_before(rows, ["g"], ["chunk"], "n", "before")
    assert out.where(F.col("before") != 2 * F.col("chunk")).isEmpty() and out.count() == 1_000_000


def test_files_with_broken_lines_are_set_aside_whole(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "A-1", "fields": {}}\n\n{"key": "A-2", "fields": {}}\n')
    (tmp_path / "b.jsonl").write_text('{"key": "B-1", "fields": {}}\n{broken\n')
    issues, failures = read_checked_issues(spark, str(tmp_path))
    assert {r.key for r in issues.collect()} == {"A-1", "A-2"}
    assert [(r.file.rsplit("/", 1)[-1], r.detail) for r in failures.collect()] == [("b.jsonl", "not JSON: {broken")]
    assert {r.key for r in read_issues(spark, str(tmp_path)).collect()} == {"A-1", "A-2", "B-1"}
