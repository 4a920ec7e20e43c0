"""Listings by tasks against a walk through the folders."""

from __future__ import annotations

import os

import pytest

from gridwork.sources import tree
from gridwork.sources.listing import list_files, visible_files


def _files(root):
    return {os.path.relpath(os.path.join(d, f), root): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs}


@pytest.mark.parametrize("wanted", [1, 256])
def test_all_files_are_listed_hidden_ones_too(spark, tmp_path, monkeypatch, wanted):
    for i, path in enumerate(["top.csv", ".dot", "a/x.csv", "a/.git/config", "a/b/c/d/e.csv", "_under/y.csv", "Ölçü m/z +%.csv", ".hid/deep/w.csv"]):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * i)
    (tmp_path / "empty/folder").mkdir(parents=True)
    monkeypatch.setattr(tree, "WANTED_FOLDERS", wanted)
    found = tree.list_tree(spark, str(tmp_path))
    assert {r.path: r.length for r in found.collect()} == _files(tmp_path)
    shown = {r.path for r in tree.list_tree(spark, f"file:{tmp_path}", include_hidden=False).collect()}
    # Spark's file index leaves out empty files as well.
    assert shown - {"top.csv"} == {r.path for r in list_files(spark, str(tmp_path)).collect()} and "top.csv" in shown
    assert {r.path for r in visible_files(found).collect()} == {p for p in _files(tmp_path) if not any(x.startswith(".") for x in p.split("/"))}
    assert tree.list_tree(spark, str(tmp_path / "empty")).isEmpty()


def test_a_missing_folder_fails(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not.*exist|cannot|no such"):
        tree.list_tree(spark, str(tmp_path / "none")).collect()
