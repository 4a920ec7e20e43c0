"""Hard negatives, codes and their intervals against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import hard_negatives as hn


def _expected(rows, anchor):
    usual = {}
    for _, v, label in rows:
        if v:
            usual[len(v)] = usual.get(len(v), 0) + 1
    size = min(usual, key=lambda n: (-usual[n], n)) if usual else 0
    good = {(i, label, tuple(v)) for i, v, label in rows if None not in (i, label, v) and len(v) == size and all(x is not None and math.isfinite(x) for x in v)}
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in good]
    good = [x for x in good if sum(c * c for c in x[2]) < hn.MOST_SQUARE]
    out = set()
    for a, label, v in good:
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in good]
        near = sorted({(s, i) for s, i, other in scored if other == label and i != a})[: hn.POSITIVES]
        far = sorted({(s, i) for s, i, other in scored if other != label})
        for p, i in near:
            fit = [(s, j) for s, j in far if 80 * -p <= 100 * -s <= 100 * -p][: hn.NEGATIVES]
            out |= {(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(fit, 1)}
    return out


def _table(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumns({c: F.lit("x") for c in ("id", "whole", "codes", "anchor", "place", "side")})


def _clusters(rng, n, size, spread=0.3):
    centers = rng.normal(size=(6, size))
    return [(int(i), [float(np.float32(x)) for x in centers[i % 6] + rng.normal(size=size) * spread], int(rng.integers(3))) for i in range(n)]


def _found(df, anchor, **more):
    return [tuple(r) for r in hn.hard_negatives(df, anchor, **more).collect()]


@pytest.mark.parametrize(("n", "size", "blocks"), [(200, 8, {}), (300, 70, {"anchor_block": 7, "row_block": 40}), (60, 1, {"row_block": 11})])
def test_hard_negatives_are_those_of_all_products(spark, n, size, blocks):
    rows = _clusters(np.random.default_rng(n), n, size)
    out = _found(_table(spark, rows), F.col("id") % 10 == 0, **blocks)
    expected = _expected(rows, lambda i: i % 10 == 0)
    assert len(out) == len(set(out)) and set(out) == expected and len(expected) > 10


def test_many_lots_of_rows(spark, monkeypatch):
    rows = _clusters(np.random.default_rng(1), 250, 16, 0.8)
    expected = _expected(rows, lambda i: i % 5 == 0)
    whole = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows], dtype=np.int32)
    codes, align, left = hn.encode(whole, hn.rotation(16))
    every = hn.Coded(np.arange(250), np.array([r[2] for r in rows]), whole, codes, align, left, np.linalg.norm(whole.astype(float), axis=1))
    anchors = every.take(np.arange(0, 250, 5))
    lots = [every.take(slice(i, i + 17)) for i in range(0, 250, 17)]
    spread, best = hn.planes(anchors.whole, hn.rotation(16)), hn.Best(50, 5)
    for lot in lots:
        hn.find_positives(anchors, spread, lot, best)
    limits = best.score.reshape(50, 5)
    names = best.row.reshape(50, 5)
    worst = hn.Best(250, 5)
    for lot in lots:
        hn.find_negatives(anchors, spread, limits, np.ones((50, 5), dtype=bool), lot, worst)
    rank = np.arange(len(worst.key)) - np.searchsorted(worst.key, worst.key) + 1
    got = {(int(anchors.id[k // 5]), int(names.ravel()[k]), int(p), int(i), int(limits.ravel()[k]), int(s)) for k, p, i, s in zip(worst.key, rank, worst.row, worst.score, strict=True)}
    assert got == expected


def test_intervals_hold_the_products_and_drop_pairs():
    rng = np.random.default_rng(3)
    whole = rng.integers(-400, 400, size=(300, 64)).astype(np.int32)
    whole[0] = 0
    codes, align, left = hn.encode(whole, hn.rotation(64))
    rows = hn.Coded(np.arange(300), np.zeros(300), whole, codes, align, left, np.linalg.norm(whole.astype(float), axis=1))
    some = rows.take(slice(0, 20))
    true = some.whole.astype(np.int64) @ whole.astype(np.int64).T
    low = np.quantile(true, 0.9, axis=1)
    a, r = hn.within(some, hn.planes(some.whole, hn.rotation(64)), rows, np.ones((20, 300), dtype=bool), low, np.full(20, np.inf))
    kept = np.zeros((20, 300), dtype=bool)
    kept[a, r] = True
    assert kept[true >= low[:, None]].all()
    # Of the others, a tenth at the most has an interval that reaches so far.
    assert kept[true < low[:, None]].mean() < 0.1
    # Every further code leaves less.
    assert (np.diff(left[1:], axis=1) < 0).all() and (left[:, -1] <= 0.05 * rows.norm).all()


def test_ties_copies_and_rows_that_take_no_part(spark):
    rows = [(i, [1.0, 1.0], 0) for i in range(0, 12)] + [(i, [1.0, 0.9], 1) for i in range(20, 32)] + [(40, [1.0, 0.9], 1)] * 3
    rows += [(50, None, 1), (51, [1.0, None], 1), (52, [1.0, float("nan")], 1), (53, [float("inf"), 1.0], 1), (None, [1.0, 0.9], 1), (54, [1.0, 0.9], None)]
    rows += [(55, [1.0], 1), (56, [], 1), (57, [3e38, 1.0], 1), (58, [0.0, 0.0], 1), (0, [0.5, 0.5], 2), (0, [-1.0, 0.1], 0), (60, [-1.0, 0.1], 0), (61, [-1.0, 0.1], 3)]
    out = _found(_table(spark, rows), F.col("id").isin(0, 60, 61))
    assert set(out) == _expected(rows, lambda i: i in (0, 60, 61)) and len(out) == len(set(out)) > 20


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(2, 5, size=4) * 1e6 + rng.integers(0, 9, size=4)], i % 2) for i in range(40)]
    assert set(_found(_table(spark, rows, "double"), F.col("id") < 5)) == _expected(rows, lambda i: i < 5)


def test_empty_tables(spark):
    df = _table(spark, [])
    assert _found(df, F.col("id") == 0) == []
    assert _found(_table(spark, [(0, [1.0], 0)]), F.col("id") == 0) == []
