"""The ordinal fit and the retrieval of packing against their definitions; the pipeline on awkward tables."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from llm import chat, packing, toxicity
from tools import documents, messy, nothing


def _objective(weights, cuts, rows, grades, penalty):
    """Penalized likelihood of the cumulative-link model, row by row."""
    total = penalty * sum(abs(w) for w in weights)
    for row, grade in zip(rows, grades, strict=True):
        score = sum(weights[j] * v for j, v in row)
        below = [0.0, *(1 / (1 + math.exp(min(score - c, 500))) for c in cuts), 1.0]
        total -= math.log(max(below[grade + 1] - below[grade], 1e-300))
    return total


def _search(rows, grades, size, penalty):
    """The least objective by steps along one coordinate after the other."""
    top = max(grades)
    point = [0.0] * size + [float(k) - top / 2 for k in range(top)]
    split = lambda p: (p[:size], p[size:])
    value = lambda p: _objective(*split(p), rows, grades, penalty) if all(a < b for a, b in zip(p[size:], p[size + 1 :], strict=False)) else math.inf
    best, step = value(point), 1.0
    while step > 1e-5:
        moved = False
        for i in range(len(point)):
            for way in (step, -step):
                tried = [*point[:i], point[i] + way, *point[i + 1 :]]
                if (now := value(tried)) < best - 1e-12:
                    point, best, moved = tried, now, True
        # Along all thresholds together, as they hang together.
        for way in (step, -step):
            tried = [*point[:size], *(c + way for c in point[size:])]
            if (now := value(tried)) < best - 1e-12:
                point, best, moved = tried, now, True
        step = step if moved else step / 2
    return split(point), best


@pytest.mark.parametrize(("penalty", "grades_of"), [(1.0, 3), (0.2, 2), (8.0, 4)])
def test_ordinal_fit_is_that_of_a_search(penalty, grades_of):
    rng = np.random.default_rng(grades_of)
    true = np.array([1.5, -1.0, 0.0])
    features = rng.integers(0, 3, size=(120, 3)).astype(float)
    latent = features @ true + rng.logistic(size=120)
    grades = np.digitize(latent, np.quantile(latent, np.arange(1, grades_of) / grades_of))
    rows = [[(j, v) for j, v in enumerate(x) if v] for x in features]
    weights, cuts = toxicity.fit(rows, grades, 3, penalty)
    (found, found_cuts), best = _search(rows, grades.tolist(), 3, penalty)
    got = _objective(weights, cuts, rows, grades.tolist(), penalty)
    # Shared weights of either sign, and none at all where the penalty outweighs them.
    assert got <= best + 1e-3
    assert weights == pytest.approx(found, abs=0.02) and cuts == pytest.approx(found_cuts, abs=0.03)


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(8)
    units = [rng.choice(60, size=int(rng.integers(1, 20))).astype(np.uint16) for _ in range(40)]
    units += [units[3].copy(), np.array([59], dtype=np.uint16)]
    seen = Counter(t for u in units for t in set(u.tolist()))
    weights = np.array([math.log(1 + (len(units) - seen[t] + 0.5) / (seen[t] + 0.5)) for t in range(60)], dtype=np.float32)
    length = float(np.mean([len(u) for u in units]))
    index = packing.Index(units, weights, length)
    unused = np.ones(len(units))
    unused[5] = 0
    for seed, unit in enumerate(units):
        scores = {}
        for other, held in enumerate(units):
            counts = Counter(held.tolist())
            norm = packing.K1 * (1 - packing.B + packing.B * len(held) / length)
            score = sum(float(weights[t]) * counts[t] * (packing.K1 + 1) / (counts[t] + norm) for t in set(unit.tolist()) if seen[t] > 1)
            if score > 0 and unused[other]:
                scores[other] = score
        ranked = sorted(scores, key=lambda u: (-round(scores[u], 9), u))[: packing.NEIGHBOURS]
        got = index.neighbours(seed, unused).tolist()
        assert sorted(round(scores[u], 6) for u in got) == sorted(round(scores[u], 6) for u in ranked)
        assert [round(scores[u], 6) for u in got] == sorted((round(scores[u], 6) for u in got), reverse=True)


def _folder(path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_on_awkward_tables(spark, tmp_path):
    columns = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1), (2, 1, None), (99, 1, 1)], columns)
    out = corpus_pipeline.run(spark, _folder(tmp_path / "messy", messy(spark), labels)).collect()
    kept = {r.doc_id for r in out}
    # The mix takes words, so documents without any (null, empty and blank ones) end there.
    assert kept >= {5, 6, 7} and kept.isdisjoint({2, 3, 4})
    for doc in kept - {None}:
        for tokens in {r.doc_tokens for r in out if r.doc_id == doc}:
            assert sum(r.length for r in out if r.doc_id == doc and r.doc_tokens == tokens) % tokens == 0
    empty = spark.createDataFrame([], columns)
    assert corpus_pipeline.run(spark, _folder(tmp_path / "empty", nothing(spark), empty)).isEmpty()
    only = documents(spark, [(1, "one text alone")])
    assert {r.doc_id for r in corpus_pipeline.run(spark, _folder(tmp_path / "one", only, empty)).collect()} == {1}


def test_chats_with_clashing_columns(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|> ho"), (2, 0, "assistant", None)]
    plain = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    extra = plain.withColumns({c: F.lit("x") for c in ("ids", "loss", "segments", "segment", "n_turns", "row", "key", "place", "body")})
    digests = [sorted(map(tuple, chat.read_digests(chat.format_turns(df)).collect())) for df in (plain, extra)]
    assert digests[0] == digests[1] and len(digests[0]) == 2
