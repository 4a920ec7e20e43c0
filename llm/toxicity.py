"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

``P(grade <= k) = sigmoid(threshold_k - w . x)``: the thresholds are ordered and share one weight vector.
Features are whole words and word beginnings, so that unseen endings of a known stem still count. Words
have no weight unless documents labelled toxic hold them far more often than others; an L1 penalty then
keeps the few that explain the grades.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from llm.common import bounded_batches, table, text_or_empty, written

#: The classifier is fitted on so many labelled documents at most, those with the smallest id hashes.
SAMPLE_DOCS = 20_000
SHORTEST_STEM, LONGEST_STEM = 4, 7
LEAST_DOCS = 3
LEAST_PURITY = 0.5
MOST_FEATURES = 20_000
PENALTY = 1.0
REJECT_FROM = 0.5
#: Marked occurrences from which a document labelled toxic has the grade 2, 3, ...
GRADE_FROM = (2, 4)

_NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """``features``: ' word ' or ' stem', with their weights; ``thresholds`` rise."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def __hash__(self) -> int:
        return hash((self.features, self.thresholds))


def spaced_words(text: str) -> str:
    """The lower-cased runs of letters, each between blanks."""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "


def features_of(text: str) -> Counter:
    """How often each word and each word beginning occurs."""
    counts: Counter = Counter()
    for word, n in Counter(spaced_words(text).split()).items():
        counts[f" {word} "] += n
        for size in range(SHORTEST_STEM, min(LONGEST_STEM, len(word)) + 1):
            counts[f" {word[:size]}"] += n
    return counts


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, grade: str, sample: int) -> DataFrame:
    """Distinct texts of the sampled labelled documents with their label, the largest if labels differ."""
    graded = labels.filter(F.col(grade).isNotNull() & F.col(id_column).isNotNull())
    graded = graded.groupBy(F.col(id_column).alias("id")).agg(F.max(grade).cast("int").alias("grade"))
    picked = graded.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text"))
    # The sample has at most ``sample`` short rows.
    found = texts.join(F.broadcast(picked), "id")
    return written(found.groupBy("text").agg(F.max("grade").alias("grade")), "toxic-sample")


def _document_counts(texts: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
    """(feature, n): in how many texts each feature occurs, or each of ``among``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = features_of(text).keys()
                seen.update(found if among is None else found & among)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    return texts.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _candidates(sample: DataFrame) -> list[str]:
    """Features that occur in enough sampled documents, most of them labelled toxic. Only features of
    toxic documents are counted in all; the sample bounds how many there are."""
    often = _document_counts(sample.filter("grade > 0")).filter(F.col("n") >= LEAST_DOCS)
    bad = {row.feature: row.n for row in often.collect()}
    every = _document_counts(sample, frozenset(bad)).collect() if bad else []
    scored = [(bad[row.feature] ** 2 / row.n, row.feature) for row in every if bad[row.feature] >= LEAST_PURITY * row.n]
    return [feature for _, feature in sorted(scored, key=lambda x: (-x[0], x[1]))[:MOST_FEATURES]]


def fit(rows: list[list[tuple[int, float]]], grades: np.ndarray, n_features: int, penalty: float = PENALTY, steps: int = 600):
    """Weights and thresholds of the cumulative-link model by accelerated proximal gradient steps on the
    penalized likelihood. Each class of the grades must occur."""
    n, top = len(rows), int(grades.max())
    row = np.repeat(np.arange(n), [len(x) for x in rows])
    column = np.array([j for x in rows for j, _ in x], dtype=np.int64)
    value = np.array([v for x in rows for _, v in x], dtype=np.float64)
    above = np.array([(grades > k).mean() for k in range(top)])
    first = -np.log(above / (1 - above))
    first = np.maximum.accumulate(first + 1e-3 * np.arange(top))

    def thresholds(free: np.ndarray) -> np.ndarray:
        return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

    def gradient(w: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        cuts = thresholds(free)
        score = np.bincount(row, value * w[column], n) if len(row) else np.zeros(n)
        # cumulative probabilities of grade <= k, with 0 and 1 at the ends
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -500, 500)))
        full = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        at = np.arange(n)
        chance = np.maximum(full[at, grades + 1] - full[at, grades], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))])
        up, low = slope[at, grades + 1] / chance, slope[at, grades] / chance
        by_score = up - low
        by_cut = np.bincount(grades, -up, top + 1)[:top] + np.bincount(grades, low, top + 1)[1 : top + 1]
        by_w = np.bincount(column, value * by_score[row], n_features) if len(row) else np.zeros(n_features)
        by_free = np.array([by_cut.sum(), *(by_cut[i:].sum() * math.exp(free[i]) for i in range(1, top))])
        return float(-np.log(chance).sum()), by_w, by_free

    w, free = np.zeros(n_features), np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    w_ahead, free_ahead, momentum, step = w, free, 1.0, 1e-2
    for _ in range(steps):
        loss, by_w, by_free = gradient(w_ahead, free_ahead)
        while True:
            w_next = w_ahead - step * by_w
            w_next = np.sign(w_next) * np.maximum(np.abs(w_next) - step * penalty, 0)
            free_next = free_ahead - step * by_free
            moved, turned = w_next - w_ahead, free_next - free_ahead
            most = loss + by_w @ moved + by_free @ turned + (moved @ moved + turned @ turned) / (2 * step)
            if gradient(w_next, free_next)[0] <= most + 1e-9 * abs(most) or step < 1e-9:
                break
            step /= 2
        follow = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        w_ahead = w_next + (momentum - 1) / follow * (w_next - w)
        free_ahead = free_next + (momentum - 1) / follow * (free_next - free)
        w, free, momentum = w_next, free_next, follow
    return w, thresholds(free)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    grade: str = "toxic",
    sample: int = SAMPLE_DOCS,
    grade_from: tuple[int, ...] = GRADE_FROM,
) -> ToxicityModel | None:
    """Fits the model on at most ``sample`` labelled documents; None if they don't hold both clean and
    toxic ones. Labels that only tell toxic (1) from clean (0) are split into grades by how many marked
    features a document holds (``grade_from``); labels with more values are grades already. Labels
    without id or value are left out, repeated texts count once."""
    bounded_batches()
    learnt = _sample(docs, labels, id_column, text, grade, sample)
    names = _candidates(learnt)
    if not names:
        return None
    number = {x: i for i, x in enumerate(names)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(x) for x in batch.column(0).to_pylist()]
            rows = [sorted((number[k], n) for k, n in x.items() if k in number) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[i for i, _ in x] for x in rows], pa.list_(pa.int32())), pa.array([[n for _, n in x] for x in rows], pa.list_(pa.int32())), batch.column(1)],
                names=["at", "n", "grade"],
            )

    matrix = learnt.mapInArrow(sparse, "at array<int>, n array<int>, grade int").toPandas()
    # No more rows than the sample has; in an order of their own, so that reruns add up alike.
    order = sorted(range(len(matrix)), key=lambda i: (matrix["grade"][i], list(matrix["at"][i]), list(matrix["n"][i])))
    matrix = matrix.iloc[order].reset_index(drop=True)
    grades = matrix["grade"].to_numpy().astype(np.int64)
    if grades.max(initial=0) == 0 or grades.min(initial=1) > 0:
        return None
    counts = [dict(zip(a, n, strict=True)) for a, n in zip(matrix["at"], matrix["n"], strict=True)]
    if grades.max() == 1:
        words = {i for i, x in enumerate(names) if x.endswith(" ")}
        marked = np.array([sum(n for i, n in x.items() if i in words) for x in counts])
        grades = np.where(grades > 0, 1 + np.searchsorted(grade_from, marked, "right"), 0)
    grades = np.unique(grades, return_inverse=True)[1]
    rows = [[(int(i), 1 + math.log(n)) for i, n in x.items()] for x in counts]
    weights, thresholds = fit(rows, grades, len(names))
    kept = [(x, float(w)) for x, w in zip(names, weights, strict=True) if w]
    return ToxicityModel(tuple(x for x, _ in kept), tuple(w for _, w in kept), tuple(map(float, thresholds)))


@lru_cache(maxsize=4)
def _automaton(model: ToxicityModel) -> ahocorasick.Automaton | None:
    if not model.features:
        return None
    found = ahocorasick.Automaton()
    for i, feature in enumerate(model.features):
        found.add_word(feature, i)
    found.make_automaton()
    return found


def raw_score(model: ToxicityModel, text: str) -> float:
    automaton = _automaton(model)
    if automaton is None:
        return 0.0
    hits = Counter(i for _, i in automaton.iter(spaced_words(text)))
    return sum(model.weights[i] * (1 + math.log(n)) for i, n in sorted(hits.items()))


def grade_texts(model: ToxicityModel | None, text: Column) -> Column:
    """A struct of severity (expected grade, from 0), p_toxic (chance of a grade above 0) and grade (the
    likeliest). A null text is empty. Without a model all are 0."""
    if model is None:
        return F.struct(F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade"))

    bounded_batches()

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def grade(texts: pd.Series) -> pd.DataFrame:
        scores = np.array([raw_score(model, x) for x in texts], dtype=np.float64)
        cuts = np.array(model.thresholds)
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - scores[:, None], -500, 500)))
        chances = -np.diff(np.hstack([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))]), axis=1)
        return pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": chances.argmax(axis=1).astype(np.int32)})

    return grade(text_or_empty(text))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, with a model fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    graded = docs.select("doc_id", grade_texts(model, F.col("text")).alias("g"))
    return graded.select("doc_id", "g.severity", "g.p_toxic", "g.grade", (F.col("g.p_toxic") >= REJECT_FROM).alias("rejected"))


def clean_documents(docs: DataFrame, model: ToxicityModel | None, text: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows that the model doesn't take for toxic, with their columns."""
    return docs.filter(grade_texts(model, F.col(text))["p_toxic"] < reject_from)
