"""The word model against its definition, and the documents that it keeps and rejects."""

from __future__ import annotations

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwork.session import checkpoint_dir
from llm import word_quality as words
from tools import documents, messy, nothing

VERSES = "the river runs along a quiet field and many birds sing over it while old men walk home slowly".split()


def _chances_by_hand(texts, order):
    """Interpolated modified Kneser-Ney from its definition, over tuples of words."""
    grams = Counter()
    for text in texts:
        row = ["<edge>"] * (order - 1) + words.tokens(text)
        grams.update(tuple(row[i - order + 1 : i + 1]) for i in range(order - 1, len(row)))
    levels = [grams]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    offs = []
    for level in levels:
        many = Counter(level.values())
        y = many[1] / (many[1] + 2 * many[2]) if many[1] else 0.5
        offs.append([y, *(min(max(k - (k + 1) * y * many[k + 1] / many[k], 0.05), k - 0.05) if many[k] else y for k in (1, 2, 3))])

    def chance(gram):
        if not gram:
            return 1 / (len(levels[0]) + 1)
        level, off = levels[len(gram) - 1], offs[len(gram) - 1]
        same = {g: n for g, n in level.items() if g[:-1] == gram[:-1]}
        if not same:
            return chance(gram[1:])
        own, total = same.get(gram, 0), sum(same.values())
        left = sum(off[min(n, 3)] for n in same.values()) / total
        return (own - off[min(own, 3)] if own else 0) / total + left * chance(gram[1:])

    return chance


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_the_definition(spark, monkeypatch, order):
    """Small chunks, so that grams are asked for by several; each text by the model of the other half."""
    monkeypatch.setattr(words, "CHUNK_WORDS", 7)
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(VERSES[:8], int(rng.integers(1, 12)))) + "." for _ in range(60)]
    trusted = spark.createDataFrame([(t,) for t in texts], "text string")
    half = {r.text: r.half for r in words._named(trusted).collect()}
    chances = [_chances_by_hand([t for t in texts if half[t] == h], order) for h in (0, 1)]
    model, unknown = words.kneser_ney(words.count_grams(trusted, order), order)
    asked = [*texts[:20], "the zebra runs", "zebra", "", "日本 é9", "the the the the the", None]
    docs = spark.createDataFrame([(t,) for t in asked], "text string").repartition(3)
    names = {(r.mark, r.twin): (r.half, r.text) for r in words._named(docs).collect()}
    out = words.scored_texts(docs, model, unknown, order).collect()
    assert len(out) == len(names) == len({(r.mark, r.twin) for r in out})
    for row in out:
        own, text = names[row.mark, row.twin]
        padded = ["<edge>"] * (order - 1) + words.tokens(text)
        chance = chances[1 - own]
        bits = -sum(math.log2(chance(tuple(padded[i - order + 1 : i + 1]))) for i in range(order - 1, len(padded)))
        assert row.n_words == len(words.tokens(text))
        assert row.bits == pytest.approx(bits, rel=1e-4)


def test_tokens_of_scripts():
    assert words.tokens("It's 42% NICE_day") == ["it", "'", "s", "42", "%", "nice", "_", "day"]
    assert words.tokens("東京へ abc") == ["東", "京", "へ", "abc"]
    assert words.tokens(" \n\t") == []


def _sentences(rng, n):
    """Prose in which the words before a word nearly settle it."""
    lines = ["the river runs along a quiet field", "many birds sing over it", "old men walk home slowly", "a dog sleeps under the tree"]
    return [" ".join(rng.choice(lines, 12)) + "." for _ in range(n)]


def test_shuffled_words_and_noise_are_rejected(spark):
    """The words of clean texts in another order have the same letters and frequencies."""
    rng = np.random.default_rng(4)
    clean = _sentences(rng, 300)
    salad = [" ".join(rng.permutation(t.rstrip(".").split())) + "." for t in clean[:40]]
    noise = [" ".join("".join(rng.choice(list("bcdfgxzq"), 7)) for _ in range(50)) for _ in range(20)]
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(clean)]
    rows += [(1000 + i, t, "en") for i, t in enumerate(salad)] + [(2000 + i, t, "fr") for i, t in enumerate(noise)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.q for r in words.with_quality(documents(spark, rows), labels).collect()}
    assert sum(out[i].kept for i in range(300)) >= 294
    assert not any(out[i].kept for i in out if i >= 1000)


def test_languages_with_few_trusted_texts_keep_their_clean_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, t, "en") for i, t in enumerate(_sentences(rng, 250))]
    rows += [(300 + i, t, ["few", None][i % 2]) for i, t in enumerate(_sentences(rng, 100))]
    rows += [(500 + i, rows[260][1], "few") for i in range(30)]
    good = [*range(150), 300, 301, *range(500, 530)]
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.q for r in words.with_quality(documents(spark, rows), labels).collect()}
    assert sum(out[i].kept for i in range(300, 400)) >= 97
    assert len({out[i].bits_per_word for i in range(500, 530)}) == 1


def test_awkward_rows_and_missing_labels(spark):
    rng = np.random.default_rng(6)
    docs = messy(spark).withColumn("mark", F.lit("x")).withColumn("n_words", F.lit("x"))
    more = documents(spark, [(100 + i, t) for i, t in enumerate(_sentences(rng, 60))]).withColumn("mark", F.lit("x")).withColumn("n_words", F.lit("x"))
    both = docs.unionByName(more)
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0), labels.limit(3)):
        judged = words.with_quality(both, own)
        assert judged.columns == [*[c for c in both.columns if c != "q"], "q"]
        found = judged.collect()
        assert len(found) == both.count()
        assert all(r.q.kept and r.q.n_words == 0 for r in found if not (r.text or "").strip())
        assert all(r.q.kept for r in found) or own is labels
        same = {(r.text, r.q.n_words, r.q.bits_per_word, r.q.kept) for r in found if r.doc_id == 1}
        assert len(same) == 2
    assert words.with_quality(nothing(spark), labels).count() == 0


def test_trusted_texts_without_words(spark):
    docs = documents(spark, [(i, " " * (i + 1)) for i in range(40)] + [(99, "a word")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    found = words.with_quality(docs, labels).collect()
    assert len(found) == 41 and all(r.q.kept and r.q.top is None for r in found)


def test_pipeline_keeps_what_the_word_model_keeps(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "ko", "vi", "pel", "dar")]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(150)]
    # Made of the same letters, but of words that no trusted text has.
    rows += [(1000, " ".join(a[::-1] + b for a, b in (rng.choices(vocabulary, k=2) for _ in range(60))))]
    docs = documents(spark, rows).withColumn("q", F.col("doc_id"))
    spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.good(spark, docs, str(tmp_path))
    judged = words.with_quality(docs.drop("q"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.join(judged.filter("q.kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns).collect()))
    assert kept.filter("doc_id = 1000").isEmpty() and kept.count() > 140


@pytest.mark.parametrize("order", [2, 3])
def test_frequent_words_in_several_shards_and_nothing_left_behind(spark, monkeypatch, order):
    """Words before the last that are dealt to several shards, words without a short code; only scores stay."""
    monkeypatch.setattr(words, "LEAST_SHARDS", 200)
    monkeypatch.setattr(words, "FREQUENT", 6)
    rng = np.random.default_rng(10 + order)
    texts = [" ".join(rng.choice(VERSES[:12], int(rng.integers(1, 15)))) for _ in range(80)]
    trusted = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    half = {r.text: r.half for r in words._named(trusted).collect()}
    chances = [_chances_by_hand([t for t in texts if half[t] == h], order) for h in (0, 1)]
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("llm-*")}
    model, sizes = words.kneser_ney(words.count_grams(trusted, order), order)
    assert model.parts.max() > 4
    asked = spark.createDataFrame([(t,) for t in [*texts[:25], "river zebra river", "the zebra the"]], "text string").repartition(2)
    names = {(r.mark, r.twin): (r.half, r.text) for r in words._named(asked).collect()}
    out = words.scored_texts(asked, model, sizes, order).collect()
    assert len(out) == len(names)
    for row in out:
        own, text = names[row.mark, row.twin]
        line = ["<edge>"] * (order - 1) + words.tokens(text)
        bits = -sum(math.log2(chances[1 - own](tuple(line[i - order + 1 : i + 1]))) for i in range(order - 1, len(line)))
        assert row.bits == pytest.approx(bits, rel=1e-9)
    left = {p.name.split("-")[1] + "-" + p.name.split("-")[2] for p in folder.glob("llm-*") if p.name not in before}
    assert left <= {"word-bits", "chunk-bits"}
