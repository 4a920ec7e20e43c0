"""Toxicity, quality and the pipeline."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import quality, toxicity
from tools import DOCS, documents, messy, nothing

CALM = "the river runs along a quiet field and many birds sing over it while old men walk home slowly".split()
INSULTS = ["idiot", "moron", "scum"]


def _toxic_corpus(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(CALM, int(rng.integers(20, 60))))
        bad = i % 5 == 0
        if bad:
            for at in rng.integers(0, len(words), int(rng.integers(1, 6))):
                words[at] = str(rng.choice(INSULTS)) if i % 10 else "zugla" + str(rng.choice(["ra", "nto", "mi", "q"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = _toxic_corpus(spark)
    model = toxicity.train(docs, labels.filter("doc_id < 400"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    out = docs.select("doc_id", toxicity.grade_texts(model, F.col("text")).alias("g")).join(labels, "doc_id").filter("doc_id >= 400").collect()
    assert all((r.g.p_toxic >= 0.5) == bool(r.toxic) for r in out)
    unseen = documents(spark, [(1, "a zuglaxyz walks"), (2, "a calm field"), (3, "idiot idiot moron scum idiot")])
    a, b, c = (r.g for r in unseen.select("doc_id", toxicity.grade_texts(model, F.col("text")).alias("g")).orderBy("doc_id").collect())
    assert a.p_toxic > 0.5 > b.p_toxic
    assert c.severity > a.severity > b.severity and c.grade >= 2


def test_fit_finds_the_likeliest_thresholds():
    """Without features the thresholds must give back the shares of the grades."""
    grades = np.array([0] * 60 + [1] * 25 + [2] * 15)
    weights, cuts = toxicity.fit([[] for _ in grades], grades, 1)
    assert weights.tolist() == [0.0]
    shares = 1 / (1 + np.exp(-cuts))
    assert shares == pytest.approx([0.6, 0.85], abs=1e-3)


def test_toxicity_without_labels_and_on_messy_documents(spark):
    docs, labels = _toxic_corpus(spark, 100)
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.train(nothing(spark), labels) is None
    assert toxicity.train(docs, labels.withColumn("toxic", F.lit(0))) is None
    odd = labels.withColumn("toxic", F.when(F.col("doc_id") % 7 == 1, None).otherwise(F.col("toxic"))).unionByName(labels.withColumn("doc_id", F.lit(None)))
    model = toxicity.train(docs.unionByName(messy(spark)), odd)
    for m in (None, model):
        assert toxicity.clean_documents(messy(spark), m).count() == messy(spark).count()
        assert toxicity.clean_documents(messy(spark), m).columns == messy(spark).columns
        assert toxicity.clean_documents(nothing(spark), m).count() == 0


def _kneser_ney_by_hand(texts):
    """Interpolated modified Kneser-Ney over symbols, from its definition."""
    grams = Counter()
    for text in texts:
        symbols = [0] * (quality.ORDER - 1) + quality._SYMBOL_OF[np.frombuffer(text.encode(), dtype=np.uint8)].tolist()
        grams.update(tuple(symbols[i - quality.ORDER + 1 : i + 1]) for i in range(quality.ORDER - 1, len(symbols)))
    counts = [grams]
    for _ in range(quality.ORDER - 1):
        counts.append(Counter(g[1:] for g in counts[-1]))
    discounts = []
    for level in counts:
        many = Counter(level.values())
        y = many[1] / (many[1] + 2 * many[2]) if many[1] else 0.5
        off = [y]
        for k in (1, 2, 3):
            off.append(min(max(k - (k + 1) * y * many[k + 1] / many[k], 0.05), k - 0.05) if many[k] else y)
        discounts.append(off)

    def chance(gram):
        if not gram:
            return 1 / quality.SYMBOLS
        level = counts[quality.ORDER - len(gram)]
        off = discounts[quality.ORDER - len(gram)]
        same = {g: n for g, n in level.items() if g[:-1] == gram[:-1]}
        if not same:
            return chance(gram[1:])
        total = sum(same.values())
        left = sum(off[min(n, 3)] for n in same.values()) / total
        own = same.get(gram, 0)
        return max(own - off[min(own, 3)], 0) / total * (own > 0) + left * chance(gram[1:])

    return chance


def test_kneser_ney_against_its_definition(spark):
    texts = ["the cat sat", "the hat", "A cat ate it!", "the the the", "sat at the mat"]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    chance = _kneser_ney_by_hand(texts)
    asked = ["the cat", "zebra 9", "", "é"]
    rows = spark.createDataFrame([(t,) for t in asked], "text string").select("text", model.bits(F.col("text")).alias("s")).collect()
    for row in rows:
        symbols = [0] * 3 + quality._SYMBOL_OF[np.frombuffer(row.text.encode(), dtype=np.uint8)].tolist()
        bits = -sum(math.log2(chance(tuple(symbols[i - 3 : i + 1]))) for i in range(3, len(symbols)))
        assert row.s.n_symbols == len(row.text.encode())
        assert row.s.bits == pytest.approx(bits, rel=1e-4)


def test_quality_keeps_clean_and_rejects_junk(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(CALM, 50)) + ".", ["en", "de", None][i % 3]) for i in range(300)]
    rows += [(1000 + i, " ".join(w.upper() + "%%%" for w in rng.choice(CALM, 50)), "en") for i in range(20)]
    rows += [(2000, "a quiet river", "fr")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.q for r in quality.with_quality(docs, *quality.fitted(docs, labels)).collect()}
    assert not any(out[1000 + i].kept for i in range(20))
    assert sum(out[i].kept for i in range(300)) >= 295
    assert out[2000].kept
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(q.kept for q in out.values())


def test_quality_of_languages_with_few_labels(spark):
    """One trusted document, or copies of it, say nothing about how far the others of a language may lie."""
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(rng.choice(CALM, 50)) + ".", "en") for i in range(200)]
    rows += [(300 + i, " ".join(rng.choice(CALM, 50)) + ".", ["few", None][i % 2]) for i in range(100)]
    rows += [(500 + i, rows[200][1], "few") for i in range(30)]
    docs = documents(spark, rows)
    good = [*range(150), 300, 301, *range(500, 530)]
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.q for r in quality.with_quality(docs, *quality.fitted(docs, labels)).collect()}
    assert sum(out[i].kept for i in range(300, 400)) >= 98
    few = labels.filter("doc_id = 1")
    assert quality.good_documents(docs, few).count() == docs.count()


def test_limits_come_from_models_that_have_not_counted_the_text(spark):
    """Each trusted text has words of its own: a model that has read them finds them usual."""
    rng = np.random.default_rng(13)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(40))
    docs = documents(spark, [(i, text()) for i in range(140)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.q for r in quality.with_quality(docs, *quality.fitted(docs, labels)).collect()}
    assert sum(out[i].kept for i in range(40, 140)) >= 95


def test_quality_without_labels_and_on_messy_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    docs = messy(spark)
    for own in (labels, labels.limit(0)):
        judged = quality.with_quality(docs, *quality.fitted(docs, own))
        assert judged.count() == docs.count()
        assert all(r.q.kept for r in judged.collect() if not (r.text or ""))
    assert quality.good_documents(nothing(spark), labels).count() == 0


def test_pipeline_against_its_stages_by_hand(spark, tmp_path):
    """Stage by stage: toxic and junk documents go, of copies the first stays, the mix is what the
    operator says, and packing lays down all that came."""
    docs, labels = _toxic_corpus(spark, 300, seed=3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    junk = [(5000 + i, " ".join(w.upper() + "&&&" for w in CALM)) for i in range(4)]
    copies = [(6000 + i, rows[1][1] if i % 2 else rows[2][1].upper()) for i in range(6)]
    every = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows + junk + copies], DOCS)
    every.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        held = corpus_pipeline.written(stage(spark, held, str(tmp_path)), name)
        seen.append(held)
    clean, good, different, mixed, packed = seen
    toxic = {i for i, t in rows if any(w in t for w in [*INSULTS, "zugla"])}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows + junk + copies} - toxic
    assert {5000, 5001, 5002, 5003}.isdisjoint(r.doc_id for r in good.collect())
    ids = {r.doc_id for r in different.collect()}
    assert {1, 2} <= ids and ids.isdisjoint(range(6000, 6006))
    assert {r.doc_id for r in mixed.collect()} <= ids
    from llm.bpe import byte_bpe, vocabulary_files

    bpe = byte_bpe(*vocabulary_files())
    assert packed.agg(F.sum("length")).first()[0] == sum(len(bpe.encode(r.text)) + 1 for r in mixed.collect())
    assert clean.columns == good.columns == different.columns == mixed.columns == every.columns
    assert len(corpus_pipeline.run(spark, str(tmp_path)).columns) == 7
