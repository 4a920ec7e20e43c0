"""Collocations against counts of every phrase, one by one."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import collocations as co
from tools import documents, messy, nothing


def _pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", lower)]


def _counts(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in _pieces(text):
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    return counts, totals


def _expected(rows, least, top):
    counts, totals = _counts(rows)
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    found = {}
    for (lang, phrase), a in candidates.items():
        around = [b for (other, longer), b in candidates.items() if other == lang and len(longer) > len(phrase) and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))]
        if any(100 * b >= 80 * a for b in around):
            continue
        cuts = [(counts[lang, phrase[:k]], counts[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        found.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right))
    out = set()
    for lang, rows_of in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def _corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "cc", "Dé", "é", "the", "THE", "|", "日本", "x-y", "a\x00"]
    weights = [9, 3, 3, 2, 2, 2, 20, 5, 1, 1, 1, 1]
    rows = []
    for i in range(size):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 60))
        if i % 3 == 0:
            words += "one of the most of the most".split()
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und", "a b"]), text))
    return rows


@pytest.mark.parametrize(("leaves", "least", "top"), [(co.LEAVES, 3, 40), (30, 3, 2000), (7, 5, 2000)])
def test_collocations_are_those_of_all_counts(spark, leaves, least, top):
    rows = _corpus(leaves, 150)
    docs = documents(spark, [(i, text, lang) for i, (lang, text) in enumerate(rows)]).repartition(3)
    out = co.collocations(docs, least=least, top=top, leaves=leaves).collect()
    expected = _expected(rows, least, top)
    assert len(out) == len(expected) > 20
    assert {tuple(r) for r in out} == expected


def test_all_counts_whatever_the_groups(spark):
    rows = _corpus(3, 60)
    docs = documents(spark, [(i, text, lang) for i, (lang, text) in enumerate(rows)]).repartition(2)
    counts, totals = _counts(rows)
    expected = {(lang, " ".join(words), f) for (lang, words), f in counts.items() if f >= 2}
    for leaves in (5, 100, 1_000_000):
        found, words = co.phrase_counts(docs, least=2, leaves=leaves)
        assert {(r.lang, r.phrase, r.f) for r in found.collect()} == expected
        assert {(r.lang, r.n) for r in words.collect()} == {(k, n) for k, n in totals.items()} | {(k, 0) for k in {"und" if x is None else x for x, _ in rows} - set(totals)}


def test_frequent_prefixes_are_lengthened():
    counts = np.zeros((4, 256), dtype=np.int64)
    counts[0, 5] = counts[1, 6] = counts[2, 7] = counts[3, 8] = 5_000
    plan = co.Groups(counts, 100)
    assert plan.limit == 100 and plan.parts[3][8] == 50 and plan.parts[0][5] == 1


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", "x y", 2, 9 * 10**17), ("en", "x", 1, 10**18), ("en", "y", 1, 10**18)], "lang string, phrase string, words int, f long")
    gain = co._exact(F.col("f")) * F.lit(2_000_000).cast("decimal(7,0)")
    row = counts.filter("words = 2").select(gain.alias("gain"), co._exact(F.lit(2 * 10**18)).alias("both")).selectExpr("gain div both AS score").first()
    assert row.score == 2_000_000 * 9 * 10**17 // (2 * 10**18)


def test_collocations_of_messy_documents(spark):
    docs = messy(spark)
    out = {(r.lang, r.phrase): r for r in co.collocations(docs, least=2).collect()}
    assert ("en", "no id here") in out and ("en", "no id") not in out
    assert ("en", "w1 w2 w3 w4") in out and out["en", "w1 w2 w3 w4"].a == 31
    assert co.collocations(nothing(spark)).isEmpty()
    assert co.collocations(docs, least=10**6).isEmpty()
