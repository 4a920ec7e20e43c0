"""Normal forms worked out in the JVM against those of Python."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from gridwork.functions.labels import fold_label, folds_to_one_of

LABELS = ["genel toplam", "total", "imza", "hazirlayan", "straße", "合計", "3 mi"]


def _spellings(rng, label):
    """Texts that may or may not fold to a label: other cases, marks, forms, ligatures and separators."""
    strange = [c for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) <= 0xDFFF]
    by_fold = {}
    for c in strange:
        by_fold.setdefault(fold_label(c), []).append(c)
    marks = [c for c in strange if unicodedata.combining(c)]
    blanks = [c for c in strange if unicodedata.category(c)[0] in "PZSC"][:400]
    for _ in range(400):
        out = []
        for c in label:
            kind = rng.random()
            same = by_fold.get(c, []) if c != " " else blanks
            out.append(rng.choice(same) if same and kind < 0.5 else c.upper() if kind < 0.7 else c)
            if rng.random() < 0.15:
                out.append(rng.choice(marks))
        if rng.random() < 0.2:
            out.insert(rng.randrange(len(out) + 1), rng.choice(strange))
        if rng.random() < 0.3:
            out.append(rng.choice(blanks))
        yield "".join(out)


def test_normal_forms_in_the_jvm(spark):
    rng = random.Random(2)
    labels = [fold_label(x) for x in LABELS]
    texts = sorted({t for label in labels for t in _spellings(rng, label)} | {"", " ", "ﬁ", "³㎖", "TOTAL­", "ıMZA", "İmza", "ﬆrasse", "3㎖", "strasse"})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.hit for r in df.select("i", folds_to_one_of(F.col("t"), labels).alias("hit")).collect()}
    wrong = [(t, fold_label(t), got[i]) for i, t in enumerate(texts) if got[i] != (fold_label(t) in labels)]
    assert not wrong, wrong[:5]
    assert sum(got.values()) > 500
