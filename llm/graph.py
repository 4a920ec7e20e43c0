"""Connected components of a link table by alternating large-star and small-star steps, after the
published MapReduce algorithm (Kiveris et al., 2014). No step needs all links of a node in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from llm.common import written


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) of every linked node: root is the smallest node it reaches, itself included.
    Loops and repeated links do no harm; no links give no rows."""
    ends = [F.col(a), F.col(b)]
    pairs = links.select(F.greatest(*ends).alias("high"), F.least(*ends).alias("low"))
    pairs = written(pairs.filter("high != low").distinct(), "links")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.union(pairs.select("low", "high")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("top"))
        least = least.select("node", F.least("node", "top").alias("top"))
        large = both.filter("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("top").alias("low"))
        top = large.groupBy("high").agg(F.min("low").alias("top"))
        small = large.join(top, "high").filter("low != top").select(F.col("low").alias("high"), F.col("top").alias("low"))
        pairs = written(small.union(top.select("high", F.col("top").alias("low"))).distinct(), "links")
        before, mark = mark, _mark(pairs)
        if mark == before:
            break
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        pairs.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links among a task's rows, the first row that each one reaches."""
    label = np.arange(len(linked))
    while True:
        reach = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        lower = np.minimum(label, reach)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower
