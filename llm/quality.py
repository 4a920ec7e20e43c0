"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model is trained on all trusted documents over the symbols that the bytes of a text fall into: 64
classes by a fixed rule (each small letter, capitals, digits, punctuation, parts of longer characters), so
there can't be more than 64^4 different 4-grams, however large the corpus. Their counts are summed in
shards, and discounts, contexts and lower orders come from joins of the counts. The finished table is
bounded by the alphabet and goes to all tasks, where each document's 4-grams meet it without a shuffle.

A document is kept if its bits a symbol don't exceed the limit of its language, which comes from quantiles
of the trusted documents of that language, blended with those of all where they are few. For the limits the
trusted documents are scored by models of the other half of them, never by one that has counted them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from llm.common import bounded_batches, key_of, sent_if_few, small_batches, text_or_empty, written

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
#: Symbols of an average text of its language that are added to each document, so that the few symbols of
#: a short one don't decide alone.
PRIOR_SYMBOLS = 64
#: The limit lies this many times as far above the median of the trusted documents as their high quantile.
HIGH_QUANTILE = 0.99
STRETCH = 2.0
#: With fewer different trusted texts a language has the limit of all, but none below its own; with fewer
#: in all there are no limits.
FEWEST_TEXTS = 20
#: At so many different texts a language's own quantiles count as much as those of all.
EQUAL_TEXTS = 100


def _symbol_table() -> np.ndarray:
    """The symbol of each byte. 0 is kept for the edge of a text."""
    symbols = np.zeros(256, dtype=np.uint8)
    small = list(range(ord("a"), ord("z") + 1))
    groups = [[x] for x in small] + [list(range(ord("A"), ord("Z") + 1)), list(range(ord("0"), ord("9") + 1)), [32], [10, 13]]
    groups.append([*range(10), 11, 12, *range(14, 32), 127])
    groups += [list(b"\"'`"), list(b"()[]{}<>")] + [[x] for x in b"!#$%&*+,-./:;=?@\\^_|~"]
    groups += [list(range(x, x + 16)) for x in (0x80, 0x90, 0xA0, 0xB0)]
    groups += [list(range(0xC0, 0xC4)), list(range(0xC4, 0xD0)), list(range(0xD0, 0xE0)), list(range(0xE0, 0xF0)), list(range(0xF0, 0x100))]
    for number, group in enumerate(groups, start=1):
        symbols[group] = number
    return symbols


_SYMBOL_OF = _symbol_table()


def gram_codes(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of the texts, edge symbols before the first, and how many
    symbols each text has."""
    raw = [x.encode() for x in texts]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    pad = b"\xff" * (order - 1)
    flat = np.frombuffer(b"".join(x for r in raw for x in (pad, r)), dtype=np.uint8)
    symbols = _SYMBOL_OF[flat].astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes + order - 1)])[:-1]
    edge = np.add.outer(starts, np.arange(order - 1)).ravel()
    symbols[edge] = 0
    codes = np.zeros(len(symbols), dtype=np.uint32)
    for back in range(order):
        codes[back:] |= symbols[: len(symbols) - back] << (BITS * back)
    inside = np.ones(len(symbols), dtype=bool)
    inside[edge] = False
    return codes[inside], sizes


def count_grams(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows (gram, n) of all texts. Each task sums what it reads before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # No task reads four billion symbols.
        total = np.zeros(1 << (BITS * ORDER), dtype=np.uint32)
        for batch in small_batches(batches, 0, 1 << 20):
            codes, _ = gram_codes(batch.column(0).to_pylist())
            found, n = np.unique(codes, return_counts=True)
            total[found] += n.astype(np.uint32)
        found = np.flatnonzero(total)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], names=["gram", "n"])

    counts = texts.select(text_or_empty(text).alias("text")).mapInArrow(count, "gram int, n long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (gram, n): (gram, share) with the discounted share of its context, and (context, left), the
    share of the context that is left for the lower order."""
    many = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    y = many["n1"] / (many["n1"] + 2 * many["n2"]) if many["n1"] else 0.5
    # The usual estimates; where counts of counts are missing, as in tiny corpora, y itself.
    taken = [y]
    for k in (1, 2, 3):
        here, above = many[f"n{k}"], many[f"n{k + 1}"]
        taken.append(min(max(k - (k + 1) * y * above / here, 0.05), k - 0.05) if here else y)
    of = F.when(F.col("n") == 1, taken[1]).when(F.col("n") == 2, taken[2]).otherwise(taken[3])
    marked = counts.select("gram", "n", of.alias("off"), F.shiftright("gram", BITS).alias("context"))
    contexts = marked.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("off_total"))
    shares = marked.join(contexts, "context").select("gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("share"))
    return shares, contexts.select("context", (F.col("off_total") / F.col("total")).alias("left"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> list[tuple[pd.DataFrame, pd.DataFrame]]:
    """For each order from 1: shares of seen n-grams and what their contexts leave. Below the highest
    order a gram counts the different symbols before it. No more rows than the alphabet allows."""
    levels = []
    for size in range(order, 0, -1):
        shares, left = _discounted(counts)
        levels.append((shares.toPandas(), left.toPandas()))
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (size - 1))) - 1))
        counts = counts.groupBy(shorter.alias("gram")).agg(F.count("*").alias("n"))
    return levels[::-1]


def bits_table(levels: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Bits of every possible n-gram: interpolated from the lowest order up. Levels hold the arrays gram,
    share, context, left."""
    chances = np.full(1, 1, dtype=np.float32)
    for size, (gram, share, context, left) in enumerate(levels, start=1):
        rest = np.ones(1 << (BITS * (size - 1)), dtype=np.float32)
        rest[context] = left
        # The lower order's codes lack the first symbol; below order 1 all symbols are as likely.
        lower = chances if size > 1 else np.full(SYMBOLS, 1 / SYMBOLS, dtype=np.float32)
        chances = np.repeat(rest, SYMBOLS)
        chances.reshape(-1, len(lower))[:] *= lower
        chances[gram] += share.astype(np.float32)
    np.log2(chances, out=chances)
    return np.negative(chances, out=chances)


@dataclass
class QualityModel:
    levels: Broadcast

    def bits(self, text: Column) -> Column:
        """A struct of n_symbols and bits (their sum). A null text is empty."""
        levels, held = self.levels, {}

        @F.pandas_udf("n_symbols long, bits double")
        def score(texts: pd.Series) -> pd.DataFrame:
            # Built once per task, 64 MB, and gone with it, as later stages run in the same workers.
            bits = held.get("bits")
            if bits is None:
                bits = held["bits"] = bits_table(levels.value)
            sizes, sums, batch, length = [], [], [], 0
            values = texts.tolist()
            for i, value in enumerate(values):
                batch.append(value)
                length += len(value)
                if length > 1 << 20 or i == len(values) - 1:
                    codes, n = gram_codes(batch)
                    upto = np.concatenate([[0.0], np.cumsum(bits[codes], dtype=np.float64)])
                    ends = np.cumsum(n)
                    sizes.append(n)
                    sums.append(upto[ends] - upto[ends - n])
                    batch, length = [], 0
            none = np.zeros(0)
            return pd.DataFrame({"n_symbols": np.concatenate([none.astype(np.int64), *sizes]), "bits": np.concatenate([none, *sums])})

        return score(text_or_empty(text))


def trusted_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", quality: str = "quality") -> DataFrame:
    """The documents labelled good, and by no label bad. Rows without id or label are not."""
    graded = labels.filter(F.col(quality).isNotNull() & F.col(id_column).isNotNull())
    good = graded.groupBy(id_column).agg(F.min(quality).alias("least")).filter("least > 0").select(id_column)
    return docs.join(sent_if_few(good), id_column, "left_semi")


def _model(counts: DataFrame) -> QualityModel | None:
    if counts.isEmpty():
        return None
    levels = [
        (s["gram"].to_numpy(), s["share"].to_numpy(), c["context"].to_numpy(), c["left"].to_numpy()) for s, c in kneser_ney(counts)
    ]
    return QualityModel(counts.sparkSession.sparkContext.broadcast(levels))


def train(trusted: DataFrame, text: str = "text") -> QualityModel | None:
    """None if the trusted texts hold no symbol."""
    bounded_batches()
    return _model(written(count_grams(trusted, text), "grams"))


def _smooth(bits: Column, symbols: Column, usual: Column) -> Column:
    return (bits + PRIOR_SYMBOLS * usual) / (symbols + PRIOR_SYMBOLS)


def language_limits(scored: DataFrame) -> DataFrame:
    """From (lang_key, mark, n_symbols, bits) of the trusted documents, scored by models that haven't
    counted them, rows (lang_key, usual, top): for each language, null included, and for all together
    (lang_key ``all``) their mean bits a symbol and the limit. ``mark`` tells different texts apart."""
    both = scored.unionByName(scored.withColumn("lang_key", F.lit("all")))
    mean = F.sum("bits") / F.greatest(F.sum("n_symbols"), F.lit(1))
    usual = both.groupBy("lang_key").agg(mean.alias("usual"))
    texts = both.select("lang_key", "mark").distinct().groupBy("lang_key").agg(F.count("*").alias("texts"))
    smooth = both.join(F.broadcast(usual), "lang_key").select("lang_key", "usual", _smooth(F.col("bits"), F.col("n_symbols"), F.col("usual")).alias("x"))
    cuts = smooth.groupBy("lang_key", "usual").agg(F.percentile_approx("x", [0.5, HIGH_QUANTILE], 100_000).alias("q"))
    cuts = cuts.join(texts, "lang_key").select("lang_key", "usual", "texts", F.col("q")[0].alias("middle"), F.col("q")[1].alias("high"))
    # Languages are never called so: their keys begin with v, or are n.
    every = cuts.filter("lang_key = 'all'").select(F.col("middle").alias("all_middle"), F.col("high").alias("all_high"))
    own = F.when(F.col("lang_key") == "all", 1.0).otherwise(F.col("texts") / (F.col("texts") + EQUAL_TEXTS))
    middle, high = (own * F.col(x) + (1 - own) * F.col(f"all_{x}") for x in ("middle", "high"))
    few = F.greatest(_limit(F.col("middle"), F.col("high")), _limit(F.col("all_middle"), F.col("all_high")))
    top = F.when(F.col("texts") < FEWEST_TEXTS, few).otherwise(_limit(middle, high))
    return cuts.join(F.broadcast(every)).select("lang_key", "usual", top.alias("top"))


def _limit(middle: Column, high: Column) -> Column:
    return middle + STRETCH * (high - middle)


def with_quality(docs: DataFrame, model: QualityModel | None, limits: DataFrame | None, lang: str = "lang", text: str = "text") -> DataFrame:
    """Adds a struct ``q`` to every row (an input column of that name gives way): n_symbols,
    bits_per_symbol (smoothed), perplexity, top and kept. A language without trusted documents has the
    limit of all (see ``language_limits`` for few); without a model everything is kept. Null texts are empty, and empty ones are kept.
    Repeated rows are judged alike; other columns stay."""
    own = [c for c in docs.columns if c.lower() != "q"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), key_of(lang).alias("lang_key"), text_or_empty(text).alias("text"))
    if model is None:
        none = F.lit(None).cast("double")
        size = F.octet_length("text").cast("long")
        judged = rows.withColumns({"n_symbols": size, "bits_per_symbol": none, "top": none})
    else:
        # One row per language, a short label each.
        found = {r.lang_key: (r.usual, r.top) for r in limits.collect()}
        usual, top = found.pop("all")
        by_lang = docs.sparkSession.createDataFrame([(k, *v) for k, v in found.items()], "lang_key string, usual double, top double")
        judged = rows.join(F.broadcast(by_lang), "lang_key", "left").fillna({"usual": usual, "top": top}).withColumn("s", model.bits(F.col("text")))
        judged = judged.withColumns({"n_symbols": F.col("s.n_symbols"), "bits_per_symbol": _smooth(F.col("s.bits"), F.col("s.n_symbols"), F.col("usual"))})
    kept = (F.col("n_symbols") == 0) | F.coalesce(F.col("bits_per_symbol") <= F.col("top"), F.lit(True))
    perplexity = F.pow(F.lit(2.0), "bits_per_symbol").alias("perplexity")
    q = F.struct("n_symbols", "bits_per_symbol", perplexity, "top", kept.alias("kept"))
    return judged.select(*[F.col("row")[c].alias(c) for c in own], q.alias("q"))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[QualityModel | None, DataFrame | None]:
    """Model and limits from all documents labelled good; none where fewer than FEWEST_TEXTS different
    texts are, or one half is empty. Equal texts lie in the same half."""
    bounded_batches()
    trusted = trusted_documents(docs, labels).select("lang", "text")
    mark = F.xxhash64(text_or_empty("text"))
    marks = trusted.filter(F.octet_length("text") > 0).select(mark.alias("mark")).distinct()
    if marks.limit(FEWEST_TEXTS).count() < FEWEST_TEXTS:
        return None, None
    halves = [trusted.filter(F.pmod(mark, F.lit(2)) == k) for k in (0, 1)]
    counts = [written(count_grams(half), "grams") for half in halves]
    models = [_model(x) for x in counts]
    if not all(models):
        return None, None
    scored = []
    for half, other in zip(halves, models[::-1], strict=True):
        judged = half.select(key_of("lang").alias("lang_key"), mark.alias("mark"), other.bits(F.col("text")).alias("s"))
        scored.append(judged.select("lang_key", "mark", "s.n_symbols", "s.bits"))
    whole = written(counts[0].unionByName(counts[1]).groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    return _model(whole), language_limits(written(scored[0].unionByName(scored[1]), "trusted-bits"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that keep to their language's limit, with their columns."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "lang", "text")
    return with_quality(whole, *fitted(docs, labels)).filter("q.kept").select("row.*")
