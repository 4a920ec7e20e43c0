"""Hard negatives by rotated one-bit codes with deterministic bounds, after RaBitQ (Gao and Long, 2024).

A vector of whole numbers is turned by a fixed random rotation and written as its signs times a stored alignment,
the mean size of its coordinates; what that leaves is turned again and has a code of its own, and so on. Anchors
are turned alike and kept as bit planes of small whole numbers, so the product of an anchor and a code is a few
popcounts. What a row's codes leave out, and what an anchor's planes round off, is stored as a length. By the
Cauchy-Schwarz inequality the true product then lies in a known interval around the estimate: a row whose
interval can't matter for an anchor is dropped after the first code, after the second, and so on. Products of
whole numbers are then computed for the rows that are left. Intervals never miss, so the answer is exact.

Anchors are a stated part of the rows and meet all rows in blocks. Rows stream through a task, which holds one
block of anchors with the best rows found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from llm.common import grouped, table, together, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this share of the positive's.
LEAST_PERCENT = 80
#: Codes of a row; each leaves about 60 percent of the length before it.
CODES = 8
#: Bits of an anchor's coordinates.
PLANES = 7
#: Anchors that a task holds, some 10 MB, and rows that they meet there: no more than the larger figure, and no
#: more than lets every core work, down to the smaller one.
ANCHOR_BLOCK, ROW_BLOCK, FEWEST_ROWS = 8_192, 65_536, 2_048
#: Anchors and rows compared at once.
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 64, 4_096
#: Sums of squares that keep every product inside a long.
MOST_SQUARE = 1 << 62
SEED = 11


@dataclass
class Coded:
    """Rows as whole numbers, codes (row, code, 64-bit word), alignments, and the length left after each code."""

    id: np.ndarray
    label: np.ndarray
    whole: np.ndarray
    codes: np.ndarray
    align: np.ndarray
    left: np.ndarray
    norm: np.ndarray

    def take(self, at) -> Coded:
        return Coded(*(getattr(self, x)[at] for x in self.__dataclass_fields__))


@dataclass
class Planes:
    """Anchors, turned once more for each code, as low + step * number: the numbers' bit planes (anchor, code,
    bit, 64-bit word), and the most that rounding adds to a product with signs."""

    bits: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    off: np.ndarray

    def take(self, at) -> Planes:
        return Planes(*(getattr(self, x)[at] for x in self.__dataclass_fields__))


def rotation(size: int) -> np.ndarray:
    """The same random rotation in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def _packed(bits: np.ndarray) -> np.ndarray:
    """The last axis as 64-bit words."""
    words = -(-bits.shape[-1] // 64)
    padded = np.zeros((*bits.shape[:-1], words * 64), dtype=np.uint8)
    padded[..., : bits.shape[-1]] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def encode(whole: np.ndarray, turn: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, alignments and the length left after each code."""
    rest = whole.astype(np.float64)
    n, size = rest.shape
    up, align, left = np.zeros((n, codes, size), dtype=bool), np.zeros((n, codes)), np.zeros((n, codes))
    for k in range(codes):
        rest = rest @ turn.T
        up[:, k] = rest > 0
        align[:, k] = np.abs(rest).mean(axis=1)
        rest = rest - np.where(up[:, k], 1.0, -1.0) * align[:, k, None]
        left[:, k] = np.linalg.norm(rest, axis=1)
    return _packed(up), align, left


def planes(whole: np.ndarray, turn: np.ndarray, codes: int = CODES) -> Planes:
    turned, parts = whole.astype(np.float64), []
    size = turned.shape[1]
    for _ in range(codes):
        turned = turned @ turn.T
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-12)
        number = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        rounded = turned - low[:, None] - number * step[:, None]
        bits = np.stack([(number >> b) & 1 for b in range(PLANES)], axis=1).astype(np.uint8)
        # |<rounded, signs>| <= |rounded| |signs|
        parts.append((_packed(bits), low, step, number.sum(axis=1), np.linalg.norm(rounded, axis=1) * np.sqrt(size)))
    return Planes(*(np.stack(x, axis=1) for x in zip(*parts, strict=True)))


def _popcounts(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sum of the numbers whose planes are ``bits`` (..., bit, word) where ``codes`` (..., word) has ones."""
    out = 0
    for b in range(bits.shape[-2]):
        for w in range(bits.shape[-1]):
            out = out + (np.bitwise_count(bits[..., b, w] & codes[..., w]).astype(np.int32) << b)
    return out


def within(anchors: Coded, spread: Planes, rows: Coded, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) numbers of the pairs in ``asked``, a matrix, whose interval meets [low, high] of the
    anchor after every code. A margin far above rounding errors is left on both sides."""
    size = anchors.whole.shape[1]
    ones = np.bitwise_count(rows.codes).sum(axis=2, dtype=np.int64)
    # The first code of all pairs at once, the others of those that are left.
    first = _popcounts(spread.bits[:, None, 0], rows.codes[None, :, 0])
    a, r = np.nonzero(asked)
    count = first[a, r]
    estimate, slack = np.zeros(len(a)), 1e-9 * anchors.norm[a] * rows.norm[r] + 1e-6
    for k in range(rows.codes.shape[1]):
        if k:
            count = _popcounts(spread.bits[a, k], rows.codes[r, k])
        product = spread.step[a, k] * (2 * count - spread.total[a, k]) + spread.low[a, k] * (2 * ones[r, k] - size)
        estimate = estimate + rows.align[r, k] * product
        slack = slack + rows.align[r, k] * spread.off[a, k]
        reach = anchors.norm[a] * rows.left[r, k] + slack
        keep = (estimate + reach >= low[a]) & (estimate - reach <= high[a])
        a, r, estimate, slack = a[keep], r[keep], estimate[keep], slack[keep]
    return a, r


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, exact: in doubles where no partial sum passes 2^53, else in whole numbers."""
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    # Products and partial sums may wrap, the whole sum fits (see MOST_SQUARE) and is right modulo 2^64.
    return (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)


def _first(key: np.ndarray, score: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each key, by score downwards, then id, each id once."""
    order = np.lexsort((row, -score, key))
    k, s, i = key[order], score[order], row[order]
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (k[1:] == k[:-1]) & (s[1:] == s[:-1]) & (i[1:] == i[:-1])
    order, k = order[~again], k[~again]
    begin = np.searchsorted(k, k)
    return order[np.arange(len(k)) - begin < most]


class Best:
    """The best rows found so far for each of ``count`` keys."""

    def __init__(self, count: int, most: int):
        self.most, self.count = most, count
        self.key, self.score, self.row = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        key, score, row = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.row, row)))
        kept = _first(key, score, row, self.most)
        self.key, self.score, self.row = key[kept], score[kept], row[kept]

    def bounds(self) -> np.ndarray:
        """The score of the last place where all places are taken; nothing is too low elsewhere."""
        full = np.bincount(self.key, minlength=self.count) >= self.most
        last = np.full(self.count, np.inf)
        np.minimum.at(last, self.key, self.score.astype(np.float64))
        return np.where(full, last, -np.inf)


def _blocks_of(count: int) -> Iterator[slice]:
    return (slice(low, low + ANCHORS_AT_ONCE) for low in range(0, count, ANCHORS_AT_ONCE))


def find_positives(anchors: Coded, spread: Planes, rows: Coded, best: Best) -> None:
    """Adds to ``best``, by anchor, the rows with the anchor's label and another id."""
    bounds, found = best.bounds(), []
    for at in _blocks_of(len(anchors.id)):
        some = anchors.take(at)
        asked = (some.label[:, None] == rows.label) & (some.id[:, None] != rows.id)
        a, r = within(some, spread.take(at), rows, asked, bounds[at], np.full(len(some.id), np.inf))
        found.append((a + at.start, products(some.whole[a], rows.whole[r]), rows.id[r]))
    best.add(*map(np.concatenate, zip(*found, strict=True)))


def find_negatives(anchors: Coded, spread: Planes, limits: np.ndarray, there: np.ndarray, rows: Coded, best: Best) -> None:
    """Adds to ``best``, by (anchor, place of the positive), the rows with another label whose score is at most
    the positive's and at least the wanted share of it. ``limits`` has each anchor's positive scores, where
    ``there`` says that there is one."""
    places = limits.shape[1]
    # An anchor looks for what some positive of it still needs, and for nothing without positives.
    least = np.where(there, np.maximum(limits * (LEAST_PERCENT / 100), best.bounds().reshape(-1, places)), np.inf).min(axis=1)
    most = np.where(there, limits, -np.inf).max(axis=1)
    found = []
    for at in _blocks_of(len(anchors.id)):
        some = anchors.take(at)
        a, r = within(some, spread.take(at), rows, some.label[:, None] != rows.label, least[at], most[at])
        score = products(some.whole[a], rows.whole[r])
        a = a + at.start
        for j in range(places):
            limit = limits[a, j]
            good = there[a, j] & (score <= limit) & _at_least(score, limit)
            found.append((a[good] * places + j, score[good], rows.id[r[good]]))
    best.add(*map(np.concatenate, zip(*found, strict=True)))


def _at_least(score: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """100 * score >= 80 * limit in whole numbers, without products that pass 64 bits."""
    hundreds, rest = limit // 100, limit % 100
    return score >= hundreds * LEAST_PERCENT + -(-rest * LEAST_PERCENT // 100)


ROWS = T.StructType(
    [T.StructField(n, t) for n, t in (("id", T.LongType()), ("label", T.LongType()), ("whole", T.BinaryType()), ("codes", T.BinaryType()), ("align", T.BinaryType()), ("left", T.BinaryType()))]
)


def coded_rows(vectors: DataFrame, id_column: str, label: Column, vector: str) -> DataFrame:
    """The rows that take part, once each, with their codes: see ``hard_negatives``."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], ROWS)
    size = usual["n"]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(size)
        for whole_batch in batches:
            for low in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(low, 4096)
                # A null has become NaN; floats are doubles of the same value.
                values = batch.column(2).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
                with np.errstate(all="ignore"):
                    scaled = np.floor(values * SCALE)
                    good = np.isfinite(values).all(axis=1) & ((scaled * scaled).sum(axis=1) < MOST_SQUARE)
                kept = np.flatnonzero(good)
                # Smaller than 2^31, as squares are smaller than MOST_SQUARE.
                whole = scaled[kept].astype(np.int32)
                codes, align, left = encode(whole, turn)
                columns = [[x.tobytes() for x in part] for part in (whole, codes, align, left)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), *[pa.array(c, pa.binary()) for c in columns]], names=ROWS.names
                )

    return rows.filter(F.size("v") == size).mapInArrow(convert, ROWS).distinct()


def _read(group: pa.Table | pa.RecordBatch, at: int) -> Coded:
    """Coded rows from the six columns that begin at ``at``."""
    n = group.num_rows
    names, labels = (group.column(at + i).to_numpy().astype(np.int64) for i in (0, 1))
    whole, codes, align, left = (b"".join(group.column(at + i).to_pylist()) for i in range(2, 6))
    align = np.frombuffer(align, dtype=np.float64).reshape(n, -1)
    ints = np.frombuffer(whole, dtype=np.int32).reshape(n, -1)
    bits = np.frombuffer(codes, dtype=np.uint64).reshape(n, align.shape[1], -1)
    return Coded(names, labels, ints, bits, align, np.frombuffer(left, dtype=np.float64).reshape(n, -1), np.linalg.norm(ints.astype(np.float64), axis=1))


def _meetings(anchors: DataFrame, rows: DataFrame, anchor_block: int, row_block: int) -> DataFrame:
    """All anchors and all rows, block by block: (meeting, side, columns of anchors), anchors before rows.
    Blocks are dealt by hashes, so a frequent label or id spreads."""
    count = rows.count()
    spread = min(rows.sparkSession.sparkContext.defaultParallelism, -(-count // FEWEST_ROWS))
    blocks = [max(1, -(-anchors.count() // anchor_block)), max(1, -(-count // row_block), spread)]
    columns = anchors.columns

    def dealt(df: DataFrame, side: int) -> DataFrame:
        own = F.pmod(F.xxhash64("id", "whole"), F.lit(blocks[side]))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[1 - side] - 1).cast("long")))
        placed = df.withColumn("own", own).withColumn("other", other)
        pair = ["own", "other"] if side == 0 else ["other", "own"]
        return placed.select(F.concat_ws("/", *pair).alias("meeting"), F.lit(side).alias("side"), *columns)

    wide = rows.withColumns({c: F.lit(None).cast(anchors.schema[c].dataType) for c in columns if c not in rows.columns})
    return dealt(anchors, 0).unionByName(dealt(wide, 1)).repartition("meeting").sortWithinPartitions("meeting", "side")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Iterator[Coded]]]:
    """(anchors, rows in small lots) of each meeting."""
    for group in grouped(batches):
        side = group.column(1).to_numpy()
        cut = int(np.searchsorted(side, 1))
        if cut and cut < len(side):
            lots = range(cut, len(side), ROWS_AT_ONCE)
            yield group.slice(0, cut), (_read(group.slice(low, min(ROWS_AT_ONCE, len(side) - low)), 2) for low in lots)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column | str = "label",
    id_column: str = "vec_id",
    vector: str = "embedding",
    anchor_block: int = ANCHOR_BLOCK,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which
    ``anchors``, a condition on the column ``id``, holds, and each of its first 5 other rows with the same label,
    the first 5 rows with another label that score from 80 to 100 percent of the positive. Scores are products of
    floor(256 * x); higher ones come first, of equal ones the smaller id. Ids and labels are whole numbers. Rows
    without id, label or vector take no part, nor do vectors that hold a null, NaN or infinity, that have another
    length than most (of lengths equally frequent the smallest), or whose sum of squares passes 2^62, as products
    would pass a long. Repeated rows come once; rows with one id and different vectors or labels are all compared,
    and an id comes once in a list with the same score. No rows give no rows; other columns play no part."""
    label = F.col(label) if isinstance(label, str) else label
    rows = written(coded_rows(vectors, id_column, label, vector), "coded")
    asked = rows.filter(anchors)
    # Rows may share an id.
    key = F.concat_ws("/", "id", F.xxhash64("label", "whole"))

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, lots in _met(batches):
            own = _read(held, 2)
            spread, best = planes(own.whole, rotation(own.whole.shape[1])), Best(len(own.id), POSITIVES)
            for lot in lots:
                find_positives(own, spread, lot, best)
            yield pa.RecordBatch.from_arrays(
                [held.column(8).combine_chunks().take(pa.array(best.key)), pa.array(best.row), pa.array(best.score)], names=["anchor", "positive_id", "positive_score"]
            )

    marked = written(asked.withColumn("anchor", key), "anchors")
    found = _meetings(marked, rows, anchor_block, row_block).mapInArrow(positives, "anchor string, positive_id long, positive_score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    # Few rows for each anchor: so many as blocks of rows, times five.
    chosen = found.distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= POSITIVES)
    chosen = written(chosen, "positives")
    limits = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("positives"))
    limited = marked.join(limits.select("anchor", F.col("positives.positive_score").alias("limits")), "anchor").select(*ROWS.names, "anchor", "limits")
    limited = written(limited, "limited-anchors")

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, lots in _met(batches):
            own = _read(held, 2)
            limits = held.column(9).to_pylist()
            there = np.arange(POSITIVES) < np.array([[len(x)] for x in limits])
            limits = np.array([x + [0] * (POSITIVES - len(x)) for x in limits], dtype=np.int64)
            spread, best = planes(own.whole, rotation(own.whole.shape[1])), Best(len(own.id) * POSITIVES, NEGATIVES)
            for lot in lots:
                find_negatives(own, spread, limits, there, lot, best)
            names = held.column(8).combine_chunks().take(pa.array(best.key // POSITIVES))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array((best.key % POSITIVES + 1).astype(np.int32)), pa.array(best.row), pa.array(best.score)], names=["anchor", "place", "negative_id", "negative_score"]
            )

    hits = _meetings(limited, rows, anchor_block, row_block).mapInArrow(negatives, "anchor string, place int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    names = marked.select("anchor", F.col("id").alias("anchor_id"))
    out = ranked.join(chosen, ["anchor", "place"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


OP12_SQL = f"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scores n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id) <= {NEGATIVES}
"""
