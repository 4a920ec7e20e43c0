"""Packing by lexical retrieval.

A document's ids end with id 0. Full windows of one document stand alone; what is left of it is a unit.
Units whose documents share their rarest common terms are dealt into one shard, however large the corpus;
each shard holds a BM25 inverted index of the whole documents of its units, with document frequencies and
mean length taken over all of the corpus. The longest unused unit seeds a window; the
index returns its unused neighbours, best first, which fill the window; the last one is cut where the window
ends and the rest of it goes on as a unit. What remains of a shard at its end is cut into sequences whose
lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from llm.bpe import byte_bpe, vocabulary_files
from llm.common import bounded_batches, grouped, small_batches, table, text_or_empty, together, written

WINDOW = 1024
END_ID = 0
UNITS_PER_SHARD = 2048
QUERY_TERMS = 24
#: A term says where a unit goes if so many documents hold it; fewer don't fill a window.
LEAST_SHARED = 8
#: Rarest terms that deal units out: the first one, and the others where too many units share it.
DEALING_TERMS = 3
NEIGHBOURS = 32
K1, B = 1.2, 0.75


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def held(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, and how often each comes."""
    ids = np.sort(ids, kind="stable")  # by digits, as they have 16 bits
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
    return ids[first].astype(np.uint16), np.diff(first, append=len(ids)).astype(np.uint32)


def _held(unit: bytes, terms: bytes | None, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Those of the document that the unit is left of."""
    if terms is None:
        return held(np.frombuffer(unit, dtype=np.uint16))
    return np.frombuffer(terms, dtype=np.uint16), np.frombuffer(counts, dtype=np.uint32)


def encoded(docs: DataFrame, id_column: str, text: str, window: int, files: tuple[str, str]) -> DataFrame:
    """(id, doc_tokens, full, unit, terms, counts): checksums of the document's full windows, the ids left
    over, and the different ids of a document that has more than those, with how often it holds them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*files)
        end = np.array([END_ID], dtype=np.uint16)
        for batch in small_batches(batches, 1):
            tokens, full, unit, terms, counts = [], [], [], [], []
            for body in batch.column(1).to_pylist():
                ids = np.concatenate([bpe.encode(body), end])
                whole = len(ids) // window
                tokens.append(len(ids))
                full.append([ids_crc32(ids[i * window : (i + 1) * window]) for i in range(whole)])
                unit.append(ids[whole * window :].tobytes())
                found = [x.tobytes() for x in held(ids)] if whole else [None, None]
                terms.append(found[0])
                counts.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(full, pa.list_(pa.int64())), *[pa.array(x, pa.binary()) for x in (unit, terms, counts)]],
                names=["id", "doc_tokens", "full", "unit", "terms", "counts"],
            )

    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("full", T.ArrayType(T.LongType())),
            *[T.StructField(x, T.BinaryType()) for x in ("unit", "terms", "counts")],
        ]
    )
    return rows.mapInArrow(encode, schema)


def corpus_weights(units: DataFrame, vocabulary: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Of every id the number of documents that hold it and BM25's inverse document frequency, and the mean
    document length, over the documents of all units. No task sends more rows than there are ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seen[_held(*row)[0]] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(seen[found])], names=["token", "n"])

    total, length = units.agg(F.count("*"), F.coalesce(F.avg("doc_tokens"), F.lit(1.0))).first()
    rows = units.select("unit", "terms", "counts").mapInArrow(count, "token int, n long")
    counts = rows.groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(vocabulary, dtype=np.int64)
    seen[counts["token"].to_numpy()] = counts["n"].to_numpy()
    return seen, np.log1p((total - seen + 0.5) / (seen + 0.5)).astype(np.float32), float(length)


def dealt(units: DataFrame, seen: np.ndarray) -> DataFrame:
    """Adds the shard of each unit. Units with the same rarest term stand together, with the next terms
    where these are more than UNITS_PER_SHARD, and scattered only where even those are the same."""
    spark = units.sparkSession
    sent = spark.sparkContext.broadcast(seen)
    names = [f"term{i}" for i in range(DEALING_TERMS)]
    schema = T.StructType([*units.schema.fields, *[T.StructField(x, T.IntegerType()) for x in names]])
    at = [units.columns.index(x) for x in ("unit", "terms", "counts")]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = np.full((batch.num_rows, DEALING_TERMS), -1, dtype=np.int32)
            for i, row in enumerate(zip(*[batch.column(x).to_pylist() for x in at], strict=True)):
                terms = _held(*row)[0].astype(np.int32)
                n = sent.value[terms]
                terms, n = (terms[n >= LEAST_SHARED], n[n >= LEAST_SHARED]) if (n >= LEAST_SHARED).any() else (terms, n)
                first = terms[np.lexsort((terms, n))[:DEALING_TERMS]]
                rare[i, : len(first)] = first
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(rare[:, i]) for i in range(DEALING_TERMS)]], names=schema.names)

    placed = written(units.mapInArrow(sign, schema), "signed-units")
    # No more rows than there are ids.
    shards, room, number = [], 0, -1
    for term, n in sorted((r["term0"], r["count"]) for r in placed.groupBy("term0").count().collect()):
        if n > room:
            number, room = number + 1, UNITS_PER_SHARD
        room -= n
        shards.append((term, number))
    placed = placed.join(F.broadcast(spark.createDataFrame(shards, "term0 int, shard long")), "term0")
    number += 1
    for salt in *[[F.col(x)] for x in names[1:]], [F.col("id"), F.col("doc_tokens"), F.crc32("unit")]:
        # One row for each full shard at most.
        large = placed.groupBy("shard").count().filter(F.col("count") > UNITS_PER_SHARD).collect()
        if not large:
            break
        split = []
        for shard, n in sorted((r["shard"], r["count"]) for r in large):
            parts = -(-n // UNITS_PER_SHARD)
            split.append((shard, number, parts))
            number += parts
        placed = placed.join(F.broadcast(spark.createDataFrame(split, "shard long, from long, parts long")), "shard", "left")
        placed = placed.withColumn("shard", F.coalesce(F.col("from") + F.pmod(F.xxhash64(*salt), F.col("parts")), "shard")).drop("from", "parts")
    return placed.drop(*names)


class Index:
    """BM25 over the documents of one shard's units, by token id."""

    def __init__(self, units: list[np.ndarray], weights: np.ndarray, length: float, documents: list[tuple[np.ndarray, np.ndarray]] | None = None):
        documents = documents or [held(unit) for unit in units]
        self.terms, counts = [x[0] for x in documents], [x[1] for x in documents]
        owner = np.repeat(np.arange(len(units)), [len(x) for x in self.terms])
        token = np.concatenate([np.zeros(0, dtype=np.uint16), *self.terms]).astype(np.int64)
        n = np.concatenate([np.zeros(0), *counts])
        size = np.array([x.sum() for x in counts], dtype=np.float64)
        score = weights[token] * n * (K1 + 1) / (n + K1 * (1 - B + B * size[owner] / max(length, 1.0))) if len(token) else n
        order = np.argsort(token, kind="stable")
        self.owner, self.score, self.size = owner[order], score[order], len(units)
        self.start = np.searchsorted(token[order], np.arange(len(weights) + 1))
        self.weights = weights

    def neighbours(self, unit: int, unused: np.ndarray) -> np.ndarray:
        """Unused units that share one of the unit's rarest terms, of those that others have too, best first;
        ties by number."""
        terms = self.terms[unit].astype(np.int64)
        terms = terms[self.start[terms + 1] - self.start[terms] > 1]
        if not len(terms):
            return terms
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argsort(-self.weights[terms], kind="stable")[:QUERY_TERMS]]
        spans = [slice(self.start[t], self.start[t + 1]) for t in terms]
        who = np.concatenate([self.owner[s] for s in spans])
        scores = np.bincount(who, np.concatenate([self.score[s] for s in spans]), self.size) * unused
        best = np.argpartition(-scores, NEIGHBOURS)[:NEIGHBOURS] if self.size > NEIGHBOURS else np.arange(self.size)
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))]


def pack_shard(
    units: list[np.ndarray], weights: np.ndarray, length: float, window: int, documents: list[tuple[np.ndarray, np.ndarray]] | None = None
) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (sequence, offset, unit, first, end) that lay every id of every unit down once. ``documents``
    has the ids that each unit is found by, and their numbers; without them a unit stands for itself."""
    index = Index(units, weights, length, documents)
    used = np.zeros(len(units), dtype=np.int64)
    sizes = np.array([len(x) for x in units], dtype=np.int64)
    heap = [(-n, i) for i, n in enumerate(sizes.tolist()) if n]
    heapq.heapify(heap)
    unused = (sizes > 0).astype(np.float64)
    sequence, left = 0, int(sizes.sum())

    def longest() -> int:
        while True:
            n, i = heap[0]
            if -n == sizes[i] - used[i] and -n:
                return i
            heapq.heappop(heap)

    while left >= window:
        filled, waiting, seed = 0, [], None
        while filled < window:
            if seed is None:
                seed = unit = longest()
            elif waiting:
                unit = waiting.pop()
                if not unused[unit]:
                    continue
            else:
                waiting = index.neighbours(seed, unused)[::-1].tolist()
                if not waiting:
                    waiting = [longest()]
                continue
            take = int(min(window - filled, sizes[unit] - used[unit]))
            yield sequence, filled, unit, int(used[unit]), int(used[unit]) + take
            filled += take
            used[unit] += take
            if used[unit] < sizes[unit]:
                heapq.heappush(heap, (int(used[unit] - sizes[unit]), unit))
            else:
                unused[unit] = 0
        sequence += 1
        left -= window
    room, filled = 1 << int(math.log2(left)) if left else 0, 0
    for unit in np.flatnonzero(used < sizes).tolist():
        while used[unit] < sizes[unit]:
            take = int(min(room - filled, sizes[unit] - used[unit]))
            yield sequence, filled, unit, int(used[unit]), int(used[unit]) + take
            filled += take
            used[unit] += take
            if filled == room:
                left -= room
                sequence, filled, room = sequence + 1, 0, 1 << int(math.log2(left)) if left else 0


def pack(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, files: tuple[str, str] | None = None
) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset). ``window`` must be a power
    of two. A null or empty text has the end id alone; repeated rows are packed each; ids may be null; an
    empty table gives no pieces. Other columns play no part."""
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    bounded_batches()
    files = files or vocabulary_files()
    vocabulary = byte_bpe(*files).size
    rows = written(encoded(docs, id_column, text, window, files), "encoded")
    units = rows.filter(F.octet_length("unit") > 0).select("id", "doc_tokens", "unit", "terms", "counts")
    seen, weights, length = corpus_weights(units, vocabulary)
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            *[T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        ]
    )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            shard = group.column(0)[0].as_py()
            group = group.sort_by([("doc_tokens", "ascending"), ("id", "ascending"), ("unit", "ascending")])
            raw = [np.frombuffer(x, dtype=np.uint16) for x in group.column(3).to_pylist()]
            tokens = group.column(2).to_numpy()
            documents = [_held(*x) for x in zip(*[group.column(i).to_pylist() for i in (3, 4, 5)], strict=True)]
            pieces = np.array(list(pack_shard(raw, sent.value, length, window, documents)), dtype=np.int64).reshape(-1, 5)
            unit, first, end = pieces[:, 2], pieces[:, 3], pieces[:, 4]
            skipped = tokens - np.array([len(x) for x in raw])
            crc = [ids_crc32(raw[u][a:b]) for u, a, b in zip(unit, first, end, strict=True)]
            # Odd numbers; the sequences of single documents have the even ones.
            sequence = 2 * ((shard << 32) + pieces[:, 0]) + 1
            columns = [skipped[unit] + first, end - first, np.array(crc, dtype=np.int64), tokens[unit], sequence, pieces[:, 1]]
            ids = group.column(1).combine_chunks().take(pa.array(unit))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x) for x in columns]], names=schema.names)

    shards = dealt(units, seen).select("shard", "id", "doc_tokens", "unit", "terms", "counts")
    packed = together(shards, "shard").mapInArrow(lay, schema)
    alone = rows.select("id", "doc_tokens", F.posexplode("full").alias("number", "ids_crc32"))
    alone = alone.select(
        F.col("id").alias(id_column),
        (F.col("number").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (2 * F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return alone.unionByName(packed)


def op3_packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack(table(spark, sf_dir, "documents"))
