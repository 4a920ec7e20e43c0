"""Approximate nearest neighbours by balanced posting lists.

A bounded sample gives centroids, whose graph stays in memory. Every vector is posted to the lists of its
nearest centroids, those near a boundary to several. A query walks the graph to its nearest centroids and
searches the lists whose centroid is at most a calibrated ratio farther than the nearest one. Lists that lie
near each other share a shelf: a vector stands there once, whichever of its lists are on the shelf, and so
does a query; a shelf larger than a block is dealt over many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridwork.session import removed
from llm.common import grouped, table, together, written, written_at
from llm.vectors import comparable, cosines, element_type, matrix, sample_rows, smallest_ids, unit_rows

#: Vectors that the index is fitted on at most; all are indexed.
SAMPLE = 20_000
VECTORS_PER_LIST = 100
MOST_LISTS = 4096
REPLICAS = 4
REPLICA_RATIO = 1.15
GRAPH_DEGREE = 16
#: The ratio is set so that this share of the sample's true neighbours lies in searched lists.
WANTED_RECALL = 0.98
#: A shelf holds so many rows at least, if there are as many, and vectors of so many bytes at most.
BLOCK = 2048
MEETING_BYTES = 16 << 20
#: Similarities worked out at once.
CELLS = 4 << 20
ROWS_AT_ONCE = 256
SEED = 7


@dataclass
class Centroids:
    """Unit centroids, for each its neighbours in the graph, and the ratio that searches keep to. Each shelf is
    an array of lists and dealt in so many ``blocks``; the sample comes with the lists of each of its vectors."""

    centers: np.ndarray
    links: np.ndarray
    ratio: float = 1.0
    beam: int = 8
    shelves: list[np.ndarray] = field(default_factory=list)
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sample: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    sample_lists: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and distances, nearest first, found by walking the graph best-first from fixed
        entries, all queries at once. Unfilled places have the distance infinity."""
        n, size = len(queries), len(self.centers)
        beam = min(beam, size)
        entries = np.unique(np.linspace(0, size - 1, min(size, max(8, beam // 4))).astype(np.int64))
        dist = _distances(queries @ self.centers[entries].T)
        found = np.tile(entries, (n, 1))
        seen = np.zeros((n, size), dtype=bool)
        seen[:, entries] = True
        done = np.zeros((n, size), dtype=bool)
        rows = np.arange(n)[:, None]
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            found, dist = np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1)
            fresh = ~done[rows, found] & np.isfinite(dist)
            if not fresh.any():
                return found, dist
            # The best places not yet walked from, of every query: four, or more where many are wanted.
            rank = np.cumsum(fresh, axis=1)
            walk = fresh & (rank <= max(4, beam // 4))
            at, place = np.nonzero(walk)
            node = found[at, place]
            done[at, node] = True
            new = np.zeros((n, size), dtype=bool)
            new[np.repeat(at, self.links.shape[1]), self.links[node].ravel()] = True
            who, to = np.nonzero(new & ~seen)
            seen |= new
            d = np.concatenate([np.zeros(0), *[_distances(np.einsum("ij,ij->i", queries[w], self.centers[t])) for w, t in _parts(who, to)]])
            count = np.bincount(who, minlength=n)
            width = int(count.max(initial=0))
            column = np.arange(len(who)) - (np.cumsum(count) - count)[who]
            more, more_d = np.zeros((n, width), dtype=np.int64), np.full((n, width), np.inf)
            more[who, column], more_d[who, column] = to, d
            found, dist = np.hstack([found, more]), np.hstack([dist, more_d])

    def _near(self, rows: np.ndarray, beam: int, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number, centroid, place) of the nearest centroids, ``most`` at the utmost, that lie at most
        ``ratio`` times as far as the nearest. Few rows at a time, as walking takes memory."""
        numbers, nodes, places = [], [], []
        for low in range(0, len(rows), ROWS_AT_ONCE):
            found, dist = self.nearest(rows[low : low + ROWS_AT_ONCE], beam)
            found, dist = found[:, :most], dist[:, :most]
            near = dist <= ratio * np.maximum(dist[:, :1], 1e-9)
            near[:, 0] = True
            at, place = np.nonzero(near)
            numbers.append(at + low)
            nodes.append(found[at, place])
            places.append(place)
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([none, *x]) for x in (numbers, nodes, places))

    def posts(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector number, list, place) of each posting."""
        return self._near(vectors, max(8, 2 * REPLICAS), REPLICAS, REPLICA_RATIO)

    def lists(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, list, place) of each list to search, the nearest of a query at place 0."""
        return self._near(queries, self.beam, self.beam, self.ratio)

    def shelved(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(vector number, shelf, places on it of the vector's lists) of each shelf that a vector stands on."""
        shelf_of, place_of = np.empty(len(self.centers), np.int64), np.empty(len(self.centers), "<i4")
        for i, lists in enumerate(self.shelves):
            shelf_of[lists], place_of[lists] = i, np.arange(len(lists))
        at, lists, _ = self.posts(vectors)
        order = np.lexsort((shelf_of[lists], at))
        at, shelf, places = at[order], shelf_of[lists[order]], place_of[lists[order]]
        first = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(shelf, prepend=-1))
        ends = np.append(first, len(at))[1:]
        return at[first], shelf[first], [places[a:b].tobytes() for a, b in zip(first, ends)]

    def wanted(self, queries: np.ndarray, hits: int) -> tuple[np.ndarray, np.ndarray]:
        """Which lists each query searches, in bits, and how near a hit must be at least: as near as the
        sampled vectors in these lists, of which ``hits`` are that near. -2 where they hold fewer."""
        bits, bounds = [], []
        for low in range(0, len(queries), ROWS_AT_ONCE):
            some = queries[low : low + ROWS_AT_ONCE]
            at, lists, _ = self.lists(some)
            asked = np.zeros((len(some), len(self.centers)), dtype=bool)
            asked[at, lists] = True
            bits.append(np.packbits(asked, axis=1))
            bound = np.full(len(some), -2.0)
            if len(self.sample) >= hits:
                sims = some.astype(np.float32) @ self.sample.T
                held = asked[:, self.sample_lists[:, 0]]
                for own in self.sample_lists.T[1:]:
                    held |= asked[:, own]
                sims[~held] = -2
                bound = np.maximum(np.partition(sims, -hits, axis=1)[:, -hits] - 2 * _margin(some), -2).astype(np.float64)
            bounds.append(bound)
        return np.concatenate(bits), np.concatenate(bounds)

    def asked(self, bits: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(query number, shelf, for each list on it whether the query searches it) from the bits."""
        order = np.concatenate(self.shelves)
        ends = np.cumsum([len(x) for x in self.shelves])
        asked = np.unpackbits(bits, axis=1, count=len(self.centers))[:, order]
        starts = ends - [len(x) for x in self.shelves]
        for at, shelf in zip(*np.nonzero(np.bitwise_or.reduceat(asked, starts, axis=1))):
            yield int(at), int(shelf), asked[at, starts[shelf] : ends[shelf]].tobytes()


def _distances(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _margin(rows: np.ndarray) -> float:
    """How far a product of unit rows in single precision may be off."""
    return 1.2e-7 * (rows.shape[1] + 4)


def _parts(*arrays: np.ndarray, size: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    for low in range(0, len(arrays[0]), size):
        yield tuple(x[low : low + size] for x in arrays)


def _shelved(centers: np.ndarray, load: np.ndarray, most: int) -> list[np.ndarray]:
    """The lists, halved across where they lie widest until what they hold is no more than ``most`` or one list."""
    shelves, open_ = [], [np.arange(len(centers))]
    while open_:
        part = open_.pop()
        if len(part) == 1 or load[part].sum() <= most:
            shelves.append(part)
            continue
        off = centers[part] - centers[part].mean(axis=0)
        _, axes = np.linalg.eigh(off.T @ off)
        part = part[np.argsort(off @ axes[:, -1], kind="stable")]
        held = np.cumsum(load[part])
        cut = int(np.clip(np.searchsorted(held, held[-1] / 2), 1, len(part) - 1))
        open_ += [part[cut:], part[:cut]]
    return shelves


def _centers(sample: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means that charges large clusters a little, so that their vectors spread."""
    rng = np.random.default_rng(SEED)
    centers = sample[rng.choice(len(sample), count, replace=False)]
    load = np.ones(count)
    for _ in range(rounds):
        charge = 0.02 * np.log(np.maximum(load, 0.1))
        step = min(4096, max(1, CELLS // count))
        blocks = [np.argmax(sample[i : i + step] @ centers.T - charge, axis=1) for i in range(0, len(sample), step)]
        member = np.concatenate(blocks)
        sums = np.zeros_like(centers)
        np.add.at(sums, member, sample)
        n = np.bincount(member, minlength=count)
        load = n / n.mean()
        empty = np.flatnonzero((n == 0) | (np.linalg.norm(sums, axis=1) < 1e-12))
        sums[empty] = sample[rng.choice(len(sample), len(empty), replace=False)]
        centers = unit_rows(sums)
    return centers


def fit(sample: np.ndarray, vectors: int, neighbours: int, shelf_rows: int = BLOCK) -> Centroids:
    """Centroids, graph, ratio and shelves from unit rows; ``vectors`` is how many will be indexed. The sample
    is thinner than the whole, so its neighbours lie farther off and the ratio is on the safe side."""
    count = int(np.clip(vectors // VECTORS_PER_LIST, 1, min(MOST_LISTS, max(1, len(sample) // 4))))
    centers = _centers(sample, count)
    rng = np.random.default_rng(SEED)
    degree = min(GRAPH_DEGREE, count - 1)
    links = np.empty((count, degree), np.int64)
    for low in range(0, count, 512):
        cosine = centers[low : low + 512] @ centers.T
        cosine[np.arange(len(cosine)), np.arange(low, low + len(cosine))] = -2
        links[low : low + 512] = np.argsort(-cosine, axis=1, kind="stable")[:, :degree]
    far = rng.integers(0, count, (count, 4))
    index = Centroids(centers, np.hstack([links, far]))
    asked = rng.choice(len(sample), min(400, len(sample)), replace=False)
    best = []
    for q in asked:
        sims = sample @ sample[q]
        sims[q] = -2
        best.append(np.argsort(-sims, kind="stable")[: min(neighbours, len(sample) - 1)])
    to_center = _distances(sample[asked] @ centers.T)
    at, lists, _ = index.posts(sample)
    order = np.argsort(at, kind="stable")
    at, lists = at[order], lists[order]
    low = np.searchsorted(at, np.arange(len(sample) + 1))
    need = [
        to_center[q, lists[low[v] : low[v + 1]]].min() / max(to_center[q].min(), 1e-9) for q in range(len(asked)) for v in best[q]
    ]
    index.ratio = float(np.quantile(need, WANTED_RECALL)) if need else 1.0
    searched = (to_center <= index.ratio * to_center.min(axis=1, keepdims=True)).sum(axis=1)
    index.beam = int(min(count, 1.25 * searched.max() + 8))
    load = np.bincount(lists, minlength=count) * (vectors / len(sample))
    index.shelves = _shelved(centers, load, shelf_rows)
    index.blocks = np.array([max(1, int(np.ceil(load[x].sum() / shelf_rows))) for x in index.shelves])
    index.sample = sample.astype(np.float32)
    index.sample_lists = lists[np.minimum(low[:-1, None] + np.arange(REPLICAS), low[1:, None] - 1)]
    return index


def _sliced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, min(4096, most)):
            yield whole.slice(low, min(4096, most))


def _rank(rows: np.ndarray) -> np.ndarray:
    """Place of each in its run of equal numbers, from 0."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def _hits(queries: np.ndarray, vectors: np.ndarray, asked: np.ndarray, own: np.ndarray, bound: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, pairs of query and vector that can be among the ``most`` nearest) of some queries at a time;
    a vector counts if it stands in an asked list."""
    step = max(1, CELLS // len(vectors))
    margin = 2 * _margin(vectors)
    for low in range(0, len(queries), step):
        sims = queries[low : low + step] @ vectors.T
        row, col = np.nonzero(sims >= bound[low : low + step, None])
        kept = np.concatenate([np.zeros(0, bool), *[asked[r[:, None] + low, own[c]].any(axis=1) for r, c in _parts(row, col)]])
        row, col = row[kept], col[kept]
        sim = sims[row, col]
        order = np.lexsort((-sim, row))
        row, col, sim = row[order], col[order], sim[order]
        # The last place that counts, of each query; what may be as near stays.
        least = np.full(len(sims), -3.0)
        last = _rank(row) == most - 1
        least[row[last]] = sim[last]
        near = sim >= least[row] - margin
        if near.any():
            yield low, np.stack([row[near], col[near]])


def nearest(
    vectors: DataFrame, queries: Column, neighbours: int = 5, id_column: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE
) -> DataFrame:
    """Rows (query_id, rank, id, score): the nearest found by cosine for each row for which ``queries``, a
    condition on the column ``id``, holds. Rows that can't be compared (see ``comparable``) take no part;
    repeated rows come once; of equal scores the smaller id is nearer. Equal vectors are indexed as one
    class with its smallest ids, one more than wanted, as no others of it can be in an answer. An empty
    table gives no rows; other columns play no part."""
    kind = element_type(vectors, vector)
    rows, path = written_at(comparable(vectors, id_column, vector), "vectors")
    key = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", key), T.StructField("rank", T.IntegerType()), T.StructField("id", key), T.StructField("score", T.DoubleType())])
    spark = vectors.sparkSession
    classes = smallest_ids(rows, neighbours + 1)
    spark.sparkContext._jvm.System.gc()  # the shuffles of whole vectors go with their last reference
    count = classes.count()
    if not count:
        return spark.createDataFrame([], schema)
    sampled = sample_rows(classes, sample)
    cores = spark.sparkContext.defaultParallelism
    most = max(1, MEETING_BYTES // len(sampled[0]))
    shelf_rows = min(most, max(BLOCK, -(-REPLICAS * count // (2 * cores))))
    index = spark.sparkContext.broadcast(fit(unit_rows(matrix(sampled, kind)), count, neighbours, shelf_rows))

    names = [T.StructField("rep", key), T.StructField("vector", T.BinaryType())]
    places = T.StructType([*names, T.StructField("shelf", T.LongType()), T.StructField("lists", T.BinaryType()), T.StructField("bound", T.DoubleType()), T.StructField("blocks", T.LongType())])
    searches = T.StructType([*names, T.StructField("bits", T.BinaryType()), T.StructField("bound", T.DoubleType())])

    def placed(batch: pa.RecordBatch, at: np.ndarray, shelf: np.ndarray, lists: list[bytes], bound: np.ndarray) -> pa.RecordBatch:
        own = [c.take(pa.array(at)) for c in batch.columns[:2]]
        return pa.RecordBatch.from_arrays([*own, pa.array(shelf), pa.array(lists, pa.binary()), pa.array(bound), pa.array(index.value.blocks[shelf])], names=places.names)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, most):
            at, shelf, lists = index.value.shelved(unit_rows(matrix(batch.column(1).to_pylist(), kind)))
            yield placed(batch, at, shelf, lists, np.zeros(len(at)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, most):
            bits, bound = index.value.wanted(unit_rows(matrix(batch.column(1).to_pylist(), kind)), neighbours + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(bound)], names=searches.names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each shelf that it searches, few vectors at a time."""
        for batch in _sliced(batches, most):
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bound = batch.column(3).to_numpy()
            asked = index.value.asked(bits)
            while some := list(islice(asked, max(1, most // 4))):
                at, shelf = (np.array(x) for x in list(zip(*some))[:2])
                yield placed(batch, at, shelf, [x[2] for x in some], bound[at])

    # A class is told by the digest of its vector, so that whole vectors aren't shuffled for the few that are asked.
    told = F.unhex(F.sha2("vector", 256)).alias("told")
    asked = rows.filter(queries).distinct().select("id", "vector", told).join(classes.select("rep", told), "told")
    asked = written(asked.select(F.col("id").alias("query_id"), "rep", "vector"), "queries")
    removed(spark, path)
    wanted = asked.select("rep", "vector").distinct().repartition(max(2 * cores, asked.count() // most + 1))
    wanted = written(wanted.mapInArrow(ask, searches), "searches").mapInArrow(deal, places)
    sizes = wanted.groupBy("shelf").agg(F.ceil(F.count("*") / most).cast("long").alias("query_blocks"))
    sizes = written(sizes, "shelves")
    found = T.StructType([T.StructField("rep", key), T.StructField("near", key), T.StructField("score", T.DoubleType())])
    by_class = Window.partitionBy("rep").orderBy(F.desc("score"), "near")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            side = group.column(1).to_numpy()
            names = group.column(2).combine_chunks()
            q, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(q) or not len(v):
                continue
            values = matrix(group.column(3).to_pylist(), kind)
            units = unit_rows(values).astype(np.float32)
            lists = group.column(4).combine_chunks()
            asked = np.frombuffer(b"".join(lists.take(pa.array(q)).to_pylist()), np.uint8).reshape(len(q), -1)
            own = lists.take(pa.array(v)).to_pylist()
            size = np.array([len(x) for x in own]) // 4
            first = np.cumsum(size) - size
            own = np.frombuffer(b"".join(own), "<i4")[first[:, None] + np.minimum(np.arange(REPLICAS), size[:, None] - 1)]
            bound = group.column(5).to_numpy()[q]
            for low, rows in _hits(units[q], units[v], asked, own, bound, neighbours + 1):
                left, right = q[rows[0] + low], v[rows[1]]
                scores = np.concatenate([cosines(values[a], values[b]) for a, b in _parts(left, right)])
                best = pa.table([pa.array(left), names.take(pa.array(left)), names.take(pa.array(right)), pa.array(scores)], names=["row", *found.names])
                best = best.sort_by([("row", "ascending"), ("score", "descending"), ("near", "ascending")])
                yield from best.filter(pa.array(_rank(best["row"].to_numpy()) <= neighbours)).select(found.names).combine_chunks().to_batches()

    def dealt(table: DataFrame, side: int, own: str, other: str) -> DataFrame:
        # One row per shelf, of which there are no more than MOST_LISTS.
        mine = table.join(F.broadcast(sizes), "shelf").withColumn(own[:-1], F.pmod(F.xxhash64("rep"), F.col(own)))
        mine = mine.withColumn(other[:-1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        meeting = F.concat_ws("/", "shelf", "block", "query_block").alias("meeting")
        return mine.select(meeting, F.lit(side).alias("side"), "rep", "vector", "lists", "bound")

    asking = dealt(wanted, 0, "query_blocks", "blocks")
    held = dealt(classes.select("rep", "vector").mapInArrow(post, places), 1, "blocks", "query_blocks")
    hits = together(asking.unionByName(held), "meeting").mapInArrow(search, found)

    once = hits.groupBy("rep", "near").agg(F.max("score").alias("score"))
    top = once.withColumn("place", F.row_number().over(by_class)).filter(F.col("place") <= neighbours + 1)
    members = classes.select(F.col("rep").alias("near"), "members")
    rows_near = top.join(members, "near").select("rep", "score", F.explode("members").alias("id"))
    own = asked.select("query_id", "rep").join(rows_near, "rep").filter("query_id != id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = own.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= neighbours)
    return out.select("query_id", "rank", "id", "score")


def recall(found: DataFrame, vectors: np.ndarray, ids: np.ndarray, neighbours: int = 5) -> float:
    """Share of the true neighbours that were found, against brute force over unit rows; for audits."""
    place = {int(x): i for i, x in enumerate(ids)}
    hit = total = 0
    for query, group in found.toPandas().groupby("query_id"):
        sims = vectors @ vectors[place[query]]
        sims[place[query]] = -2
        true = ids[np.lexsort((ids, -sims))[:neighbours]]
        hit += len(set(true.tolist()) & set(group["id"].tolist()))
        total += len(true)
    return hit / total if total else 1.0


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
