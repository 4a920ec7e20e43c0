"""Near-duplicate vectors by NN-descent.

Equal vectors are one class. Buckets of random hyperplanes give each class a first list of neighbours;
rounds of neighbours-of-neighbours joins refine the lists. Pairs at the threshold, in lists or met in
buckets, link classes into components. A list that is full of links is saturated, so the lists of linked classes are then enlarged to
their whole component, block against block, where links are counted and not written out. An audit holds a
sample against brute force and asks for more buckets if links are missing; a search that still misses
links after the last attempt fails.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from llm.common import grouped, table, together, written
from llm.graph import components, forest
from llm.vectors import comparable, cosines, element_type, matrix, unit_rows

THRESHOLD = 0.9
LIST = 10
TREES = 8
BUCKET = 128
BLOCK = 512
#: Members of a larger bucket that stand in every block of it.
HUBS = 8
MOST_ROUNDS = 4
#: Rounds end when fewer than this share of the list places change.
STILL = 0.02
AUDITED = 512
#: Sampled classes with links that an audit needs, unless all classes have fewer.
AUDITED_LINKED = 256
WANTED_RECALL = 0.99
#: Each attempt takes twice as many trees as the one before.
MOST_ATTEMPTS = 6

_EDGE = "src binary, dst binary, score double, fresh int"
#: Of two classes that hang together the bond says so; it is no place of a list.
_BEGUN = f"{_EDGE}, bond boolean"


def _scored(values: np.ndarray, left: np.ndarray, right: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Similarities, recomputed on the original rows wherever they could decide about a link."""
    out = sims.copy()
    near = out >= THRESHOLD - 1e-6
    out[near] = cosines(values[left[near]], values[right[near]])
    return out


def _edges(names: pa.Array, left: np.ndarray, right: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    fresh = np.ones(len(left), dtype=np.int32)
    return pa.RecordBatch.from_arrays([names.take(pa.array(left)), names.take(pa.array(right)), pa.array(scores), pa.array(fresh)], names=["src", "dst", "score", "fresh"])


def _best(edges: DataFrame) -> DataFrame:
    """The LIST best different neighbours of each class; an edge known before stays known."""
    once = edges.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LIST).drop("place")


def first_lists(classes: DataFrame, count: int, kind: str, attempt: int) -> DataFrame:
    """Neighbours inside buckets of hyperplane signs, TREES different ones, and bonds, a tree of the
    links among the classes that meet: a list holds only LIST of them, and of a group of tight groups
    just its own group. Buckets with more members than a block are dealt into several, by another hash
    in each tree and attempt, and these share some members."""
    bits = max(0, math.ceil(math.log2(max(count, 1) / BUCKET)))
    schema = T.StructType([T.StructField("bucket", T.StringType()), *classes.select("node", "vector").schema.fields])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1).to_pylist(), kind)
            for tree in range(TREES):
                planes = np.random.default_rng([attempt, tree]).standard_normal((rows.shape[1], bits))
                codes = (rows @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(rows), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([f"{tree}/{c}" for c in codes.tolist()], pa.string()), *batch.columns], names=schema.names)

    signs = classes.select("node", "vector").mapInArrow(sign, schema)
    large = signs.groupBy("bucket").agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK)
    large = large.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("long"))
    salt = [F.lit(attempt), F.col("bucket"), F.col("node")]
    zero = F.lit(0).cast("long")
    dealt = signs.join(large, "bucket", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("blocks")), zero))
    hub = F.coalesce(F.pmod(F.xxhash64(F.lit("hub"), *salt), F.col("members")) < HUBS, F.lit(False))
    parts = F.when(hub, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array("own"))
    dealt = dealt.withColumn("part", F.explode(parts)).select(F.concat_ws("/", "bucket", "part").alias("bucket"), "node", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            n = group.num_rows
            if n < 2:
                continue
            values = matrix(group.column(2).to_pylist(), kind)
            unit = unit_rows(values)
            sims = unit @ unit.T
            np.fill_diagonal(sims, -2)
            linked = sims >= THRESHOLD
            a, b = np.nonzero(np.abs(sims - THRESHOLD) < 1e-9)
            linked[a, b] = cosines(values[a], values[b]) >= THRESHOLD
            first = forest(linked | linked.T)
            bound = np.flatnonzero(first != np.arange(n))
            most = min(LIST, n - 1)
            best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            left, right = np.repeat(np.arange(n), most), best.ravel()
            names = group.column(1).combine_chunks()
            for a, b, scores, bond in ((left, right, _scored(values, left, right, sims[left, right]), False), (bound, first[bound], np.ones(len(bound)), True)):
                edges = _edges(names, a, b, scores)
                yield pa.RecordBatch.from_arrays([*edges.columns, pa.array(np.full(len(a), bond))], names=[*edges.schema.names, "bond"])

    return together(dealt, "bucket").mapInArrow(compare, _BEGUN)


def descend(edges: DataFrame, classes: DataFrame, kind: str, step: int) -> DataFrame:
    """One round: each class introduces its neighbours, forward and backward, to each other. Of very
    many backward neighbours a hash picks some; links that this misses are counted when lists are
    enlarged."""
    both = edges.select(F.col("src").alias("host"), F.col("dst").alias("node")).union(edges.select("dst", "src"))
    order = Window.partitionBy("host").orderBy(F.xxhash64(F.lit(step), "node"), "node")
    guests = both.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 3 * LIST).drop("place")
    worst = edges.groupBy("src").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    worst = worst.select(F.col("src").alias("node"), F.when(F.col("n") < LIST, -2.0).otherwise(F.col("worst")).alias("worst"))
    known = classes.select("node", "vector").join(worst, "node", "left").fillna(-2.0, ["worst"])
    meet = together(guests.join(known, "node").select("host", "node", "vector", "worst"), "host")

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            n = group.num_rows
            if n < 2:
                continue
            values = matrix(group.column(2).to_pylist(), kind)
            unit = unit_rows(values)
            sims = unit @ unit.T
            np.fill_diagonal(sims, -3)
            left, right = np.nonzero(sims > group.column(3).to_numpy()[:, None])
            yield _edges(group.column(1).combine_chunks(), left, right, _scored(values, left, right, sims[left, right]))

    return meet.mapInArrow(introduce, _EDGE)


def _count_links(placed: DataFrame, kind: str) -> DataFrame:
    """(node, links): for each class of a component how many vectors of other classes it links with.
    From (root, node, vector, copies, size); blocks of a component meet pairwise."""
    blocks = placed.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = blocks.withColumn("other", other).withColumns({"low": F.col("own"), "high": F.col("other"), "side": F.when(F.col("own") == F.col("other"), 2).otherwise(0)})
    columns = blocks.withColumn("other", other).filter("own != other").withColumns({"low": F.col("other"), "high": F.col("own"), "side": F.lit(1)})
    meeting = F.concat_ws("/", F.hex("root"), "low", "high").alias("meeting")
    meetings = rows.select(meeting, "side", "node", "vector", "copies").unionByName(columns.select(meeting, "side", "node", "vector", "copies"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            side = group.column(1).to_numpy()
            values = matrix(group.column(3).to_pylist(), kind)
            copies = group.column(4).to_numpy()
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side > 0)
            unit = unit_rows(values)
            sims = unit[left] @ unit[right].T
            linked = sims >= THRESHOLD
            close = np.abs(sims - THRESHOLD) < 1e-9
            if close.any():
                a, b = np.nonzero(close)
                linked[a, b] = cosines(values[left[a]], values[right[b]]) >= THRESHOLD
            linked &= left[:, None] != right[None, :]
            names = group.column(2).combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(left)), pa.array(linked @ copies[right])], names=["node", "links"])

    return together(meetings, "meeting").mapInArrow(count, "node binary, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _audit(classes: DataFrame, found: DataFrame, kind: str) -> float:
    """Mean share of their links with other classes, by brute force against all, that was found for the
    linked classes of a sample. Classes come by the order of a hash, AUDITED first and then more, until
    AUDITED_LINKED of them are linked or none is left."""
    spark = classes.sparkSession
    order = F.xxhash64(F.lit("audit"), "node")
    least, size, linked, shares = None, AUDITED, 0, 0.0
    while linked < AUDITED_LINKED:
        # Whole hashes: classes that share one come together.
        rest = classes.withColumn("hash", order)
        rest = rest if least is None else rest.filter(F.col("hash") > least)
        picked = rest.orderBy("hash").limit(size).select("hash", "node", "vector").toPandas()
        if not len(picked):
            break
        least = int(picked["hash"].iloc[-1])
        sent = spark.sparkContext.broadcast((picked["node"].tolist(), matrix(picked["vector"].tolist(), kind)))

        def hold(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, values = sent.value
            unit = unit_rows(values)
            total = np.zeros(len(names), dtype=np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    sims = unit @ unit_rows(matrix(part.column(1).to_pylist(), kind)).T
                    total += (sims >= THRESHOLD + 1e-9) @ part.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(total)], names=["node", "true_links"])

        true = classes.select("node", "vector", "copies").mapInArrow(hold, "node binary, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
        # A class always meets its own copies; they say nothing about the search.
        others = F.col("true_links") - F.col("copies")
        own = true.join(classes.select("node", "copies"), "node").join(found, "node", "left").withColumn("others", others).filter("others > 0")
        n, part = own.agg(F.count("*"), F.sum(F.least(F.coalesce("links", F.lit(0)), F.col("others")) / F.col("others"))).first()
        linked, shares, size = linked + n, shares + (part or 0.0), min(2 * size, 16 * AUDITED)
    return shares / linked if linked else 1.0


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per vector.

    Rows that can't be compared (see ``comparable``) link with nothing and are kept; several such rows of
    one id, or such a row beside a comparable one, give no row of their own, and all rows without id give
    one, whose component_id is null. Repeated rows are one vector; an id with several vectors has a row for
    each. Other columns play no part."""
    kind = element_type(vectors, vector)
    rows = comparable(vectors, id_column, vector).withColumn("node", F.unhex(F.md5("vector")))
    rows = written(rows.distinct(), "vectors")
    classes = written(rows.groupBy("node", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    count = classes.count()
    edges, bonds, trees = None, None, 0
    for attempt in range(MOST_ATTEMPTS):
        for _ in range(1 << attempt):
            met = written(first_lists(classes, count, kind, trees), "met")
            begun, bound = met.filter("NOT bond").drop("bond"), met.filter("bond").select("src", "dst")
            bonds = bound if bonds is None else bonds.unionByName(bound)
            edges = written(_best(begun if edges is None else begun.unionByName(edges)), "lists")
            trees += 1
        for step in range(MOST_ROUNDS):
            known = edges.withColumn("fresh", F.lit(0))
            edges = written(_best(known.unionByName(descend(edges, classes, kind, step))), "lists")
            changed = edges.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0]
            if changed <= STILL * LIST * count:
                break
        links = edges.filter(F.col("score") >= THRESHOLD).select("src", "dst").unionByName(bonds)
        roots = components(links.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        roots = written(roots.join(classes, "node"), "roots")
        sizes = roots.groupBy("root").agg(F.count("*").alias("size"), F.min("rep").alias("component_id"))
        placed = roots.join(sizes, "root")
        counted = written(_count_links(placed, kind), "links-counted")
        recall = _audit(classes, counted, kind)
        if recall >= WANTED_RECALL:
            break
    else:
        raise RuntimeError(f"the search found {recall:.4f} of the links after {MOST_ATTEMPTS} attempts, {WANTED_RECALL} are wanted")
    named = classes.join(counted, "node", "left").join(placed.select("node", "component_id"), "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    named = named.select("node", n_links.cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    found = rows.select("id", "node").join(named, "node").select(F.col("id").alias(id_column), "n_links", "component_id")
    rest = vectors.select(id_column).distinct().join(rows.select(F.col("id").alias(id_column)), id_column, "left_anti")
    rest = rest.select(id_column, F.lit(0).cast("long").alias("n_links"), F.col(id_column).alias("component_id"))
    kept = F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True))
    return found.unionByName(rest).withColumn("kept", kept)


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links and the component they belong to."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM rows a JOIN rows b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {THRESHOLD}),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links,
       (SELECT min(other) FROM reach WHERE id = e.vec_id) AS component_id,
       (SELECT min(other) FROM reach WHERE id = e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""
