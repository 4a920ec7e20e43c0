"""Near-duplicates by a signature-coordinate inverted join.

Documents with equal shingle sets are one class. A class has a signature of K minimum hashes and is posted
under each (coordinate, value). Two classes whose signatures agree in at least T coordinates must share one
of the K - T + 1 rarest coordinates of either (prefix filter), so the others, with the long posting lists,
are skipped. Inside a posting list collisions of whole signatures are counted and pairs with T or more
kept; lists too long for that link all their members. Such links only say which classes must meet:
full shingle sets then decide, block against block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from llm.common import bounded_batches, grouped, sent_if_few, small_batches, table, text_or_empty, together, written
from llm.graph import components, forest
from llm.shingles import mixed, shingle_sets

#: The contract of the query op7, and what documents of the pipeline are held against.
SIMILAR_PERCENT = 85
STAGE_PERCENT = 80
#: A pair at the wanted similarity agrees in too few coordinates once in so many cases at most.
MISSED_ONCE_IN = 60_000
#: Longer posting lists are not compared pair by pair, but linked as a whole.
COUNTED_LIST = 64
#: Classes that meet in one task.
BLOCK = 256
#: Bytes of text whose shingles a task computes at once; each takes some fifty bytes more meanwhile.
TEXT_BYTES = 1 << 20
#: Members of a larger group that every block of it meets first.
HUBS = 8


def miss_rate(coordinates: int, least: int, percent: int) -> float:
    """How often a pair of that similarity agrees in fewer coordinates than ``least``."""
    p = percent / 100
    return sum(math.comb(coordinates, i) * p**i * (1 - p) ** (coordinates - i) for i in range(least))


def scheme(percent: int) -> tuple[int, int]:
    """(coordinates, least matches): the fewest coordinates of which half are enough for MISSED_ONCE_IN; for
    60 percent or less, where they become many, 64 and as many matches as that allows."""
    for coordinates in range(8, 65, 4):
        if miss_rate(coordinates, coordinates // 2, percent) * MISSED_ONCE_IN <= 1:
            return coordinates, coordinates // 2
    return 64, max([t for t in range(1, 65) if miss_rate(64, t, percent) * MISSED_ONCE_IN <= 1], default=1)


def signatures(hashes: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """One row per set: a 64-bit name of (coordinate, minimum) for each coordinate. Sets must not be empty."""
    out = np.empty((len(bounds) - 1, coordinates), dtype=np.uint64)
    if not len(out):
        return out
    seeds = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factors, addends = seeds[:coordinates] | np.uint64(1), seeds[coordinates:]
    for i in range(coordinates):
        least = np.minimum.reduceat(hashes * factors[i] + addends[i], bounds[:-1])
        out[:, i] = mixed(least + np.uint64(i))
    return out


def _texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column(column).cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _class_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, coordinates: int) -> DataFrame:
    """From (id, text): (id, n_shingles, class, signature); without words no class."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, TEXT_BYTES):
            sets = shingle_sets(*_texts(batch, 1))
            sizes = np.diff(sets.bounds)
            full = sizes > 0
            classes = [_class_of(sets.of(i)) if n else None for i, n in enumerate(sizes)]
            rows = signatures(sets.hashes, np.concatenate([[0], np.cumsum(sizes[full])]), coordinates)
            offsets = np.concatenate([[0], np.cumsum(np.where(full, coordinates, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(classes, pa.binary()), lists], names=["id", "n_shingles", "class", "signature"]
            )

    schema = T.StructType(
        [
            T.StructField("id", docs.schema["id"].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("class", T.BinaryType()),
            T.StructField("signature", T.ArrayType(T.LongType())),
        ]
    )
    return docs.select("id", "text").mapInArrow(sign, schema)


def _postings(classes: DataFrame, least_matches: int) -> DataFrame:
    """(element, class, n): the rarest shared coordinates of each class, n its list's length. Coordinates
    that no other class has come first in the prefix, and post nothing."""
    elements = classes.select("class", F.explode("signature").alias("element"))
    counts = elements.groupBy("element").agg(F.count("*").alias("posted")).filter("posted > 1")
    shared = elements.join(counts, "element")
    by_class = shared.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("posted", "element"))).alias("shared"))
    length = F.size("shared") - (least_matches - 1)
    prefix = by_class.filter(length > 0).select("class", F.explode(F.slice("shared", F.lit(1), length)).alias("e"))
    prefix = written(prefix.select("class", F.col("e.element").alias("element")), "prefix")
    lists = prefix.groupBy("element").agg(F.count("*").alias("n"), F.min("class").alias("first")).filter("n > 1")
    return prefix.join(lists, "element")


def _counted_links(postings: DataFrame, classes: DataFrame, least_matches: int) -> DataFrame:
    """Links (a, b) among members of a list whose signatures agree often enough; of those that hang
    together only a tree."""
    listed = postings.filter(F.col("n") <= COUNTED_LIST).select("class", "element").join(classes.select("class", "signature"), "class")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for group in grouped(batches):
            names = group.column(1).to_pylist()
            rows = group.column(2).combine_chunks().flatten().to_numpy().reshape(len(names), -1)
            agree = (rows[:, None, :] == rows[None, :, :]).sum(axis=2) >= least_matches
            first = forest(agree)
            for i in np.flatnonzero(first != np.arange(len(names))):
                left.append(names[i])
                right.append(names[first[i]])
            if len(left) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return together(listed.select("element", "class", "signature"), "element").mapInArrow(count, "a binary, b binary")


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union, exactly. Only values that several
    sets hold are multiplied out, some thousand at a time."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[value] > 1
    owner, column = owner[keep], number[value[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    np.fill_diagonal(common, sizes)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def _confirmed(meetings: DataFrame, percent: int) -> DataFrame:
    """From rows (meeting, class, set): a tree of links (a, b) among the classes that meet."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            names = group.column(1).to_pylist()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column(2).to_pylist()]
            first = forest(similar(sets, percent))
            linked = [i for i, f in enumerate(first) if f != i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in linked], pa.binary()), pa.array([names[first[i]] for i in linked], pa.binary())], names=["a", "b"]
            )

    return together(meetings.select("meeting", "class", "set"), "meeting").mapInArrow(confirm, "a binary, b binary")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("class"), blocks)


def _numbers(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))


def _meeting(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """From (class, group, size, set): links that connect whatever similar pairs of a group connect.
    Small groups meet at once. Of a large one, each block meets some hubs; then only what stays outside
    the largest part must meet all blocks, since pairs inside that part add nothing."""
    group = F.hex("group")
    small = sets.filter(F.col("size") <= BLOCK).select(_meeting(group).alias("meeting"), "class", "set")
    large = sets.filter(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    hub = F.pmod(F.xxhash64(F.lit("hub"), "class"), F.col("size")) < HUBS
    own = _block(F.col("blocks"))
    in_block = large.select(_meeting(group, own).alias("meeting"), "class", "set")
    every = large.filter(hub).withColumn("b", _numbers(F.col("blocks"))).filter(F.col("b") != own)
    every = every.select(_meeting(group, F.col("b")).alias("meeting"), "class", "set")
    first = written(_confirmed(small.unionByName(in_block).unionByName(every), percent), "links")
    if large.isEmpty():
        return first
    parts = components(first).select(F.col("node").alias("class"), "root")
    placed = large.join(parts, "class", "left").withColumn("part", F.coalesce("root", "class")).drop("root")
    sizes = placed.groupBy("group", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("group").agg(F.max(F.struct("n", "part")).alias("m"), F.sum("n").alias("size"))
    largest = largest.select("group", F.col("m.part").alias("main"), (F.col("size") - F.col("m.n")).alias("outside")).filter("outside > 0")
    placed = placed.join(F.broadcast(largest), "group").withColumn("outer_blocks", F.ceil(F.col("outside") / BLOCK).cast("long"))
    outside = placed.filter("part != main").withColumn("o", _block(F.col("outer_blocks"))).withColumn("b", _numbers(F.col("blocks")))
    inside = placed.withColumn("b", own).withColumn("o", _numbers(F.col("outer_blocks")))
    # A class that stands on both sides of a meeting comes once, from inside.
    outside = outside.filter(F.col("b") != own)
    meeting = _meeting(group, F.col("o"), F.col("b")).alias("meeting")
    second = _confirmed(outside.select(meeting, "class", "set").unionByName(inside.select(meeting, "class", "set")), percent)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = SIMILAR_PERCENT) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one per document. Documents link if so many percent of
    their shingles are common.

    Repeated rows (same id and same words) are one document; rows with the same id and other words are
    documents of their own. Null or empty texts have no shingles and link with nothing; rows without id
    neither, their component_id is null and they are kept. Other columns play no part."""
    found = _judged(docs, id_column, text, percent)
    return found.select(F.col("id").alias(id_column), "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, id_column: str, text: str, percent: int) -> DataFrame:
    """Rows (id, class, n_shingles, component_id, kept) of ``near_duplicates``."""
    bounded_batches()
    coordinates, least_matches = scheme(percent)
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text"))
    signs = written(signed(rows, coordinates), "signatures")
    named = signs.filter(F.col("id").isNotNull() & F.col("class").isNotNull())
    classes = named.groupBy("class").agg(F.min("id").alias("id"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")
    postings = _postings(classes, least_matches)
    stars = postings.filter((F.col("n") > COUNTED_LIST) & (F.col("class") != F.col("first")))
    candidates = _counted_links(postings, classes, least_matches).unionByName(stars.select(F.col("class").alias("a"), F.col("first").alias("b")))
    met = components(candidates).select(F.col("node").alias("class"), F.col("root").alias("group"))
    met = met.join(met.groupBy("group").agg(F.count("*").alias("size")), "group")
    met = written(met, "groups")
    # Only classes that meet others need their sets; they are taken from the texts again.
    ids = sent_if_few(met.join(classes, "class").select("id").distinct())
    again = rows.join(ids, "id", "left_semi")
    links = components(_links(written(_sets_of(again).join(met, "class"), "sets"), percent))
    roots = links.select(F.col("node").alias("class"), "root").join(classes.select("class", "id"), "class")
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = roots.join(least, "root").select("class", "component_id")
    alone = classes.join(linked, "class", "left").select("class", F.coalesce("component_id", "id").alias("component_id"))
    out = signs
    if _repeats(signs):
        out = signs.filter("id IS NOT NULL").dropDuplicates(["id", "class"]).unionByName(signs.filter("id IS NULL"))
    out = out.join(alone, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    kept = F.coalesce(component == F.col("id"), F.lit(True))
    return out.select("id", "class", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _repeats(signs: DataFrame) -> bool:
    return not signs.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty()


def _sets_of(docs: DataFrame) -> DataFrame:
    """(class, set) of the texts, once per class."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, TEXT_BYTES):
            sets = shingle_sets(*_texts(batch, 1))
            own = [sets.of(i) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class_of(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], names=["class", "set"]
            )

    return docs.select("id", "text").mapInArrow(collect, "class binary, set binary").dropDuplicates(["class"])


def _classes_of(docs: DataFrame) -> DataFrame:
    """(id, mark, class) of texts with words; the mark is the text's MD5."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, TEXT_BYTES):
            sets = shingle_sets(*_texts(batch, 2))
            classes = [_class_of(x) if len(x) else None for x in map(sets.of, range(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.binary())], names=["id", "mark", "class"])

    schema = T.StructType([docs.schema["id"], T.StructField("mark", T.StringType()), T.StructField("class", T.BinaryType())])
    return docs.select("id", F.md5("text"), "text").mapInArrow(name, schema).filter(F.col("class").isNotNull())


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the near-duplicates they hang together with."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = STAGE_PERCENT) -> DataFrame:
    """The documents that are kept, with all their columns. Of repeated rows one stays."""
    found = written(_judged(docs, id_column, text, percent), "near-duplicates")
    gone = found.filter(~F.col("kept")).select("id", "class").distinct()
    ids = gone.select("id").distinct()
    # Of an id with several texts, some may stay.
    partly = written(found.filter("kept").select("id").join(sent_if_few(ids), "id", "left_semi").distinct(), "partly-kept")
    if partly.isEmpty():
        stay = docs.join(sent_if_few(ids.withColumnRenamed("id", id_column)), id_column, "left_anti")
    else:
        whole = ids.join(partly, "id", "left_anti").withColumnRenamed("id", id_column)
        rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text"))
        texts = _classes_of(rows.join(sent_if_few(partly), "id", "left_semi")).join(gone, ["id", "class"]).select("id", "mark").distinct()
        texts = written(texts, "gone-texts")
        stay = docs.join(sent_if_few(whole), id_column, "left_anti")
        stay = stay.join(texts, (stay[id_column] == texts["id"]) & (F.md5(text_or_empty(stay[text])) == texts["mark"]), "left_anti")
    repeated = stay.groupBy(id_column).count().filter("count > 1").select(id_column)
    if repeated.isEmpty():
        return stay
    repeated = written(repeated, "repeated")
    several = stay.join(repeated, id_column, "left_semi").dropDuplicates([id_column, text])
    return stay.join(repeated, id_column, "left_anti").unionByName(several)


OP7_SQL = f"""
WITH RECURSIVE words AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {SIMILAR_PERCENT} * (a.n + b.n - count(*))),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM sets JOIN least ON id = doc_id
"""
