"""Helpers shared by the operators: tables, settled intermediate results, ordered running sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridwork.session import checkpoint_dir

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

ROWS_PER_CHUNK = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result that is read more than once into the shared checkpoint folder
    and read it from there: it is computed once, compressed, and survives lost executors."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same with its folder, for a result that is removed when it has been used."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BYTES, TEXT_BATCH = "67108864b", "4m"


def bounded_batches() -> None:
    """Texts reach Python in batches of a few MB, as they may be long: the session's limit in bytes is
    lowered, unless it was set by hand."""
    conf = SparkSession.active().conf
    if conf.get(BATCH_BYTES) == DEFAULT_BYTES:
        conf.set(BATCH_BYTES, TEXT_BATCH)


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(column: str) -> Column:
    """A join key that also holds null."""
    return F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit("n"))


def small_batches(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``most_bytes`` together; one text is never cut."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def running(df: DataFrame, key: str, chunk: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each of ``sums``, its total over all earlier rows of the key. ``chunk`` numbers
    consecutive stretches of the order, so that a key with most rows still spreads over all tasks:
    one window runs inside chunks, another over one row per chunk."""
    within = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = df.groupBy(key, chunk).agg(*[F.sum(v).cast("long").alias(f"{n}_chunk") for n, v in sums.items()])
    totals = totals.select(key, chunk, *[F.coalesce(F.sum(f"{n}_chunk").over(before), zero).alias(f"{n}_base") for n in sums])
    inside = df.withColumns({n: F.coalesce(F.sum(v).over(within), zero).cast("long") for n, v in sums.items()})
    joined = inside.join(totals, [key, chunk])
    return joined.withColumns({n: F.col(n) + F.col(f"{n}_base") for n in sums}).drop(*[f"{n}_base" for n in sums])


def grouped(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The groups of rows that share a key, from batches in which they stand together."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        change = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)), True)
        cuts = [0, *(pc.indices_nonzero(change).to_numpy() + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            value = keys[low].as_py()
            if held and value != now:
                yield pa.Table.from_batches(held)
                held = []
            now = value
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows out by key, so that the rows of a key stand together in one partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


#: Ids up to this many are sent to all tasks (16 bytes each or so); more are joined by a shuffle.
MOST_IDS_SENT = 2_000_000


def sent_if_few(ids: DataFrame) -> DataFrame:
    """Marks a table of single ids for broadcast after counting it."""
    return F.broadcast(ids) if ids.limit(MOST_IDS_SENT + 1).count() <= MOST_IDS_SENT else ids
