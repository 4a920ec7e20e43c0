"""Running results over one long sequence, computed chunk by chunk.

A plain window over ``(file, sheet)`` puts a whole sheet into one task. Here every sequence is
cut into chunks that agree with its order. Windows run inside a chunk; one small summary row
per chunk carries the result over. All joins use the sequence key *and* the chunk, so a
sequence that holds most of the data still spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwork.session import settle

CHUNK_ROWS = 100_000
# Rows of a sheet that look up their header together; a block rarely holds more than a few headers.
BLOCK_ROWS = 10_000
BEFORE = (Window.unboundedPreceding, -1)


def chunk_of(position: Column, size: int | None = None) -> Column:
    """Chunk number of a row position inside its sheet or document."""
    return F.floor(position / (size or CHUNK_ROWS))


def block_of(position: Column) -> Column:
    """Block number of a row position inside its sheet."""
    return F.floor(position / BLOCK_ROWS)


def _carried(df: DataFrame, keys: Sequence[str], chunk: Sequence[str], **summaries: Column) -> DataFrame:
    """One row per chunk with its summaries. It is small: rows / CHUNK_ROWS plus sequences."""
    return df.groupBy(*keys, *chunk).agg(*[value.alias(name) for name, value in summaries.items()])


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows dealt by ranges of ``order``, whose bounds Spark samples, with the number of their range in
    ``_range``. Written once, as ranges dealt anew may have other bounds."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))


def total_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, out: str) -> DataFrame:
    """Adds the sum of ``amount`` over all earlier rows of the same keys. Each range is summed on its own and
    one row per range carries the sums on, so no task holds all rows of a key."""
    dealt = ranged(df, [*keys, *order])
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*BEFORE)
    bases = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*BEFORE)
    running = dealt.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    # No more rows than ranges for a key.
    joined = running.join(bases, [*keys, "_range"])
    return joined.withColumn(out, F.col("_base") + F.col("_inside")).drop("_base", "_inside", "_range")


def sequence_number(
    df: DataFrame, keys: Sequence[str], chunk: Sequence[str], order: Sequence[str], out: str, many_chunks: bool = False
) -> DataFrame:
    """1-based position of every row inside ``keys``. ``(chunk, order)`` must sort like the
    sequence itself. Say ``many_chunks`` where a key may have more of them than a task should hold."""
    counts = _carried(df, keys, chunk, _rows=F.count(F.lit(1)))
    if many_chunks:
        offsets = total_before(counts, keys, chunk, "_rows", "_offset").drop("_rows")
    else:
        across = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(*BEFORE)
        offsets = counts.select(*keys, *chunk, F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order)
    return (
        df.join(offsets, [*keys, *chunk])
        .withColumn(out, F.col("_offset") + F.row_number().over(inside))
        .drop("_offset")
    )


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    position: str,
    values: dict[str, Column],
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """For every row the latest non-NULL value of each column on a row before it, as
    ``<name>_before: struct<at, value>`` with the position it comes from. ``totals`` adds running
    sums up to and with the row, in the same pass."""
    totals = totals or {}
    marked = df
    for name, value in values.items():
        marked = marked.withColumn(
            f"_{name}", F.when(value.isNotNull(), F.struct(F.col(position).alias("at"), value.alias("value")))
        )
    for name, amount in totals.items():
        marked = marked.withColumn(f"_{name}", amount.cast("long"))
    lasts = {f"_last_{n}": F.max(f"_{n}") for n in values}
    sums = {f"_sum_{n}": F.sum(f"_{n}") for n in totals}
    summary = _carried(marked, keys, [chunk], **lasts, **sums)
    across = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(*BEFORE)
    carry = summary.select(
        *keys,
        chunk,
        *[F.max(f"_last_{n}").over(across).alias(f"_carry_{n}") for n in values],
        *[F.coalesce(F.sum(f"_sum_{n}").over(across), F.lit(0)).alias(f"_carry_{n}") for n in totals],
    )
    inside = Window.partitionBy(*keys, chunk).orderBy(position)
    before, upto = inside.rowsBetween(*BEFORE), inside.rowsBetween(Window.unboundedPreceding, 0)
    results = {f"{n}_before": F.coalesce(F.max(f"_{n}").over(before), F.col(f"_carry_{n}")) for n in values}
    results |= {n: F.col(f"_carry_{n}") + F.sum(f"_{n}").over(upto) for n in totals}
    joined = marked.join(carry, [*keys, chunk]).withColumns(results)
    return joined.drop(*[c for n in (*values, *totals) for c in (f"_{n}", f"_carry_{n}")])


def next_position(df: DataFrame, keys: Sequence[str], chunk: str, position: str, out: str) -> DataFrame:
    """Position of the following row of the sequence, NULL on the last one."""
    firsts = _carried(df, keys, [chunk], _first=F.min(position))
    across = Window.partitionBy(*keys).orderBy(chunk)
    following = firsts.select(*keys, chunk, F.lead("_first").over(across).alias("_following"))
    inside = Window.partitionBy(*keys, chunk).orderBy(position)
    return (
        df.join(following, [*keys, chunk])
        .withColumn(out, F.coalesce(F.lead(position).over(inside), F.col("_following")))
        .drop("_following")
    )


def part_numbers(
    df: DataFrame, group: str, limit: int, file: str = "file_ord", sheet: str = "sheet_ord", row: str = "row_no"
) -> DataFrame:
    """Output part of every row: at most ``limit`` rows of a group per part, in source order."""
    numbered = sequence_number(
        df.withColumn("_chunk", chunk_of(F.col(row))), [group], [file, sheet, "_chunk"], [row], "_number", many_chunks=True
    )
    part = (F.floor((F.col("_number") - 1) / limit) + 1).cast("int")
    return numbered.withColumn("part", part).drop("_number", "_chunk")
