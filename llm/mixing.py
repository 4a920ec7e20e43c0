"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points run through the cumulative target shares and give each slot of the mix a source;
slots are ranked inside their source and joined with the equal blocks that the shuffled words of the
source are cut into. Nothing is random: points, shuffle (MD5 of the id) and cuts repeat exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from llm.common import ROWS_PER_CHUNK, WORD, key_of, running, table, text_or_empty, written

GOLDEN = 0.6180339887498949
CYCLE = (1, 2, 3)
MOST_TIMES = 3
BLOCK_WORDS = 1024
CELLS = 1024
#: Slots of the schedule whose rows are laid out together.
STRETCH = 1024


@dataclass
class Mix:
    """``sources``: source_key, weight, source_size, target, take (whole words), slots.
    ``rows``: the input with size and place, the words of its source that come before it.
    ``schedule``: slot, source_key, rank."""

    sources: DataFrame
    rows: DataFrame
    schedule: DataFrame


def n_words(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _order(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key_of(id_column)))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_TIMES) -> DataFrame:
    """Targets from one row per source (source, source_key, source_size). Weights repeat in code point
    order, null last. A target above ``most`` times the size stops there and its excess goes to the
    others by weight, until none is above: all targets are least(most * size, level * weight), and
    each round one aggregate raises the level."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(w) for w in cycle])
    place = (F.row_number().over(by_name) - 1) % len(cycle)
    weighted = written(sizes.withColumn("weight", F.get(weights, place).cast("long")), "mix-sources")
    total, weight = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = total / weight if weight else 0.0
    while True:
        full = most * F.col("source_size") <= F.lit(level) * F.col("weight")
        held, held_weight = weighted.agg(
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("weight"))), F.lit(0)),
        ).first()
        if held_weight == weight:
            break
        raised = (total - held) / (weight - held_weight)
        if raised <= level:
            break
        level = raised
    target = F.least(most * F.col("source_size").cast("double"), F.lit(level) * F.col("weight"))
    return weighted.withColumn("target", target)


def _slots(targets: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The schedule (slot, source_key, rank), and the targets with take and slots."""
    spark = targets.sparkSession
    by_name = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    total = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    taking = targets.withColumn("take", F.round("target").cast("long"))
    count = max(1, -(-int(total) // block))
    low = F.coalesce(F.sum("target").over(by_name), F.lit(0.0))
    shares = taking.filter("take > 0").select("source_key", low.alias("low"), "target")
    cells = shares.select(
        "source_key",
        (F.col("low") / total).alias("low") if total else F.col("low"),
        ((F.col("low") + F.col("target")) / total).alias("high") if total else F.col("low").alias("high"),
    )
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))))
    points = spark.range(count).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    hits = points.join(cells, "cell").filter("point >= low and point < high").select("slot", "source_key")
    counted = hits.groupBy("source_key").agg(F.count("*").alias("hits"))
    # A source too small for a slot of its own gets one; no slot is empty.
    taking = taking.join(counted, "source_key", "left").withColumn(
        "slots", F.least(F.greatest(F.coalesce("hits", F.lit(0)), F.lit(1)), F.col("take"))
    )
    taking = written(taking.drop("hits"), "mix-targets")
    lone = taking.join(counted, "source_key", "left_anti").filter("slots > 0")
    lone = lone.select((F.lit(count) + F.row_number().over(Window.orderBy("source_key")) - 1).cast("long").alias("slot"), "source_key")
    every = hits.unionByName(lone).withColumn("chunk", F.floor(F.col("slot") / ROWS_PER_CHUNK))
    ranked = running(every, "source_key", "chunk", [F.col("slot")], {"rank": F.lit(1)})
    kept = ranked.join(taking.select("source_key", "slots"), "source_key").filter("rank < slots")
    return kept.select("slot", "source_key", "rank"), taking


def mix(
    df: DataFrame, size: Column, id_column: str = "doc_id", source: str = "source", block: int = BLOCK_WORDS, seed: int = 0
) -> Mix:
    """Plans the mix of all rows; ``size`` is a row's number of words, e.g. ``n_words("text")``, by
    which a null text holds none. A null source is a source; repeated rows are rows of their own; an
    empty table gives empty results. ``rows`` holds each input row as the struct ``row``, whatever its
    columns are called."""
    df = df.select(F.struct(*df.columns).alias("row"), F.col(id_column).alias("id"), F.col(source).alias("source"), size.cast("long").alias("size"))
    rows = df.count()
    chunks = max(1, -(-rows // ROWS_PER_CHUNK))
    order = _order("id", seed)
    sized = df.withColumns({"source_key": key_of("source"), "order_key": order})
    spot = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("chunk", F.floor(spot * chunks / 2**32).cast("long"))
    sizes = sized.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    schedule, sources = _slots(source_targets(sizes), block)
    by = [F.col("order_key"), F.col("id"), F.col("size")]
    placed = running(sized, "source_key", "chunk", by, {"place": F.col("size"), "row_no": F.lit(1)})
    placed = placed.join(sources.select("source_key", "source_size", "target", "take", "slots"), "source_key")
    return Mix(sources, placed, schedule)


def passes(rows: DataFrame) -> DataFrame:
    """One row per pass over a row that takes words of it: pass, first_word and end_word inside the
    row, at (its first word in the words its source takes)."""
    laps = F.floor((F.col("take") - F.col("place") - 1) / F.col("source_size")).cast("long")
    open_rows = rows.filter("size > 0 and place < take").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), laps)))
    at = F.col("pass") * F.col("source_size") + F.col("place")
    return open_rows.withColumns(
        {"at": at, "first_word": F.lit(0).cast("long"), "end_word": F.least(F.col("size"), F.col("take") - at)}
    )


def pieces(plan: Mix) -> DataFrame:
    """The mix itself: which words of which row stand in which slot of the schedule."""
    base, longer = F.expr("take div slots"), F.expr("take % slots")

    def rank_of(at: Column) -> Column:
        split = longer * (base + 1)
        return F.when(at < split, F.floor(at / (base + 1))).otherwise(longer + F.floor((at - split) / base))

    def first_of(rank: Column) -> Column:
        return rank * base + F.least(rank, longer)

    end = F.col("at") + F.col("end_word")
    cut = passes(plan.rows).withColumn("rank", F.explode(F.sequence(rank_of(F.col("at")), rank_of(end - 1))))
    begin = F.greatest(F.col("at"), first_of(F.col("rank"))) - F.col("at")
    until = F.least(end, first_of(F.col("rank") + 1)) - F.col("at")
    cut = cut.withColumns({"from_word": begin, "until_word": until})
    return cut.join(plan.schedule, ["source_key", "rank"])


def mixed_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", length: str | None = None) -> DataFrame:
    """The rows that the mix takes, each as often as it does, with their columns; of a row that a source
    takes in part, its first words, set apart by blanks, and their length in the column ``length``. What is
    taken of a row are its pieces in the slots of the schedule, and rows are laid out by the slot that
    their first piece stands in, so that sources alternate as the schedule says."""
    plan = mix(docs, n_words(text), id_column, source)
    slots = plan.sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    # A source's words are spread evenly over the schedule, so its share of them tells the stretch.
    stretch = F.floor(F.col("at") * (slots // STRETCH + 1) / F.col("take"))
    by = ["stretch", "source_key", "row_no", "pass"]
    held = F.sum(F.col("until_word") - F.col("from_word")).alias("held")
    scheduled = pieces(plan).withColumn("stretch", stretch).groupBy(*by).agg(held, F.min_by("slot", "from_word").alias("slot"))
    # Rows meet what is taken of them where they are laid out: whole texts are dealt out once.
    rows = passes(plan.rows).withColumn("stretch", stretch).select(*by, "at", "size", "row")
    both = rows.unionByName(scheduled, allowMissingColumns=True).repartition("stretch")
    own = Window.partitionBy(*by)
    taken = both.withColumns({"end_word": F.max("held").over(own), "slot": F.max("slot").over(own)})
    taken = taken.filter("row IS NOT NULL AND end_word IS NOT NULL")
    cut = F.col("end_word") < F.col("size")
    words = F.regexp_extract_all(F.col("row")[text], F.lit(WORD), F.lit(0))
    shorter = F.array_join(F.slice(words, F.lit(1), F.col("end_word").cast("int")), " ")
    taken = taken.withColumns({"cut": cut, "shorter": F.when(cut, shorter)})
    columns = {c: F.col("row")[c] for c in docs.columns}
    columns[text] = F.when(F.col("cut"), F.col("shorter")).otherwise(columns[text])
    if length:
        columns[length] = F.when(F.col("cut"), F.length("shorter")).otherwise(columns[length]).cast(docs.schema[length].dataType)
    laid = taken.sortWithinPartitions("stretch", "slot", "at")
    return laid.select(*[v.alias(c) for c, v in columns.items()])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    narrow = table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("words"))
    plan = mix(written(narrow, "mix-sizes"), F.col("words"))
    taken = pieces(plan).groupBy("source_key", "row_no").agg(F.sum(F.col("until_word") - F.col("from_word")).alias("taken"))
    found = plan.rows.join(taken, ["source_key", "row_no"], "left")
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_WEIGHTS = " + ".join(f"CASE WHEN (row_number() OVER names - 1) % {len(CYCLE)} = {i} THEN {w} ELSE 0 END" for i, w in enumerate(CYCLE))

#: Raising the level round by round ends at the smallest level that hands out all words, and a source
#: is held exactly if the level of all sources held before it or with it reaches it.
OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('0:' || coalesce('v' || doc_id::VARCHAR, 'n')) AS o
  FROM documents),
sources AS (SELECT k, min(source) AS source, sum(size)::DOUBLE AS s FROM sized GROUP BY k),
weighted AS (SELECT *, {_WEIGHTS} AS w FROM sources WINDOW names AS (ORDER BY source IS NULL, source)),
steps AS (
  SELECT *, {MOST_TIMES} * s / w AS r,
         sum({MOST_TIMES} * s) OVER (ORDER BY {MOST_TIMES} * s / w, k) AS held, sum(w) OVER (ORDER BY {MOST_TIMES} * s / w, k) AS held_w,
         sum(s) OVER () AS total, sum(w) OVER () AS all_w
  FROM weighted),
level AS (
  SELECT arg_min(v, r) AS v FROM (
    SELECT (total - coalesce(lag(held) OVER (ORDER BY r, k), 0)) / (all_w - coalesce(lag(held_w) OVER (ORDER BY r, k), 0)) AS v, r FROM steps)
  WHERE v <= r),
targets AS (
  SELECT k, s, least({MOST_TIMES} * s, v * w) AS target, round(least({MOST_TIMES} * s, v * w))::BIGINT AS take FROM weighted, level),
placed AS (
  SELECT sized.*, s, target, take,
         coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
  FROM sized JOIN targets USING (k))
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target,
       (CASE WHEN s = 0 THEN 0
             ELSE (take // s::BIGINT) * size + greatest(0, least(size, take % s::BIGINT - p)) END)::BIGINT AS taken
FROM placed
"""
