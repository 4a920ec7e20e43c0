"""Benchmark decontamination by one Aho-Corasick automaton over the windows of all test items.

Items and documents are normalised alike: A-Z become small, whatever is no word becomes one blank. Each
window of an item's words is a pattern with a blank at both ends, so it only matches whole words. A task
builds the automaton once, runs it once over a few MB of normalised texts at a time, and maps the places it
reports back to words and to characters of the original text. Nothing is shuffled but the test items.

The automaton is held by every task, so the patterns are measured first. Beyond ``PATTERN_BYTES`` they are
dealt into parts of that size, and the texts pass the parts one after the other; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from llm.common import ascii_lower, bounded_batches, small_batches, table, text_or_empty, written

#: Words in a window. An item of fewer is one window.
WINDOW = 10
#: Patterns in one automaton; its nodes take about 50 times as much.
PATTERN_BYTES = 4 << 20
#: What separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
#: Digits, small letters, and all bytes of characters beyond ASCII, once A-Z have become small.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("first_word", "until_word", "start", "end")]))),
        T.StructField("patterns", T.ArrayType(T.LongType())),
    ]
)


class Words:
    """The words of texts that stand one behind the other: where they begin and end in the bytes, to which
    text they belong, and the normalised texts, each a line of its own that begins and ends with a blank."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.text_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = _SMALL[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
        word = _WORD[data]
        first, after = word.copy(), ~word
        first[1:] &= ~word[:-1]
        after[1:] &= word[:-1]
        after[:1] = False
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(after)
        self.bounds = np.searchsorted(self.start, self.text_start)
        # One blank after each word; two bytes before each text, a line break and a blank.
        lengths = self.end - self.start + 1
        kept = data.copy()
        kept[self.end] = 32
        kept = kept[word | after]
        head = np.repeat(np.concatenate([[0], np.cumsum(lengths)])[self.bounds[:-1]], 2)
        self.line = np.insert(kept, head, np.tile(np.frombuffer(b"\n ", dtype=np.uint8), len(texts)))
        text = np.searchsorted(self.bounds, np.arange(len(self.start)), side="right")
        #: Where each word begins in the normalised texts.
        self.at = np.cumsum(lengths) - lengths + 2 * text
        # Characters before each byte: those that are no continuation of one.
        self._letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    def normalised(self) -> str:
        """One character a byte, as the automaton reads it."""
        return self.line.tobytes().decode("latin-1")

    def characters(self, at: np.ndarray, text: int) -> np.ndarray:
        """Byte places as characters of their text."""
        return self._letters[at] - self._letters[self.text_start[text]]


def windows(items: DataFrame, id_column: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct rows (pattern, id) of all items: each window of ``width`` consecutive words, or all words of an
    item that has fewer. Null texts have no words; ids may be null and repeat, and so may whole rows."""
    words = F.array_remove(F.split(ascii_lower(text_or_empty(text)), SEPARATOR), "")
    cut = items.select(F.col(id_column).alias("id"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    every = cut.select("id", "words", F.explode(starts).alias("at"))
    joined = F.concat(F.lit(" "), F.array_join(F.slice("words", F.col("at"), F.lit(width)), " "), F.lit(" "))
    return every.select(joined.alias("pattern"), "id").distinct()


def _scanned(docs: DataFrame, patterns, text: str) -> DataFrame:
    """Adds to ``found``, a struct like HITS, what one automaton finds in each row's text."""
    held = {}
    schema = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "automaton" not in held:
            automaton = ahocorasick.Automaton()
            for number, pattern in patterns.value:
                automaton.add_word(pattern.decode("latin-1"), (number, pattern.count(b" ") - 1))
            automaton.make_automaton()
            held["automaton"] = automaton
        automaton = held["automaton"]
        column = schema.names.index(text)
        for batch in small_batches(batches, column):
            texts = [(x.as_py() or "").encode() for x in batch.column(column)]
            yield _with_hits(batch, Words(texts), automaton, schema.names.index("found"))

    return docs.mapInArrow(scan, schema)


def _with_hits(batch: pa.RecordBatch, words: Words, automaton: ahocorasick.Automaton, column: int) -> pa.RecordBatch:
    # An automaton without patterns can't be run.
    hits = [(end, *value) for end, value in automaton.iter(words.normalised())] if len(automaton) else []
    end, number, count = np.array(hits, dtype=np.int64).reshape(-1, 3).T
    # A pattern ends with the blank before the next word.
    last = np.searchsorted(words.at, end, side="right") - 1
    owner = np.searchsorted(words.bounds, last, side="right") - 1
    order = np.argsort(owner, kind="stable")
    low = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
    rows = []
    for i, before in enumerate(batch.column(column).to_pylist()):
        mine = order[low[i] : low[i + 1]]
        base = words.bounds[i]
        first, until = last[mine] - count[mine] + 1 - base, last[mine] + 1 - base
        spans = [(x["first_word"], x["until_word"]) for x in before["spans"]] if before else []
        old = np.array(spans, dtype=np.int64).reshape(-1, 2)
        first, until = _merged(np.concatenate([first, old[:, 0]]), np.concatenate([until, old[:, 1]]))
        starts, ends = words.characters(words.start[first + base], i), words.characters(words.end[until + base - 1], i)
        keys = ("first_word", "until_word", "start", "end")
        merged = [dict(zip(keys, map(int, x), strict=True)) for x in zip(first, until, starts, ends, strict=True)]
        known = before["patterns"] if before else []
        found = np.unique(np.concatenate([number[mine], np.array(known, dtype=np.int64)])).tolist()
        rows.append({"n_words": int(words.bounds[i + 1] - base), "spans": merged, "patterns": found})
    columns = list(batch.columns)
    columns[column] = pa.array(rows, batch.schema.field(column).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _merged(first: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of words that touch or overlap as one, in order."""
    if not len(first):
        return first.astype(np.int64), until.astype(np.int64)
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(until[order])
    begins = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[begins], reach[np.concatenate([begins[1:], [True]])]


def scan(
    docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text: str = "text", width: int = WINDOW, part_bytes: int = PATTERN_BYTES
) -> DataFrame:
    """Adds a struct ``leaks`` to every row of ``docs`` (an input column of that name gives way): n_words; spans,
    the hit stretches of the text as words [first_word, until_word) and characters [start, end), which neither
    touch nor overlap; n_hit, the words in them; items, the ids of items with windows in the text, sorted as
    strings. Null texts have no words. Repeated rows are judged alike, and rows and texts stay whole. Windows of
    an item without an id count as hits, but there is no id to report. No items, or none with words: no hits."""
    bounded_batches()
    spark = docs.sparkSession
    pairs = written(windows(items, item_id, item_text, width), "windows")
    size = F.coalesce(F.sum(F.octet_length("pattern") + 16), F.lit(0)).alias("size")
    distinct = pairs.select("pattern").distinct()
    parts = max(1, -(-distinct.agg(size).first()["size"] // part_bytes))
    numbered = written(distinct.select("pattern", F.monotonically_increasing_id().alias("number"), F.pmod(F.xxhash64("pattern"), F.lit(parts)).alias("part")), "patterns")
    own = [c for c in docs.columns if c.lower() != "leaks"]
    found = docs.select(F.struct(*docs.columns).alias("row"), text_or_empty(text).alias("text"), F.lit(None).cast(HITS).alias("found"))
    for part in range(parts):
        # No more than about ``part_bytes``, however many items there are.
        mine = [(r.number, r.pattern.encode()) for r in numbered.filter(F.col("part") == part).select("number", "pattern").toLocalIterator()]
        found = _scanned(found, spark.sparkContext.broadcast(mine), "text")
        if part < parts - 1:
            found = written(found, "scanned")
    named = _item_names(found if parts == 1 else written(found, "scanned"), pairs.join(numbered, "pattern").select("number", "id"))
    hit = F.aggregate("found.spans", F.expr("0L"), lambda n, s: n + s["until_word"] - s["first_word"])
    leaks = F.struct("found.n_words", "found.spans", hit.alias("n_hit"), F.col("items"))
    return named.select(*[F.col("row")[c].alias(c) for c in own], leaks.alias("leaks"))


#: Up to so many bytes of (pattern, item) pairs are looked up in each task; more are joined.
PAIR_BYTES = 32 << 20


def _item_names(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``items``: the distinct ids behind the patterns of each row, sorted as strings. A document meets
    few items, but an item's window may stand in a third of all documents: the item side is sent to all
    tasks where it is small, and else the patterns of rows are joined, their keys being salted by row."""
    pairs = written(pairs.filter("id IS NOT NULL").select("number", F.col("id").cast("string").alias("id")), "pattern-items")
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("id") + 16), F.lit(0)).alias("size")).first()["size"]
    if size <= PAIR_BYTES:
        names: dict[int, list[str]] = {}
        for r in pairs.toLocalIterator():
            names.setdefault(r.number, []).append(r.id)
        sent = found.sparkSession.sparkContext.broadcast(names)

        @F.pandas_udf("array<string>")
        def looked_up(patterns: pd.Series) -> pd.Series:
            return patterns.map(lambda numbers: sorted({x for n in numbers for x in sent.value.get(n, ())}))

        return found.withColumn("items", looked_up("found.patterns"))
    rows = written(found.withColumn("row_id", F.monotonically_increasing_id()), "scanned")
    asked = rows.select("row_id", F.explode("found.patterns").alias("number")).join(pairs, "number")
    items = asked.groupBy("row_id").agg(F.sort_array(F.collect_set("id")).alias("items"))
    return rows.join(items, "row_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).drop("row_id")


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the hit stretches cut out of their texts; other columns and texts stay as they are."""
    scanned = scan(docs, items, text=text)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for value, cuts in zip(texts, spans, strict=True):
            ends = [0, *(s["end"] for s in cuts)]
            starts = [*(s["start"] for s in cuts), None]
            out.append("".join(value[a:b] for a, b in zip(ends, starts, strict=True)))
        return pd.Series(out, dtype=object)

    changed = F.when(F.size("leaks.spans") > 0, cut(text_or_empty(text), F.col("leaks.spans"))).otherwise(F.col(text))
    return scanned.withColumn(text, changed).drop("leaks")


def op13_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that stand in windows of benchmark items, and which items these are."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = out.select("doc_id", "leaks.n_words", "leaks.n_hit", "leaks.items")
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: Ids of items are integers in the given table; sorted as strings.
OP13_SQL = f"""
WITH lowered AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM patterns),
places AS (
  SELECT row_no, size, i, array_to_string(w[i:i + size - 1], ' ') AS p
  FROM (SELECT row_no, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lowered, sizes WHERE len(w) >= size)),
hits AS (SELECT row_no, size, i, item_id FROM places JOIN patterns USING (size, p)),
words AS (SELECT row_no, count(DISTINCT place) AS n FROM (SELECT row_no, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT row_no, size, i FROM hits)) GROUP BY row_no),
named AS (
  SELECT row_no, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(named.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM lowered LEFT JOIN words USING (row_no) LEFT JOIN named USING (row_no)
"""
