"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once and as a whole, since tokens of parts differ from those of the whole. The
character spans of its tokens are joined with the spans of its sections as intervals, and a token that
crosses a boundary goes where an explicit rule says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from llm.bpe import byte_bpe, vocabulary_files
from llm.common import bounded_batches, small_batches, table, text_or_empty

#: first: the section that holds a token's first character; last: its last one; share: each section gets
#: the part of the token's characters that it holds.
RULES = ("first", "last", "share")


def token_spans(lengths: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of each token, from the tokens' lengths in bytes. A token that
    begins or ends inside a character spans all of it."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if text.isascii():
        return starts, ends
    seen = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    return seen[starts] - 1, seen[ends - 1]


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feeds; a text that ends in one, or is empty, has an empty last line."""
    lengths = np.array([len(x) + 1 for x in text.split("\n")], dtype=np.int64)
    lengths[-1] -= 1
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def count_in(first: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens [first, end) with sections [low, high): tokens by the rule, and how many
    tokens lie only partly inside. Both sides of each token rise, so each end of a section is one binary
    search; sections may overlap, then each counts for itself."""
    high = np.maximum(low, high)
    touching = np.maximum(np.searchsorted(first, high, "left") - np.searchsorted(end, low, "right"), 0)
    whole = np.maximum(np.searchsorted(end, high, "right") - np.searchsorted(first, low, "left"), 0)
    crossing = np.where(high > low, touching - whole, 0)
    if rule == "first":
        counts = np.searchsorted(first, high, "left") - np.searchsorted(first, low, "left")
    elif rule == "last":
        counts = np.searchsorted(end, high, "right") - np.searchsorted(end, low, "right")
    elif rule == "share":
        if not len(first):
            return np.zeros(len(low)), crossing
        # Characters weigh what their token gives each; tokens may share a character that they split.
        weight = np.zeros(int(end[-1]) + 1)
        np.add.at(weight, first, 1 / (end - first))
        np.add.at(weight, end, -1 / (end - first))
        upto = np.concatenate([[0.0], np.cumsum(np.cumsum(weight))])
        most = len(upto) - 1
        counts = upto[np.minimum(high, most)] - upto[np.minimum(low, most)]
    else:
        raise ValueError(f"rule must be one of {RULES}")
    return counts.astype(np.float64), crossing


def attribute_tokens(
    docs: DataFrame,
    sections: DataFrame | None = None,
    rule: str = "first",
    id_column: str = "doc_id",
    text: str = "text",
    files: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows (id, section, start, end, n_tokens, n_crossing, doc_tokens) of every section of every document.

    ``sections`` has the columns id, section, start and end (characters, end exclusive); null bounds mean
    the text's own. Without it, sections are lines, numbered from 0. A null text is empty; an empty text
    has one empty line; a document without sections gives no row; repeated rows are counted each; ids may
    be null, and sections of a null id belong to no document. Other columns play no part."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded_batches()
    files = files or vocabulary_files()
    kind = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("body"))
    if sections is not None:
        spans = sections.select(F.col(id_column).alias("id"), F.col("section").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"))
        spans = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("section", "start", "end"))).alias("spans"))
        rows = rows.join(spans, "id")
    else:
        rows = rows.withColumn("spans", F.lit(None).cast("array<struct<section:long,start:long,end:long>>"))
    fields = [T.StructField(id_column, kind), T.StructField("section", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    fields += [T.StructField("n_tokens", T.DoubleType() if rule == "share" else T.LongType())]
    fields += [T.StructField("n_crossing", T.LongType()), T.StructField("doc_tokens", T.LongType())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*files)
        for batch in small_batches(batches, 1):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            repeats = []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = body.encode()
                lengths = bpe.lengths[bpe.encode(body)]
                first, end = token_spans(lengths, raw) if len(lengths) else (lengths, lengths)
                if spans is None:
                    low, high = line_spans(body)
                    numbers = np.arange(len(low))
                else:
                    size = len(body)
                    numbers = np.array([x["section"] for x in spans], dtype=np.float64)
                    low = np.array([0 if x["start"] is None else min(max(x["start"], 0), size) for x in spans], dtype=np.int64)
                    high = np.array([size if x["end"] is None else min(max(x["end"], 0), size) for x in spans], dtype=np.int64)
                counts, crossing = count_in(first, end, low, high, rule)
                for column, values in zip(out, (numbers, low, high, counts, crossing, np.full(len(low), len(lengths))), strict=True):
                    column.append(values)
                repeats.append(len(low))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), repeats)))
            joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
            arrays = [ids, pa.array(joined[0], mask=np.isnan(joined[0].astype(float))).cast(pa.int64())]
            arrays += [pa.array(joined[i]).cast(pa.int64()) for i in (1, 2)]
            arrays.append(pa.array(joined[3]) if rule == "share" else pa.array(joined[3]).cast(pa.int64()))
            arrays += [pa.array(joined[i]).cast(pa.int64()) for i in (4, 5)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return rows.mapInArrow(count, T.StructType(fields))


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token belongs to the line of its first character."""
    return attribute_tokens(table(spark, sf_dir, "documents"))
