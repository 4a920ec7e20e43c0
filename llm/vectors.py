"""Vectors that can be compared, and classes of equal ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from llm.common import written


def element_type(df: DataFrame, vector: str) -> str:
    """The numpy type in which vectors are carried: as exact as the column."""
    kind = df.schema[vector].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def comparable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vector as bytes) of the rows that take part: those with an id and a vector that is not null,
    empty or zero, holds no null, NaN or infinity and has the length of most vectors (of lengths equally
    frequent the smallest). Repeated rows come once; +0 and -0 are the same."""
    kind = element_type(df, vector)
    rows = df.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("vector", T.BinaryType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.float32() if kind == "<f4" else pa.float64()).to_numpy(zero_copy_only=False)
            values = flat.astype(kind).reshape(batch.num_rows, -1) + np.dtype(kind).type(0)
            # A null has become NaN.
            good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
            kept = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), pa.array([values[i].tobytes() for i in kept], pa.binary())], names=["id", "vector"]
            )

    if usual is None:
        return df.sparkSession.createDataFrame([], schema)
    return rows.filter(F.size("v") == usual["n"]).mapInArrow(convert, schema)


def matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """The vectors in double precision."""
    return np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and always in the same order of sums."""
    dots = np.einsum("ij,ij->i", a, b)
    return dots / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def sample_rows(classes: DataFrame, size: int) -> list[bytes]:
    """Vectors of the classes with the smallest hashes, no more than ``size``."""
    rows = classes.select("rep", "vector").orderBy(F.xxhash64("rep", "vector"), "rep").limit(size)
    return rows.toPandas()["vector"].tolist()


def smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """(rep, vector, members): equal vectors as one class, with its smallest ids in order, ``most`` at
    the utmost, and the very smallest as its name. Each task first keeps that many of what it reads, so
    that a vector that most rows share doesn't meet in one place."""
    schema = rows.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("vector", "ascending"), ("id", "ascending")])
            vectors = table.column("vector").to_pylist()
            picked, run = [], 0
            for i, vector in enumerate(vectors):
                run = run + 1 if i and vector == vectors[i - 1] else 0
                if run < most:
                    picked.append(i)
            yield from table.take(pa.array(picked, pa.int64())).combine_chunks().to_batches()

    few = rows.select("id", "vector").mapInArrow(keep, T.StructType([schema["id"], schema["vector"]])).distinct()
    # Two rounds of groups: no more ids than tasks times ``most`` meet for a vector.
    least = F.slice(F.sort_array(F.collect_list("id")), 1, most)
    salted = few.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(least.alias("ids"))
    every = salted.groupBy("vector").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, most).alias("members"))
    return written(every.select(F.col("members")[0].alias("rep"), "vector", "members"), "classes")
