"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Call-site capture adds several driver round trips to every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, name: str = "gridwork", memory: str = "20g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a private one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # One machine only: tests and trials. The folder goes when the process ends.
        private = tempfile.mkdtemp(prefix="gridwork-")
        atexit.register(shutil.rmtree, private, ignore_errors=True)
        configured = os.path.join(private, "checkpoints")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write a reused result to the checkpoint folder, so that it is computed once and
    survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same as Parquet, for a wide or repetitive result of as many rows as the input: a fraction of the bytes
    of a checkpoint, and readers take the columns they need."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this job has written for itself and has no more use for."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Results that are stored for a while: the bytes of one that has been used are needed for the next."""

    def __init__(self) -> None:
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        kept = spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = kept, path
        return kept

    def drop(self, *used: DataFrame | None) -> None:
        """Removes results that nothing reads any more."""
        for kept in used:
            if kept is not None and id(kept) in self._paths:
                removed(kept.sparkSession, self._paths.pop(id(kept))[1])

    def drop_but(self, *used: DataFrame | None) -> None:
        """Removes all results but these, and has the driver let go of the shuffles that have ended."""
        still = {id(kept) for kept in used}
        self.drop(*[kept for kept, _ in list(self._paths.values()) if id(kept) not in still])
        SparkSession.active().sparkContext._jvm.System.gc()


BROADCAST_BYTES = 32 << 20


def broadcast_if_small(settled: DataFrame) -> DataFrame:
    """Broadcast a settled table after measuring it, lists and texts included; larger ones are
    shuffled."""
    size = settled.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(settled) if size <= BROADCAST_BYTES else settled


def computed_once(value: Column) -> Column:
    """Keeps the optimizer from copying a costly expression into every filter and projection above
    it. The condition always holds; it only makes the column not foldable into others."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
