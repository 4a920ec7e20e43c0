"""Listing of a folder tree by tasks: every task walks some of the folders, and names that begin with a dot or an
underscore, which Spark's file index leaves out, are seen too."""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridwork.sources.listing import list_files

#: Folders are opened level by level on the driver until there are so many to walk; so many entries of them are
#: read there at the utmost.
WANTED_FOLDERS, MOST_OPENED = 256, 4_096
EPOCH = datetime.datetime.fromtimestamp(0, datetime.UTC)


@dataclass
class Walk(InputPartition):
    """Folders to walk to the end, and files found on the way to them."""

    folders: Sequence[str]
    files: Sequence[tuple[str, int, datetime.datetime]]


def _entries(system: fs.FileSystem, folder: str, deep: bool) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(folder, recursive=deep, allow_not_found=False))


def _row(info: fs.FileInfo) -> tuple[str, int, datetime.datetime]:
    return info.path, info.size or 0, info.mtime or EPOCH


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> Sequence[InputPartition]:
        """A folder each for the tasks; the driver opens no more than a few levels."""
        system, base = fs.FileSystem.from_uri(self.root)
        open_, files, opened = [base], [], 0
        while open_ and len(open_) < WANTED_FOLDERS and opened < MOST_OPENED:
            below = []
            for folder in open_:
                if opened >= MOST_OPENED:
                    below.append(folder)
                    continue
                opened += 1
                for info in _entries(system, folder, deep=False):
                    if info.type == fs.FileType.Directory:
                        below.append(info.path)
                    elif info.type == fs.FileType.File:
                        files.append(_row(info))
            open_ = below
        return [*(Walk([folder], []) for folder in open_), *([Walk([], files)] if files or not open_ else [])]

    def read(self, partition: Walk) -> Iterator[tuple]:
        system, base = fs.FileSystem.from_uri(self.root)
        cut = len(base.rstrip("/")) + 1
        rest = list(partition.folders)
        for path, size, changed in partition.files:
            yield path[cut:], size, changed
        # One folder's entries at a time, however large the tree is.
        while rest:
            for info in _entries(system, rest.pop(), deep=False):
                if info.type == fs.FileType.Directory:
                    rest.append(info.path)
                elif info.type == fs.FileType.File:
                    path, size, changed = _row(info)
                    yield path[cut:], size, changed


class TreeSource(DataSource):
    """``spark.read.format("gridwork_tree").load(root)``: path, length, modified of all files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "gridwork_tree"

    def schema(self) -> str:
        return "path string, length long, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"])


def list_tree(spark: SparkSession, root: str, include_hidden: bool = True) -> DataFrame:
    """``path, length, modified`` of all files below a folder, hidden ones too unless left out; contents are
    never read. Tasks do the listing. A store that only Spark can open is listed by Spark's file index, which
    has no hidden files; asking for them there fails."""
    try:
        fs.FileSystem.from_uri(_uri(root))
    except (OSError, ValueError):
        if include_hidden:
            raise
        return list_files(spark, root)
    spark.dataSource.register(TreeSource)
    found = spark.read.format("gridwork_tree").load(_uri(root))
    return found if include_hidden else found.where(~F.col("path").rlike(r"(^|/)[._]"))


def _uri(root: str) -> str:
    """A plain path or one with a scheme, as both sides understand it."""
    if root.startswith("file:"):
        return "file:///" + root.removeprefix("file:").lstrip("/")
    return root if "://" in root else "file://" + root
