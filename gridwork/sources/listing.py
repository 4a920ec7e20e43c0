"""File listings and the rules that pick source files out of them.

The rules work on any DataFrame with a ``path`` column relative to the source folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwork.config import JobConfig
from gridwork.functions.paths import file_name, glob_pattern, name_parts

# Name of the marker an output folder carries.
MARKER = "gridwork-output.marker"
SEPARATOR = "\x01"


def list_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """``path, length, modified`` of all files below a folder; contents are never read. Spark's
    file index does not show names that begin with a dot or an underscore, nor empty files; see
    ``tree.list_tree``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return listed.withColumn("path", relative_path(spark, root, F.col("path")))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark writes it, with its file system and without a slash at its end."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")


def relative_path(spark: SparkSession, root: str, path: Column) -> Column:
    """What follows the root, which is taken off once and at the front, however often its name
    comes again below it."""
    base = qualified(spark, root)
    bare = base.split(":", 1)[-1].lstrip("/")
    # File systems differ in the slashes behind their name: file:/x and file:///x are one place.
    rest = F.regexp_replace(path, "^[a-z0-9+.-]+:/*", "")
    return F.substring(rest, F.lit(len(bare) + 2), F.length(rest))


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of all files below a folder; unreadable files are skipped, see
    ``unread_files``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = reader.option("ignoreCorruptFiles", "true").load(root)
    return listed.select(relative_path(spark, root, F.col("path")).alias("path"), "content")


def unread_files(listing: DataFrame, read: DataFrame) -> DataFrame:
    """Failures of the files that were listed but could not be read."""
    return file_failures(listing.join(read.select("path"), "path", "left_anti"), F.lit("file could not be read"))


def file_failures(files: DataFrame, detail: Column) -> DataFrame:
    """``group, file, sheet, row_no, detail`` for files that give no rows."""
    group = F.col("group") if "group" in files.columns else F.lit(None).cast("string")
    nowhere = F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("long").alias("row_no")
    return files.select(group.alias("group"), F.col("path").alias("file"), *nowhere, detail.alias("detail"))


def folders(path: Column) -> Column:
    """The folder names of a path."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(name_parts(file_name(path))["suffix"]).isin([e.lower() for e in extensions])


def visible_files(listing: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Without files and folders whose name begins with a dot, unless asked for."""
    return listing if include_hidden else listing.where(~F.col("path").rlike(r"(^|/)\."))


def acceptable(listing: DataFrame, cfg: JobConfig) -> DataFrame:
    """Files with a wanted extension, outside excluded folders and not excluded by name."""
    excluded = [F.lit(d) for d in cfg.exclude_dirs]
    keep = has_extension(F.col("path"), cfg.extensions)
    if excluded:
        keep = keep & ~F.arrays_overlap(folders(F.col("path")), F.array(*excluded))
    for pattern in cfg.exclude_files:
        keep = keep & ~F.lower(file_name(F.col("path"))).rlike(glob_pattern(pattern.casefold()))
    return listing.where(keep)


def own_outputs(listing: DataFrame) -> DataFrame:
    """Folders that hold an earlier output, read off their markers."""
    marked = listing.where(F.col("path").rlike(rf"(^|/){MARKER}(/|$)"))
    return marked.select(F.regexp_extract("path", rf"^(.*?)/?{MARKER}", 1).alias("folder")).distinct()


def skip_own_outputs(listing: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listing without files of earlier outputs, and the skipped files. Every file is matched by
    the folders above it, so the join is an equi join."""
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    prefixes = listing.select("path", F.explode(above).alias("folder"))
    inside = prefixes.join(outputs, "folder", "left_semi").select("path").distinct()
    return listing.join(inside, "path", "left_anti"), listing.join(inside, "path", "left_semi")


def folder_order(path: Column) -> Column:
    """Sorts like a walk through the folders: files of a folder first, then its subfolders."""
    parts = F.split(F.lower(path), "/")
    tagged = F.transform(
        parts, lambda part, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), part)
    )
    return F.array_join(tagged, SEPARATOR)


def assign_groups(listing: DataFrame, cfg: JobConfig) -> tuple[DataFrame, DataFrame]:
    """``path, group, file_ord`` per source file, and the root files left out.

    By subfolder, the group is the first folder. Files at the root form a group of their own, its
    name made unique with ``_``, or are left out. By sheet name, files have no group yet.
    """
    if cfg.group_mode == "sheet_name":
        everything = listing.withColumn("group", F.lit(None).cast("string"))
        return everything.withColumn("file_ord", F.lower("path")), everything.where(F.lit(False))
    first = F.regexp_extract("path", "^([^/]+)/", 1)
    at_root = first == ""
    inside = listing.where(~at_root).withColumn("group", first)
    roots = listing.where(at_root)
    if not cfg.include_root_files:
        return inside.withColumn("file_ord", folder_order(F.col("path"))), roots
    # Groups called like the root group with underscores behind it; the shortest free name is taken.
    begin = cfg.root_group.lower()
    name = F.lower("group")
    only_marks = F.rtrim(F.substring(name, F.lit(len(begin) + 1), F.length(name)), F.lit("_")) == ""
    alike = inside.select(name.alias("name")).where(F.startswith("name", F.lit(begin)) & only_marks)
    taken = alike.agg(F.collect_set(F.length("name")).alias("taken"))
    size = len(cfg.root_group)
    free = F.array_except(F.sequence(F.lit(size), F.lit(size) + F.size("taken")), F.col("taken"))
    name = taken.select(F.rpad(F.lit(cfg.root_group), F.array_min(free), "_"))
    named = roots.withColumn("group", name.scalar())
    return inside.unionByName(named.select(*inside.columns)).withColumn("file_ord", folder_order(F.col("path"))), roots.where(F.lit(False))


def listed_groups(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``group, files_found``; ``names(group)`` adds groups without files."""
    found = files.groupBy("group").agg(F.count(F.lit(1)).alias("files_found"))
    if names is None:
        return found
    return names.select("group").distinct().join(found, "group", "full").fillna(0, ["files_found"])


def read_texts(files: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """``group, file, file_ord, text`` of listed text files, one row per file. A listed file that
    can't be read has the text NULL."""
    texts = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(root, wholetext=True)
    # Names are percent-encoded there; a plus sign stands for itself.
    name = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    named = texts.select(relative_path(spark, root, name).alias("path"), F.col("value").alias("text"))
    return files.join(named, "path", "left").select("group", F.col("path").alias("file"), "file_ord", "text")
