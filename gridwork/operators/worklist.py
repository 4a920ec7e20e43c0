"""Conversion worklists: which listed files to convert to which target path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwork.functions.paths import AUDIO_FORMATS, VIDEO_FORMATS, file_name, media_class, with_suffix
from gridwork.operators.ordered import total_before


def known_format(text: str) -> str:
    """A format argument in plain form; unknown ones are refused."""
    plain = text.lower().lstrip(".")
    if plain not in (*AUDIO_FORMATS, *VIDEO_FORMATS):
        raise ValueError(f"unknown format: {text!r}")
    return plain


def listed_media(listing: DataFrame, source: str, recursive: bool = False) -> DataFrame:
    """Paths (relative to the folder) that end in the format, as written; top folder only unless
    ``recursive``."""
    suffix = "." + known_format(source)
    keep = F.col("path").endswith(suffix)
    if not recursive:
        keep = keep & ~F.contains("path", F.lit("/"))
    return listing.where(keep)


def sorted_paths(files: DataFrame, key: str) -> DataFrame:
    """Adds ``place``, the position of each path among those with the same key, in the order of paths. Paths are
    dealt by ranges, so no task holds all of a key."""
    one = files.withColumn("_one", F.lit(1))
    return total_before(one, [key], ["path"], "_one", "_before").withColumn("place", F.col("_before") + 1).drop("_one", "_before")


def conversion_worklist(
    listing: DataFrame,
    existing: DataFrame,
    source: str,
    target: str,
    recursive: bool = False,
    overwrite: bool = False,
    delete_source: bool = False,
) -> DataFrame:
    """``path, target_path, action, delete_source`` for every listed file of the source format.

    ``existing(path)`` names the files already there. Both sides are joined on unique paths.
    """
    suffix = known_format(target)
    files = listed_media(listing, source, recursive)
    planned = files.select("path", with_suffix(F.col("path"), F.lit(suffix)).alias("target_path"))
    present = existing.select(F.col("path").alias("target_path")).distinct().withColumn("present", F.lit(True))
    planned = planned.join(present, "target_path", "left")
    skip = F.coalesce(F.col("present"), F.lit(False)) & F.lit(not overwrite)
    action = F.when(skip, "skip").otherwise("convert")
    return planned.select(
        "path",
        "target_path",
        file_name(F.col("path")).alias("name"),
        media_class(F.lit(suffix)).alias("media"),
        action.alias("action"),
        ((action == "convert") & F.lit(delete_source)).alias("delete_source"),
    )


def pending(listing: DataFrame, existing: DataFrame, key: str = "target_path") -> DataFrame:
    """Listed rows whose target does not exist yet."""
    return listing.join(existing.select(key), key, "left_anti")


def finished(listing: DataFrame, existing: DataFrame, key: str = "target_path") -> DataFrame:
    """Listed rows whose target exists."""
    return listing.join(existing.select(key), key, "left_semi")


def outcome_counts(results: DataFrame, ok: str = "ok") -> DataFrame:
    """Successes out of all attempts."""
    return results.agg(
        F.coalesce(F.sum(F.col(ok).cast("long")), F.lit(0)).alias("succeeded"), F.count(F.lit(1)).alias("total")
    )
