"""File names and paths."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, functions as F

# Suffixes of two parts that stay together.
COMPOUND_SUFFIXES = (".tar.gz", ".tar.bz2", ".tar.xz", ".nii.gz", ".backup.sql")
# Media formats.
AUDIO_FORMATS = ("mp3", "wav", "flac", "aac", "ogg", "m4a", "wma", "opus", "aiff", "alac")
VIDEO_FORMATS = ("mp4", "webm", "mkv", "mov", "avi", "flv", "wmv", "m4v", "mpg", "3gp", "ts", "gif")
NO_SUFFIX = "<NO_EXT>"


def glob_pattern(glob: str) -> str:
    """A Java pattern for a whole-name glob."""
    return re.sub(r"\\[zZ]$", r"\\z", "^" + fnmatch.translate(glob))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def name_parts(name: Column) -> Column:
    """``struct<stem, suffix>``. A leading dot starts no suffix, and neither does a final one."""
    compound = "|".join(s.replace(".", r"\.") for s in COMPOUND_SUFFIXES)
    long_suffix = F.regexp_extract(name, rf"(?is)(?:{compound})$", 0)
    short_suffix = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    suffix = F.when(long_suffix != "", long_suffix).otherwise(short_suffix)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.struct(stem.alias("stem"), suffix.alias("suffix"))


def media_format(text: Column) -> Column:
    """Format name without leading dots, NULL if it is not a known one."""
    plain = F.ltrim(F.lower(text), F.lit("."))
    return F.when(plain.isin(*AUDIO_FORMATS, *VIDEO_FORMATS), plain)


def media_class(text: Column) -> Column:
    plain = media_format(text)
    return F.when(plain.isin(*AUDIO_FORMATS), "audio").when(plain.isNotNull(), "video")


def with_suffix(path: Column, suffix: Column) -> Column:
    """The path with its last suffix exchanged."""
    name = file_name(path)
    stem = F.coalesce(F.nullif(F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1), F.lit("")), name)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    return F.concat(folder, stem, F.lit("."), suffix)
