"""Naming patterns: dates, versions, numbers and words of a name become tokens."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gridwork.functions.paths import NO_SUFFIX, file_name, name_parts
from gridwork.session import once

# What counts as an identifier, a date, a version, a time, a number, a word.
UUID = (
    r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}(?![0-9a-f])"
)
DATE_YMD = (
    r"(?<!\p{Nd})((?:19|20)\p{Nd}{2})([-_.]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\p{Nd}|3[01])"
    r"(?:[T _-]?([01]\p{Nd}|2[0-3])([-_.:]?)([0-5]\p{Nd})(?:\6([0-5]\p{Nd}))?)?(?!\p{Nd})"
)
DATE_DMY = (
    r"(?<!\p{Nd})(0[1-9]|[12]\p{Nd}|3[01])([-_.])(0[1-9]|1[0-2])\2((?:19|20)\p{Nd}{2})(?!\p{Nd})"
)
VERSION = r"(?i)(?<![a-z0-9])v?\p{Nd}+(?:\.\p{Nd}+){1,4}(?![a-z0-9])"
TIME = r"(?<!\p{Nd})([01]\p{Nd}|2[0-3])([:._-])([0-5]\p{Nd})\2([0-5]\p{Nd})(?!\p{Nd})"
NUMBER = r"\p{Nd}+"
WORD = r"[A-Za-zÇĞİÖŞÜçğıöşü]+"
WORD_TOKEN = "<WORD>"

# A token stands in the text as one private-use character until all rules have run.
FIRST_MARK = 0xE000


@dataclass(frozen=True)
class Rule:
    pattern: str
    token: Callable[[Column], Column]
    #: Holds of every text with a match, and costs little: most names need few of the rules.
    possible: Callable[[Column], Column] | None = None


def _holds(text: Column, *marks: str) -> Column:
    found = F.contains(text, F.lit(marks[0]))
    for mark in marks[1:]:
        found = found | F.contains(text, F.lit(mark))
    return found


def _year(text: Column) -> Column:
    return _holds(text, "19", "20")


def _held(text: Column, at: int, marks: str) -> Column:
    """The character at a place if it is one of the marks, else nothing."""
    char = F.substring(text, at, 1)
    return F.when(char.isin(*marks), char).otherwise("")


def _ymd_token(match: Column) -> Column:
    """A match has its parts at places that the separators tell, so no rule is run on it again."""

    def told(sep: Column) -> Column:
        day = F.concat(F.lit("YYYY"), sep, F.lit("MM"), sep, F.lit("DD"))
        rest = F.substr(match, F.length(sep) * 2 + 9)

        def moment(clock: Column) -> Column:
            def timed(time_sep: Column) -> Column:
                seconds = F.when(F.length(clock) > F.length(time_sep) + 4, F.concat(time_sep, F.lit("SS"))).otherwise("")
                return F.concat(F.lit("<DATETIME:"), day, F.lit("_HH"), time_sep, F.lit("MM"), seconds, F.lit(">"))

            date = F.concat(F.lit("<DATE:"), day, F.lit(">"))
            return F.when(clock == "", date).otherwise(once(_held(clock, 3, "-_.:"), timed))

        return once(once(rest, lambda r: F.substr(r, F.length(_held(r, 1, "T _-")) + 1)), moment)

    return once(_held(match, 5, "-_."), told)


def _dmy_token(match: Column) -> Column:
    sep = F.substring(match, 3, 1)
    return F.concat(F.lit("<DATE:DD"), sep, F.lit("MM"), sep, F.lit("YYYY>"))


def _time_token(match: Column) -> Column:
    sep = F.substring(match, 3, 1)
    return F.concat(F.lit("<TIME:HH"), sep, F.lit("MM"), sep, F.lit("SS>"))


RULES = (
    Rule(UUID, lambda m: F.lit("<UUID>"), lambda t: (F.length(t) >= 36) & _holds(t, "-")),
    Rule(DATE_YMD, _ymd_token, _year),
    Rule(DATE_DMY, _dmy_token, lambda t: _year(t) & _holds(t, "-", "_", ".")),
    Rule(VERSION, lambda m: F.lit("<VERSION>"), lambda t: _holds(t, ".")),
    Rule(TIME, _time_token, lambda t: _holds(t, ":", ".", "_", "-")),
    Rule(NUMBER, lambda m: F.concat(F.lit("<NUM:"), F.length(m).cast("string"), F.lit(">"))),
)


def _restored(text: Column, tokens: list[Column]) -> Column:
    def restored(mark: str, listed: Column) -> Callable[[Column], Column]:
        def use(text: Column) -> Column:
            filled = F.zip_with(
                F.split(text, mark), listed, lambda part, token: F.concat(part, F.coalesce(token, F.lit("")))
            )
            return F.when(F.contains(text, F.lit(mark)), F.array_join(filled, "")).otherwise(text)

        return use

    for i, listed in enumerate(tokens):
        text = once(text, restored(chr(FIRST_MARK + i), listed))
    return text


def add_patterns(
    df: DataFrame, path: str = "path", case_sensitive: bool = False, ignore_suffix: bool = False
) -> DataFrame:
    """Adds ``extension``, ``literal`` and ``structural``: the suffix label and the two patterns
    of the file name in ``path``. All of it is one narrow projection."""
    parts = df.withColumn("_parts", name_parts(file_name(F.col(path))))
    stem, suffix = F.col("_parts.stem"), F.col("_parts.suffix")
    if not case_sensitive:
        stem, suffix = F.lower(stem), F.lower(suffix)
    parts = parts.withColumn("_stem", stem)
    parts = parts.withColumn("extension", F.when(suffix == "", NO_SUFFIX).otherwise(suffix))
    text = "_stem"
    for i, rule in enumerate(RULES):
        found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        tokens, marked = F.transform(found, rule.token), F.regexp_replace(text, rule.pattern, chr(FIRST_MARK + i))
        if rule.possible is not None:
            possible = rule.possible(F.col(text))
            none = F.array().cast("array<string>")
            tokens, marked = F.when(possible, tokens).otherwise(none), F.when(possible, marked).otherwise(F.col(text))
        parts = parts.withColumn(f"_tokens_{i}", tokens).withColumn(f"_text_{i}", marked)
        text = f"_text_{i}"
    tokens = [F.col(f"_tokens_{i}") for i in range(len(RULES))]
    tail = F.lit("") if ignore_suffix else F.col("extension")
    parts = parts.withColumn("literal", F.concat(_restored(F.col(text), tokens), tail))
    words = F.regexp_replace(text, WORD, WORD_TOKEN)
    parts = parts.withColumn("structural", F.concat(_restored(words, tokens), tail))
    return parts.select(*df.columns, "extension", "literal", "structural")
