"""Text helpers that work on whole values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cell limit, kept length and note of a cut text, size of a text piece.
CELL_LIMIT = 32767
CUT_LENGTH = 32750
CUT_NOTE = "\n[TRUNCATED]"
PIECE_LENGTH = 30000
# Characters that end a line.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def limit_text(text: Column) -> Column:
    """Texts over the cell limit are cut and say so."""
    return F.when(
        F.length(text) > CELL_LIMIT, F.concat(F.substring(text, 1, CUT_LENGTH), F.lit(CUT_NOTE))
    ).otherwise(text)


def pieces(text: Column, size: int = PIECE_LENGTH) -> Column:
    """The whole text as an array of pieces of ``size`` characters."""
    count = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def unix_lines(text: Column) -> Column:
    """CRLF to LF; a lone CR stays."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def safe_file_name(text: Column, limit: int = 80) -> Column:
    """A title made fit for a file name."""
    # Characters a file name cannot hold.
    reserved = F.regexp_replace(text, r'[\\/:*?"<>|]', "_")
    spaced = F.trim(F.regexp_replace(reserved, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.coalesce(F.nullif(F.substring(spaced, 1, limit), F.lit("")), F.lit("untitled"))
