"""Text of nested JSON values of any depth: documents, comment threads, lists, named objects.

Spark's expressions can't recurse, so nested values go through one Arrow-batched function; of VARIANT values only
they do, of records that are JSON text all wanted fields, which are read in one go (``record_texts``). It walks with
stacks of its own, so depth is no limit of it. Numbers keep the digits they are written with.
"""

from __future__ import annotations

import json
from decimal import Decimal
from math import isinf

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Document nodes that end a line, and the keys that name an object.
BLOCK_NODES = (
    "paragraph",
    "heading",
    "listItem",
    "bulletList",
    "orderedList",
    "blockquote",
    "codeBlock",
)
NAMING_KEYS = ("displayName", "value", "name", "key")


class Number(str):
    """A JSON number as it was written."""


def parse(text: str):
    return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=Number)


class Whole(Number):
    """A whole number of a record, still as it was written there."""


class Fraction(Number):
    """Another number of a record, still as it was written there."""


def _is_double(number: Number) -> bool:
    """Whether a VARIANT takes the number of a record for a double: it has an exponent or more than 38 digits."""
    digits = number.lstrip("-")
    if type(number) is Whole:
        return len(digits) > 38
    whole, _, decimals = digits.partition(".")
    return "e" in digits or "E" in digits or len(decimals) > 38 or len((whole + decimals).lstrip("0")) > 38


def _decimal(number: Number) -> str:
    """Without the zeros at its end, as in a VARIANT."""
    short = number.rstrip("0").rstrip(".") if type(number) is Fraction else str(number)
    return "0" if short == "-0" else short


def _double(number: Number) -> str:
    """The nearest double as JSON of a VARIANT spells it; beyond all doubles it is a text."""
    value = float(number)
    if isinf(value):
        return '"Infinity"' if value > 0 else '"-Infinity"'
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return plain(repr(value))
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    shown = "".join(map(str, digits))
    return f"{'-' * sign}{shown[0]}.{shown[1:] or '0'}E{exponent + len(digits) - 1}"


def number_text(number: Number) -> str:
    """A number as a text; those of records first become what a VARIANT makes of them."""
    if type(number) is Number:
        return plain(number)
    if not _is_double(number):
        return _decimal(number)
    value = float(number)
    return _double(number).strip('"') if isinf(value) else plain(repr(value))


def _members(pairs: list) -> dict:
    members = dict(pairs)
    if len(members) != len(pairs):
        raise ValueError("a key is there twice")
    return members


def _no_number(word: str):
    raise ValueError(word)


_RECORD = json.JSONDecoder(object_pairs_hook=_members, parse_int=Whole, parse_float=Fraction, parse_constant=_no_number)


def record(text: str | None) -> dict:
    """The members of a JSON object by the rules of ``try_parse_json``; what is none has no members."""
    try:
        value = _RECORD.raw_decode(text, len(text) - len(text.lstrip(" \t\n\r")))[0] if text else None
    except (ValueError, RecursionError):
        value = None
    return value if isinstance(value, dict) else {}


def plain(number: str) -> str:
    """Without exponent; a fraction keeps one digit at least."""
    if not any(c in number for c in ".eE"):
        return number
    whole, _, fraction = format(Decimal(number), "f").partition(".")
    return f"{whole}.{fraction.rstrip('0') or '0'}"


def _units(entry: tuple) -> bytes:
    return entry[0].encode("utf-16-be", "surrogatepass")


def compact(value) -> str:
    """The value as JSON without blanks, its keys sorted as in a VARIANT, by UTF-16 units."""
    if isinstance(value, Number):
        if type(value) is Number:
            return str(value)
        return _double(value) if _is_double(value) else _decimal(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{compact(v)}" for k, v in sorted(value.items(), key=_units)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def scalar(value) -> str | None:
    if value is None or type(value) is str:
        return value
    if isinstance(value, bool):
        return str(value)
    return number_text(value)


def tree_text(root, blanks: str) -> str:
    """Plain text of a document. Text nodes follow each other; a block loses the blanks at its end and
    ends its line. ``open_nodes`` holds each unfinished node's kind, where its text begins in ``out``,
    and its children still to come."""
    out: list[str] = []
    open_nodes = [(None, 0, iter([root]))]
    while open_nodes:
        kind, begin, rest = open_nodes[-1]
        node = next(rest, open_nodes)
        if node is open_nodes:
            open_nodes.pop()
            if kind in BLOCK_NODES:
                out[begin:] = ["".join(out[begin:]).rstrip(blanks) + "\n"]
        elif isinstance(node, dict):
            if node.get("type") == "text":
                out.append(scalar(node.get("text")) or "")
            else:
                content = node.get("content")
                kind = node.get("type")
                open_nodes.append((kind if isinstance(kind, str) else None, len(out), iter(content if isinstance(content, list) else ())))
        elif isinstance(node, list):
            open_nodes.append((None, len(out), iter(node)))
        else:
            out.append(scalar(node) or "")
    return "".join(out)


def named_text(value) -> str | None:
    """A scalar, or an object by the first naming key it has; other values as JSON."""
    if isinstance(value, dict):
        key = next((k for k in NAMING_KEYS if k in value), None)
        inner = value[key] if key else value
        return compact(inner) if isinstance(inner, (dict, list)) else scalar(inner)
    return compact(value) if isinstance(value, list) else scalar(value)


def part_text(value, blanks: str) -> str | None:
    if isinstance(value, dict) and value.get("type") == "doc":
        return tree_text(value, blanks).strip(blanks)
    return named_text(value)


def _comment(comment, blanks: str) -> str:
    comment = comment if isinstance(comment, dict) else {}
    author = comment.get("author") if isinstance(comment.get("author"), dict) else {}
    who = scalar(author.get("displayName")) or scalar(author.get("name")) or ""
    when = scalar(comment.get("created"))
    head = who + (f" [{when}]" if when else "")
    return (f"{head}\n" if head else "") + (part_text(comment.get("body"), blanks) or "")


def field_text(value, blanks: str) -> str | None:
    """A whole field: items of a list, however deep the lists, on a line each; comments under their
    heads with a blank line between; else one part."""
    if isinstance(value, list):
        lines, rest = [], value[::-1]
        while rest:
            item = rest.pop()
            if isinstance(item, list):
                rest.extend(item[::-1])
            elif type(item) is str:
                lines.append(item)
            else:
                lines.append(part_text(item, blanks))
        return "\n".join(x for x in lines if x)
    if isinstance(value, dict) and value.get("type") != "doc" and isinstance(value.get("comments"), list):
        return "\n\n".join(_comment(c, blanks) for c in value["comments"])
    return part_text(value, blanks)


def field_texts(nested: Column, blanks: str) -> Column:
    """Texts of an array of JSON texts; NULL stays NULL."""

    @F.pandas_udf("array<string>")
    def texts(rows: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else [None if v is None else field_text(parse(v), blanks) for v in row] for row in rows])

    return texts(nested)


def kind_and_text(value, blanks: str) -> tuple[str, str | None]:
    """A field that is there: its kind as a VARIANT has it, and its text."""
    kind = type(value)
    if kind is str:
        return "STRING", value
    if kind is dict:
        return "OBJECT", field_text(value, blanks)
    if kind is list:
        return "ARRAY", field_text(value, blanks)
    if value is None or kind is bool:
        return "VOID" if value is None else "BOOLEAN", scalar(value)
    if kind is Whole and len(value) < 19:
        return "BIGINT", scalar(value)
    shown = scalar(value)
    if kind is Whole and -(1 << 63) <= int(value) < 1 << 63:
        return "BIGINT", shown
    if shown.endswith("Infinity"):
        return "STRING", shown
    return "DOUBLE", shown + ".0" if "." not in shown and len(shown) <= 18 else shown


def record_texts(records: Column, ids: list[str], blanks: str) -> Column:
    """``array<struct<kind, text>>``, an item per field of ``ids``, of records that are JSON texts. The fields a
    record doesn't have are without kind."""

    @F.arrow_udf("array<struct<kind: string, text: string>>")
    def texts(rows: pa.Array) -> pa.Array:
        kinds, shown = [], []
        for row in rows.to_pylist():
            members = record(row)
            for i in ids:
                kind, text = kind_and_text(members[i], blanks) if i in members else (None, None)
                kinds.append(kind)
                shown.append(text)
        try:
            column = pa.array(shown, pa.string())
        except UnicodeEncodeError:
            # Halves of surrogate pairs, which no column of texts holds.
            column = pa.array([t if t is None else t.encode("utf-8", "replace").decode() for t in shown], pa.string())
        items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), column], names=["kind", "text"])
        offsets = pa.array(range(0, len(shown) + 1, len(ids)), pa.int32())
        return pa.ListArray.from_arrays(offsets, items)

    return texts(records)


def tree_texts(tree: Column, blanks: str) -> Column:
    """Plain text of documents given as JSON."""

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else tree_text(parse(v), blanks) for v in rows], dtype=object)

    return texts(tree)
