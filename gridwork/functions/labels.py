"""Header titles: candidates, normal form, similarity, and a cheap exact bound on it."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from gridwork.functions.cells import strip
from gridwork.functions.text import lines
from gridwork.session import once

_BEFORE_FOLD = str.maketrans({"ı": "i", "İ": "I", "\u00ad": None})
_WORD = re.compile(r"[^\W_]+")


def fold_label(text: str) -> str:
    """Letters, accents, case, spaces and punctuation evened out."""
    folded = unicodedata.normalize("NFKD", text.translate(_BEFORE_FOLD)).casefold()
    return " ".join(_WORD.findall("".join(c for c in folded if not unicodedata.combining(c))))


@F.pandas_udf(T.StringType())
def _fold_labels(texts: pd.Series) -> pd.Series:
    return texts.map(fold_label, na_action="ignore")


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def fold_ascii(text: Column) -> Column:
    """Normal form of a plain ASCII text."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def folded(text: Column, when: Column | None = None) -> Column:
    """Normal form of any text. ASCII stays in the JVM; only other texts (that also satisfy
    ``when``) reach Python, the rest of them give NULL."""
    plain = is_ascii(text)
    python_side = ~plain if when is None else ~plain & when
    return F.coalesce(F.when(plain, fold_ascii(text)), _fold_labels(F.when(python_side, text)))


#: No letter or digit lies beyond.
_LAST_LETTER = 0x33FFF


@lru_cache(maxsize=1)
def _folded_characters() -> tuple[dict[str, str], str]:
    """By ``fold_label``'s rules, what each character beyond ASCII becomes that doesn't stay as it is (nothing, or
    letters and digits with blanks for what separates them), and all characters that hold a letter or a digit,
    as ranges of a regular expression. All other characters separate words."""
    folds, ranges, begin = {}, [], None
    for code in range(0x80, _LAST_LETTER + 2):
        c = chr(code)
        parts = unicodedata.normalize("NFKD", c.translate(_BEFORE_FOLD)).casefold()
        shown = "".join(x if x.isalnum() else " " for x in parts if not unicodedata.combining(x))
        solid = bool(shown.strip())
        if shown != c and (solid or not shown):
            folds[c] = shown
        if solid and begin is None:
            begin = code
        elif not solid and begin is not None:
            ranges.append(f"\\x{{{begin:X}}}-\\x{{{code - 1:X}}}")
            begin = None
    return folds, "".join(ranges)


def folds_to_one_of(text: Column, labels: Sequence[str]) -> Column:
    """Whether a text's normal form is one of the given ones, worked out in the JVM. Characters that fold to
    letters of the labels are mapped, one by one or, if to several, by replacements that only texts with such
    characters go through; other letters stay as they are and are in no label."""
    letters = {c for label in labels for c in label} | {" "}
    folds, solid = _folded_characters()
    near = {c: s for c, s in folds.items() if set(s) <= letters}
    single, several = ({c: s for c, s in near.items() if (len(s) > 1) == more} for more in (False, True))
    order = sorted(single, key=lambda c: not single[c])
    mapped = F.translate(text, "".join(order), "".join(single[c] for c in order))
    if several:
        spelt = mapped
        for c, s in several.items():
            spelt = F.replace(spelt, F.lit(c), F.lit(s))
        mapped = F.when(mapped.rlike(f"[{''.join(several)}]"), spelt).otherwise(mapped)
    beyond = F.trim(F.regexp_replace(F.lower(mapped), f"[^0-9a-z{solid}]+", " "))
    return F.when(is_ascii(text), fold_ascii(text)).otherwise(beyond).isin(list(labels))


def title_candidates(raw: Column, mode: str, max_lines: int) -> Column:
    """Texts a header cell may stand for: leading lines only, never a later line alone."""
    if mode == "full":
        return F.array(strip(raw))
    kept = F.filter(F.transform(lines(raw), strip), lambda line: line != "")
    limit = 1 if mode == "first_line" else max_lines
    longest = F.least(F.size(kept), F.lit(limit))
    joined = F.transform(F.sequence(F.lit(1), longest), lambda n: F.array_join(F.slice(kept, 1, n), " "))
    return F.when(F.size(kept) > 0, joined).otherwise(F.array(F.lit("")))


def first_title(raw: Column, mode: str) -> Column:
    """The candidate that stands for a title without a match."""
    return F.get(title_candidates(raw, mode, 1), F.lit(0))


def _tail(text: Column, first: Column) -> Column:
    return F.substr(text, first)


def _head(text: Column, size: Column) -> Column:
    return F.substr(text, F.lit(1), size)


def _longest_common(a: Column, b: Column) -> Column:
    """``struct<i, j, size>`` of the longest text that both hold, at its first place in ``a`` and then in
    ``b``, counted from 1; size 0 if there is none. A place in ``b`` can begin a common text of n characters
    only if it and the next place begin one of n - 1, so few places are looked for after the first round."""
    place = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"))

    def longer(state: Column, size: Column) -> Column:
        places = state["places"]
        likely = F.filter(places, lambda x: F.exists(places, lambda y: y["j"] == x["j"] + 1))
        found = F.transform(likely, lambda x: F.struct(F.call_function("locate", F.substr(b, x["j"], size), a).alias("i"), x["j"].alias("j")))
        found = F.filter(found, lambda x: x["i"] > 0)

        def taken(here: Column) -> Column:
            first, n = F.when(F.size(here) > 0, F.array_min(here)), F.when(F.size(here) > 0, size)
            return F.struct(here.alias("places"), F.coalesce(first, state["first"]).alias("first"), F.coalesce(n, state["size"]).alias("size"))

        return F.when(F.size(places) == 0, state).otherwise(once(found, taken))

    every = F.transform(F.sequence(F.lit(1), F.length(b) + 1), lambda j: F.struct(F.lit(1).alias("i"), j.alias("j")))
    start = F.struct(every.alias("places"), place.alias("first"), F.lit(0).alias("size"))
    steps = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    return F.aggregate(steps, start, longer, lambda s: F.struct(s["first"]["i"].alias("i"), s["first"]["j"].alias("j"), s["size"].alias("size")))


def common_size(left: Column, right: Column) -> Column:
    """Characters in the matching blocks of two texts: the longest common text, and the same again on what
    stands before it in both and on what stands behind it in both. Open parts wait on a stack."""
    part = F.struct(left.alias("a"), right.alias("b"))

    def step(state: Column, _: Column) -> Column:
        top = F.element_at(state["open"], -1)
        rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)

        def split(found: Column) -> Column:
            before = F.struct(_head(top["a"], found["i"] - 1).alias("a"), _head(top["b"], found["j"] - 1).alias("b"))
            behind = F.struct(_tail(top["a"], found["i"] + found["size"]).alias("a"), _tail(top["b"], found["j"] + found["size"]).alias("b"))
            parts = F.filter(F.array(before, behind), lambda p: (p["a"] != "") & (p["b"] != ""))
            left_open = F.when(found["size"] > 0, F.concat(rest, parts)).otherwise(rest)
            return F.struct(left_open.alias("open"), (state["size"] + found["size"]).alias("size"))

        return F.when(F.size(state["open"]) == 0, state).otherwise(once(_longest_common(top["a"], top["b"]), split))

    # Every part taken up is the whole, or lies beside a block of at least one character.
    steps = F.sequence(F.lit(1), 2 * F.least(F.length(left), F.length(right)) + 1)
    start = F.struct(F.array(part).alias("open"), F.lit(0).alias("size"))
    return F.aggregate(steps, start, step, lambda s: s["size"])


def _gestalt(label: Column, alias: Column) -> Column:
    """Twice the matching characters by all characters, as percent: of the texts without blanks, or of their
    sorted words if that is more."""

    def ratio(left: Column, right: Column) -> Column:
        return F.lit(2.0) * common_size(left, right) / (F.length(left) + F.length(right))

    def sorted_words(text: Column) -> Column:
        return F.array_join(F.array_sort(F.split(text, " ", -1)), " ")

    return 100 * F.greatest(ratio(compact(label), compact(alias)), ratio(sorted_words(label), sorted_words(alias)))


def similarity(label: Column, alias: Column, short_limit: int) -> Column:
    """0 to 100 for two normal forms, worked out in the JVM."""
    x, y = compact(label), compact(alias)
    decided = F.when((x == "") | (y == ""), 0.0).when(x == y, 100.0)
    decided = decided.when(F.least(F.length(x), F.length(y)) <= short_limit, 0.0)
    return decided.otherwise(_gestalt(label, alias))


def compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def without(text: Column, letters: Column) -> Column:
    """The text without the given characters."""
    return F.call_function("translate", text, letters, F.lit(""))


def let(value: Column, test: Callable[[Column], Column]) -> Column:
    """A condition on a value that is worked out once."""
    return F.exists(F.array(value), test)


def can_score(label: Column, tight: Column, alias: Column, short_limit: int, floor: float) -> Column:
    """False only if :func:`similarity` of a normal form (``tight`` without its spaces) and an
    alias stays below ``floor``: a common part is no longer than the shorter text and holds only
    characters of the alias. ``alias`` is ``struct<tight, letters, size, tight_size, ...>``."""
    size, tight_size = F.length(label), F.length(tight)
    size_sum, tight_sum = size + alias["size"], tight_size + alias["tight_size"]
    near = (200 * F.least(tight_size, alias["tight_size"]) >= floor * tight_sum) | (
        200 * F.least(size, alias["size"]) >= floor * size_sum
    )

    def close(shared: Column) -> Column:
        direct = 200 * F.least(shared, alias["tight_size"]) >= floor * tight_sum - 1e-6
        spaced = 200 * F.least(shared + size - tight_size, alias["size"]) >= floor * size_sum - 1e-6
        return direct | spaced

    open_case = (F.least(tight_size, alias["tight_size"]) > short_limit) & near
    return (tight == alias["tight"]) | (
        open_case & let(tight_size - F.length(without(tight, alias["letters"])), close)
    )


class TitleBound:
    """Says from counts of characters whether a title can reach a score against any alias.

    A title has *known* characters, letters and digits that occur in some alias, and *foreign*
    ones that occur in none. Only known characters and the spaces between words can be part of a
    match, and a text of n letters has fewer than n spaces. So for every number of known characters
    there is a largest number of foreign ones beyond which the score is out of reach. Texts with
    other than printable ASCII characters are not judged (``open``).
    """

    def __init__(self, aliases: Sequence[str], score: float):
        letters = {c for c in "".join(aliases) if c.isalnum()}
        ascii_marks = {chr(c) for c in range(128) if chr(c).isalnum()}
        self.known_marks = "".join(sorted(letters | {c.upper() for c in letters if c.isascii()}))
        self.foreign_marks = "".join(sorted(c for c in ascii_marks if c.lower() not in letters))
        compact_sizes = {len(a.replace(" ", "")) for a in aliases}
        spaced_sizes = {len(a) for a in aliases}
        self.score = score
        self.longest = int(max(spaced_sizes) * (200 / score - 1)) + 1
        sizes = range(self.longest + 1)
        self.limits = [
            max((f for f in sizes if self._possible(k, f, compact_sizes, spaced_sizes, score)), default=-1) for k in sizes
        ]
        self.most_foreign = max(0, *self.limits)
        self.aliases = json.dumps(
            [
                {"letters": "".join(sorted({*a, *a.upper()} - {" "})), "compact": len(a.replace(" ", "")), "spaced": len(a)}
                for a in sorted(set(aliases))
            ]
        )

    @staticmethod
    def _possible(known: int, foreign: int, compact_sizes: set[int], spaced_sizes: set[int], score: float) -> bool:
        size = known + foreign

        def reaches(common: int, total: int) -> bool:
            return 200 * common >= score * total - 1e-6

        if any(reaches(min(known, m), size + m) for m in compact_sizes):
            return True
        spaces = range(size)
        return any(reaches(min(known + n, m), size + n + m) for m in spaced_sizes for n in spaces)

    def counted(self, text: Column) -> Column:
        """``struct<raw, known, foreign, open>`` of a title."""
        return F.struct(
            text.alias("raw"),
            (F.length(text) - F.length(F.translate(text, self.known_marks, ""))).alias("known"),
            (F.length(text) - F.length(F.translate(text, self.foreign_marks, ""))).alias("foreign"),
            text.rlike(r"[^\x20-\x7E]").alias("open"),
        )

    def reaches(self, known: Column, foreign: Column, open_text: Column) -> Column:
        """The title can reach the score."""
        limits = F.expr(f"array({', '.join(map(str, self.limits))})")
        return open_text | F.coalesce(foreign <= F.get(limits, known), F.lit(False))

    def within(self, part: Column) -> Column:
        """The title, or one it is a part of, can reach the score."""
        small = (part["known"] <= self.longest) & (part["foreign"] <= self.most_foreign)
        return F.coalesce(part["open"] | small, F.lit(False))

    def reaches_alias(self, raw: Column, size: Column) -> Column:
        """Sharper and dearer than ``reaches``: some alias shares enough characters with the title
        of ``size`` letters and digits."""

        def close(a: Column) -> Column:
            near = (200 * F.least(size, a["compact"]) >= self.score * (size + a["compact"])) | (
                200 * F.least(2 * size, a["spaced"]) >= self.score * (size + a["spaced"])
            )

            def enough(shared: Column) -> Column:
                spaces = F.least(F.greatest(a["spaced"] - shared, F.lit(0)), F.greatest(size - 1, F.lit(0)))
                direct = 200 * F.least(shared, a["compact"]) >= self.score * (size + a["compact"]) - 1e-6
                spaced = 200 * F.least(shared + spaces, a["spaced"]) >= self.score * (size + spaces + a["spaced"]) - 1e-6
                return direct | spaced

            return near & let(F.length(raw) - F.length(without(raw, a["letters"])), enough)

        aliases = F.from_json(F.lit(self.aliases), "array<struct<letters:string,compact:int,spaced:int>>")
        return F.exists(aliases, close)
