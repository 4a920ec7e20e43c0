"""Signature rules for licences, written as phrases over words.

A phrase lists words (each a regular expression without blanks), groups ``( | )`` and optional groups
``( )?``. A rule is tried only where some word begins with its keyword. Higher priorities win where one
detection lies inside another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BASE, NOTICE, STATEMENT, NAME, HINT = 5, 4, 3, 2, 1


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    phrase: str

    @property
    def pattern(self) -> str:
        """Over units ' word ', so that neighbouring words never share a blank."""
        parts = re.findall(r"\(|\)\??|\||[^ ()|]+", self.phrase)
        unit = {"(": "(?:", ")": ")", ")?": ")?", "|": "|"}
        return "".join(unit.get(x) or f" (?:{x}) " for x in parts)


#: The phrases that count as base detections.
BASE_PHRASES = {"mit": ("licen", "under the mit license"), "apache-2": ("apache", "apache license version 2"), "cc-by-nc": ("cc", "cc by nc")}

_L = "licen[sc]e"

#: label: keyword and form of its name.
_OTHERS = {
    "mit": ("licen", f"(mit|expat) {_L}"),
    "mit-0": ("attribution", f"mit no attribution ({_L})?"),
    "isc": ("isc", f"isc {_L}"),
    "bsd-2-clause": ("clause", f"(bsd 2 clause|2 clause bsd) ({_L})?"),
    "bsd-3-clause": ("clause", f"(bsd 3 clause|3 clause bsd) ({_L})?"),
    "bsd-4-clause": ("clause", f"(bsd 4 clause|4 clause bsd) ({_L})?"),
    "bsd": ("bsd", f"bsd (style)? {_L}"),
    "0bsd": ("0bsd", f"0bsd ({_L})?"),
    "apache-1.0": ("apache", f"apache (software)? {_L} (version|v)? (1 0|v1 0)"),
    "apache-1.1": ("apache", f"apache (software)? {_L} (version|v)? (1 1|v1 1)"),
    "apache-2": ("apache", f"apache (software)? ({_L})? (version|v)? (2 0|v2 0|2|v2)"),
    "apache": ("apache", f"apache (software)? {_L}"),
    "mpl-1.0": ("mozilla", f"mozilla public {_L} (version|v)? 1 0"),
    "mpl-1.1": ("mozilla", f"mozilla public {_L} (version|v)? 1 1"),
    "mpl-2.0": ("mozilla", f"mozilla public {_L} (version|v)? (2 0|v2 0|2|v2)"),
    "epl-1.0": ("eclipse", f"eclipse public {_L} (version|v)? (1 0|v1 0)"),
    "epl-2.0": ("eclipse", f"eclipse public {_L} (version|v)? (2 0|v2 0)"),
    "cddl-1.0": ("distribution", f"common development and distribution {_L} (version|v)? (1 0)?"),
    "cpl-1.0": ("common", f"common public {_L} (version|v)? (1 0)?"),
    "eupl-1.2": ("european", f"european union public {_L} (version|v)? (1 2)?"),
    "artistic-1.0": ("artistic", f"artistic {_L} (version|v)? 1 0"),
    "artistic-2.0": ("artistic", f"artistic {_L} (version|v)? (2 0|2)"),
    "zlib": ("zlib", f"zlib (libpng)? {_L}"),
    "boost-1.0": ("boost ", f"boost software {_L} (version|v)? (1 0)?"),
    "psf-2.0": ("python", f"python (software foundation)? {_L} (version|v)? (2)?"),
    "openssl": ("openssl", f"openssl {_L}"),
    "unlicense": ("unlicense", "the unlicense"),
    "wtfpl": ("wtfpl", f"wtfpl ({_L})?"),
    "postgresql": ("postgresql", f"postgresql {_L}"),
    "php-3.01": ("php", f"php {_L} (version|v)? (3 0 1|3 01|3 0)?"),
    "ruby": ("ruby", f"ruby {_L}"),
    "vim": ("vim ", f"vim {_L}"),
    "ofl-1.1": ("font", f"(sil)? open font {_L} (version|v)? (1 1)?"),
    "odbl-1.0": ("database", f"open (data commons open)? database {_L} (version|v)? (1 0)?"),
    "odc-by-1.0": ("attribution", f"open data commons attribution {_L} (version|v)? (1 0)?"),
    "ms-pl": ("microsoft", f"microsoft public {_L}"),
    "ms-rl": ("microsoft", f"microsoft reciprocal {_L}"),
    "ncsa": ("illinois", f"university of illinois (ncsa)? (open source)? {_L}"),
    "ecl-2.0": ("educational", f"educational community {_L} (version|v)? (2 0)?"),
    "osl-3.0": ("open", f"open software {_L} (version|v)? (3 0)?"),
    "afl-3.0": ("academic", f"academic free {_L} (version|v)? (3 0)?"),
    "upl-1.0": ("universal", f"universal permissive {_L} (version|v)? (1 0)?"),
    "bsl-1.1": ("business", f"business source {_L} (version|v)? (1 1)?"),
    "sspl-1.0": ("server", f"server side public {_L} (version|v)? (1)?"),
    "elastic-2.0": ("elastic", f"elastic {_L} (version|v)? (2 0|2)?"),
    "cc0-1.0": ("cc0", "(creative commons)? cc0 (1 0)? (universal)?"),
}



def _gnu() -> list[tuple[str, str, str]]:
    """Family by family, each version alone and with all later ones, spelled out or short."""
    families = {"gpl": ("general public", ("1", "2", "3")), "lgpl": ("(lesser|library) general public", ("2", "2 1", "3")), "agpl": ("affero general public", ("1", "3"))}
    later = "(or)? ((at your option)? any later version|(or)? later)"
    names = []
    for family, (words, versions) in families.items():
        spelled, short = ("general", f"(gnu)? {words} {_L}"), (family, f"(gnu)? {family}")
        for version in versions:
            number = version if " " in version else f"{version} (0)?"
            for keyword, name in (spelled, short):
                form = f"{name} ((version|v)? {number}|v{number})"
                label = f"{family}-{version.replace(' ', '.')}"
                names += [(label, keyword, form), (f"{label}-or-later", keyword, f"{form} {later}")]
        names += [(family, "gnu", f"gnu {words} {_L}"), (family, family, f"(gnu {family}|{family} {_L})")]
    return names


def _creative_commons() -> list[tuple[str, str, str]]:
    """By elements, then by version, short or spelled out."""
    elements = {
        "by": "attribution",
        "by sa": "attribution (share alike|sharealike)",
        "by nd": "attribution (no derivatives|noderivs|noderivatives)",
        "by nc": "attribution (non commercial|noncommercial)",
        "by nc sa": "attribution (non commercial|noncommercial) (share alike|sharealike)",
        "by nc nd": "attribution (non commercial|noncommercial) (no derivatives|noderivs|noderivatives)",
    }
    names = []
    for short, spelled in elements.items():
        label = f"cc-{short.replace(' ', '-')}"
        for keyword, form in (("cc", f"cc {short}"), ("creative", f"creative commons {spelled}")):
            names.append((label, keyword, f"{form} ({_L})?"))
            for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
                named = f"{form} (international|unported|generic)? ({_L})? (version|v)? {version}"
                names.append((f"{label}-{version.replace(' ', '.')}", keyword, named))
    return names


#: Sentences that only one licence has.
_NOTICES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "hereby", "permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software"),
    ("apache-2", "compliance", f"you may not use this file except in compliance with the {_L}"),
    ("gpl", "redistribute", f"you can redistribute it and or modify it under the terms of the gnu general public {_L}"),
    ("lgpl", "redistribute", f"you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public {_L}"),
    ("agpl", "redistribute", f"you can redistribute it and or modify it under the terms of the gnu affero general public {_L}"),
    ("mpl-2.0", "obtain", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived", "has waived all copyright and related (or|and) neighboring rights"),
    ("boost-1.0", "accompanying", f"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this {_L}"),
]

_HINTS = [
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "confidential", "(proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", "unauthorized (copying|use|distribution|reproduction) (of this (file|document|software))? is (strictly)? (prohibited|forbidden)"),
    ("proprietary", "redistribute", "(do not|may not be) (copy or)? redistribute"),
    ("public-domain", "domain", "(in|into|to|under) the public domain"),
    ("public-domain", "domain", "public domain dedication"),
    ("copyright", "copyright", "copyright (c)? [12][0-9][0-9][0-9]"),
    ("free-use", "free", "free for (personal|academic|non commercial|noncommercial) use"),
    ("non-commercial", "commercial", "(for|only for)? non commercial (use|purposes) (only)?"),
    ("open-source", "source", f"open source {_L}"),
    ("unknown-license", "licen", f"see (the)? {_L} (file)? for (the)? (details|terms|more information)"),
]

_SAID = "((licensed|released|distributed|published|available|provided|offered) (to you)? under|subject to|governed by|covered by|under)"


def _rules() -> list[Rule]:
    rules = [Rule(label, BASE, keyword, phrase) for label, (keyword, phrase) in BASE_PHRASES.items()]
    rules += [Rule(label, NOTICE, keyword, phrase) for label, keyword, phrase in _NOTICES]
    names = [(label, keyword, form) for label, (keyword, form) in _OTHERS.items()] + _gnu() + _creative_commons()
    for label, keyword, form in names:
        rules.append(Rule(label, NAME, keyword, form))
        rules.append(Rule(label, STATEMENT, keyword, f"{_SAID} (the (terms|conditions) of)? (the|a|an)? {form}"))
    for label in sorted({label for label, _, _ in names}):
        spelled = re.sub(r"[-.]", " ", label)
        rules.append(Rule(label, NOTICE, "spdx", f"spdx {_L} identifier {spelled}"))
    return rules + [Rule(label, HINT, keyword, phrase) for label, keyword, phrase in _HINTS]


RULES = _rules()
