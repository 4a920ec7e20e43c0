"""Token counts, chat formatting, licences: against the libraries themselves and hand-made cases."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from llm import chat, licenses, token_counts
from llm.bpe import byte_bpe, vocabulary_files
from llm.license_rules import RULES
from tools import documents, messy, nothing

ALPHABET = "ab'sStdmlverE 1２²é×÷Éñ\n\t\r\x0b\x1c\x85\xa0.,!?&#|\\[]/<>— 日本🙂٣"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40), st.booleans())
def test_ids_and_spans_are_those_of_the_library(text, special):
    bpe = byte_bpe(*vocabulary_files())
    text += "<|endoftext|>" * special
    right = bpe.whole.encode(text, add_special_tokens=False)
    ids = bpe.encode(text)
    assert ids.tolist() == right.ids
    if not special:
        assert bpe.decode(ids) == text
        if len(ids):
            spans = token_counts.token_spans(bpe.lengths[ids], text.encode())
            assert list(zip(*(x.tolist() for x in spans), strict=True)) == right.offsets


def _by_hand(text: str, sections: list[tuple[int, int]], rule: str) -> list[tuple[float, int]]:
    offsets = byte_bpe(*vocabulary_files()).whole.encode(text, add_special_tokens=False).offsets
    out = []
    for low, high in sections:
        if rule == "first":
            n = sum(low <= a < high for a, _ in offsets)
        elif rule == "last":
            n = sum(low < b <= high for _, b in offsets)
        else:
            n = sum(max(0, min(b, high) - max(a, low)) / (b - a) for a, b in offsets)
        crossing = sum(max(a, low) < min(b, high) and not (low <= a and b <= high) for a, b in offsets)
        out.append((n, crossing))
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=5), st.sampled_from(token_counts.RULES))
def test_interval_join_counts_as_by_hand(text, sections, rule):
    sections = [(min(a, len(text)), min(max(a, b), len(text))) for a, b in sections]
    bpe = byte_bpe(*vocabulary_files())
    first, end = token_counts.token_spans(bpe.lengths[bpe.encode(text)], text.encode())
    counts, crossing = token_counts.count_in(first, end, np.array([a for a, _ in sections]), np.array([b for _, b in sections]), rule)
    for got, also, (n, c) in zip(counts, crossing, _by_hand(text, sections, rule), strict=True):
        assert got == pytest.approx(n)
        assert also == c


def test_token_counts_of_messy_documents(spark):
    docs = messy(spark)
    rows = token_counts.attribute_tokens(docs).collect()
    texts = {}
    for row in docs.select("doc_id", "text").collect():
        texts.setdefault(row.doc_id, []).append(row.text or "")
    assert len(rows) == sum(t.count("\n") + 1 for x in texts.values() for t in x)
    bpe = byte_bpe(*vocabulary_files())
    for i, x in texts.items():
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == sum(len(bpe.encode(t)) for t in x)
    assert token_counts.attribute_tokens(nothing(spark)).count() == 0


def test_token_counts_of_given_sections(spark):
    docs = documents(spark, [(1, "alpha beta gamma"), (2, "delta")])
    sections = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, None), (2, 0, None, None), (9, 0, 0, 3)], "doc_id long, section long, start long, end long")
    rows = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens) for r in token_counts.attribute_tokens(docs, sections, "share").collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0)}
    assert rows[1, 0][2] + rows[1, 1][2] == pytest.approx(len(byte_bpe(*vocabulary_files()).encode("alpha beta gamma")))
    with pytest.raises(ValueError):
        token_counts.attribute_tokens(docs, rule="none")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a\\<|>[]/INSTsend turnxSY" , max_size=30), st.lists(st.sampled_from(chat.CONTROL), max_size=3))
def test_escaping_is_reversible_and_leaves_no_control_string(text, control):
    text = text + "".join(c + text[:2] for c in control)
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


def test_chat_digests(spark):
    hard = "".join(chat.CONTROL) + "\\</s>\\\\"
    turns = [
        (1, 0, "user", hard), (1, 1, "assistant", "fine " + hard), (1, 2, "user", ""), (1, 3, "assistant", None),
        (2, None, None, "first"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (None, 1, "assistant", "lost"),
        (3, 1, "user", "w " * 40_000),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.read_digests(chat.format_turns(df)).collect()}
    order = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", hashlib.md5((t[3] or "").encode()).hexdigest()))
    assert set(rows) == {1, 2, 3, None}
    for key, row in rows.items():
        own = [t for t in order if t[0] == key]
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        learnt = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert row.n_turns == len(own)
        assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        around = sum(map(len, chat.MARKERS))
        assert row.formatted_chars == sum(around + len(chat.escape(t[2] or "")) + len(chat.escape(t[3] or "")) for t in own)
    assert chat.read_digests(chat.format_turns(df.limit(0))).count() == 0


def test_reserved_ids_come_from_markers_alone(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "<|turn|>x<|end|>")], "conv_id long, turn long, role string, text string")
    row = chat.format_turns(df).first()
    size = byte_bpe(*vocabulary_files()).size
    assert [i - size for i in row.ids if i >= size] == [0, 1, 2]
    assert sum(row.loss) == len([i for i in row.ids if i < size]) - len(byte_bpe(*vocabulary_files()).encode("assistant"))


def test_license_rules():
    assert len(RULES) > 200
    assert all(" " + r.keyword.strip() in " " + r.phrase.replace("(", " ").replace("|", " ") for r in RULES)


def _scan(spark, *texts):
    rows = licenses.scan(documents(spark, list(enumerate(texts)))).select("doc_id", "licenses.*").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r.doc_id)]


def test_license_scan(spark):
    plain, contained, twice, gnu, german = _scan(
        spark,
        "Released under the MIT License.",
        "This is licensed under the Apache License, Version 2.0 and nothing else",
        "cc by nc cc-by-nc 4.0 CC BY NC",
        "GNU General Public License v3 or later",
        "mit licen mit",
    )
    assert (plain["n_words"], plain["n_base"], plain["first_word"], plain["base_labels"], plain["labels"]) == (5, 1, 1, "mit", "mit")
    assert (contained["base_labels"], contained["labels"]) == ("apache-2", "apache-2")
    assert contained["score"] == pytest.approx(8 / 13)
    assert (twice["n_base"], twice["first_word"], twice["last_word"], twice["base_labels"]) == (3, 0, 8, "cc-by-nc")
    assert gnu["labels"] == "gpl-3-or-later"
    assert (german["n_base"], german["labels"], german["score"], german["first_word"]) == (0, "", 0.0, None)


#: Texts, the labels that hold, and how many of their words lie in detections, found by reading.
LICENSE_TABLE = [
    ("apache license version 2", "apache-2", 4),
    ("Apache License, Version 2.0", "apache-2", 5),
    ("Apache-2.0", "apache-2", 3),
    ("apache license v2.0 applies", "apache-2", 4),
    ("Apache License 1.1", "apache-1.1", 4),
    ("under the MIT license", "mit", 4),
    ("Expat License", "mit", 2),
    ("the mitten license", "", 0),
    ("MPL: Mozilla Public License 2.0", "mpl-2.0", 5),
    ("Mozilla Public License version 1.1", "mpl-1.1", 6),
    ("Mozilla Public License v2.0", "mpl-2.0", 5),
    ("CC BY NC", "cc-by-nc", 3),
    ("ISC License", "isc", 2),
    ("The Unlicense", "unlicense", 2),
    ("no word of it", "", 0),
]


def test_license_table(spark):
    rows = _scan(spark, *[t for t, _, _ in LICENSE_TABLE])
    for row, (text, labels, covered) in zip(rows, LICENSE_TABLE, strict=True):
        assert (row["labels"], round(row["score"] * row["n_words"])) == (labels, covered), text


def test_license_scan_of_messy_documents(spark):
    docs = messy(spark)
    out = licenses.scan(docs)
    assert set(out.columns) == set(docs.columns)
    assert out.count() == docs.count()
    assert {r.licenses.n_words for r in out.filter("doc_id IN (2, 3, 4)").collect()} == {0}
    assert licenses.scan(nothing(spark)).count() == 0
