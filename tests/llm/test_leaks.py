"""Benchmark windows in documents against a search word by word."""

from __future__ import annotations

import re

import pytest

from llm import leaks
from tools import documents, messy, nothing

ITEM = "What is the capital of the small island state in the far south of the sea?"


def _small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _small(text))


def _expected(text, items, width=10):
    words, hit, found = _words(text), set(), set()
    for item_id, item in items:
        own = _words(item)
        for at in range(max(len(own) - width + 1, min(len(own), 1))):
            window = own[at : at + width]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found |= {str(item_id)} if item_id is not None else set()
    return len(words), hit, sorted(found)


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, row string, id string, found string")


TEXTS = [
    "so: WHAT is -- the capital of the small island state, in the far south of the sea, they asked. No one knew",
    "is the capital of the small island state in the very far south of the sea",
    "Ünïcode x " + ITEM.upper() + " 日本 " + ITEM,
    "forty two is two words; forty-two, not fortytwo: FORTY TWO",
    "the capital of the small island state in the far",
    "wort äöü ÄÖÜ wort",
    "a a a a a a a a a a a a a",
    None,
    "",
    "?!",
]
ITEMS = [(1, ITEM), (10, "forty two"), (2, "Forty Two!"), (3, "äöü"), (4, None), (5, ""), (6, "a a a"), (1, ITEM), (None, "they asked"), (7, "b " * 12), (8, "two words forty")]


@pytest.mark.parametrize("part_bytes", [leaks.PATTERN_BYTES, 120])
def test_leaks_are_those_of_a_search_word_by_word(spark, part_bytes):
    items = _items(spark, [(i, t, "x", "x", "x") for i, t in ITEMS])
    docs = documents(spark, list(enumerate(TEXTS)))
    for row in leaks.scan(docs, items, part_bytes=part_bytes).collect():
        text = TEXTS[row.doc_id] or ""
        n, hit, found = _expected(text, ITEMS)
        assert (row.leaks.n_words, row.leaks.n_hit, row.leaks["items"]) == (n, len(hit), found)
        assert {i for s in row.leaks.spans for i in range(s.first_word, s.until_word)} == hit
        for span in row.leaks.spans:
            assert _words(text[span.start : span.end]) == _words(text)[span.first_word : span.until_word]
            assert text[span.start : span.start + 1].strip() and text[span.end - 1 : span.end].strip()


def test_many_items_are_joined_instead_of_sent(spark, monkeypatch):
    items = _items(spark, [(i, t, "x", "x", "x") for i, t in ITEMS])
    docs = documents(spark, list(enumerate(TEXTS)))
    sent = {r.doc_id: r.leaks for r in leaks.scan(docs, items).collect()}
    monkeypatch.setattr(leaks, "PAIR_BYTES", 0)
    assert {r.doc_id: r.leaks for r in leaks.scan(docs, items).collect()} == sent


def test_leaks_are_cut_out(spark):
    items = _items(spark, [(1, ITEM, "x", "x", "x")])
    docs = documents(spark, [(1, f"Before. {ITEM} After."), (2, "Clean text"), (3, None)])
    out = {r.doc_id: r.text for r in leaks.without_leaks(docs, items).collect()}
    assert out == {1: "Before. ? After.", 2: "Clean text", 3: None}


def test_leaks_of_messy_documents(spark):
    items = _items(spark, [(1, "w5 w6", "x", "x", "x"), (2, "short", "x", "x", "x")])
    docs = messy(spark)
    out = leaks.scan(docs, items)
    assert set(out.columns) == {*docs.columns, "leaks"} and out.count() == docs.count()
    assert {(r.doc_id, r.leaks.n_hit) for r in out.filter("leaks.n_hit > 0").collect()} == {(5, 2 * 31), (6, 1)}
    assert leaks.scan(docs, items.limit(0)).filter("leaks.n_hit > 0").isEmpty()
    assert leaks.scan(nothing(spark), items).isEmpty()
