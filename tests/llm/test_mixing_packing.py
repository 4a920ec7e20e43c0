"""Mixing and packing against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import mixing, packing
from llm.bpe import byte_bpe, vocabulary_files
from tools import documents, messy, nothing

CALM = "the river runs along a quiet field and many birds sing over it while old men walk home slowly".split()


def _targets(sizes: dict) -> dict:
    """The rule word by word: what lies above three times the size is shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.CYCLE[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in held]
        rest = total - sum(3 * sizes[s] for s in held)
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return {s: float(share[s]) if s in share else 3.0 * sizes[s] for s in names}
        held |= above


def _mix(docs):
    plan = mixing.mix(docs, mixing.n_words("text"), block=7)
    taken = mixing.pieces(plan).groupBy("source_key", "row_no").agg(F.sum(F.col("until_word") - F.col("from_word")).alias("taken"))
    return plan, plan.rows.join(taken, ["source_key", "row_no"], "left").select("id", "source", "size", "target", F.coalesce("taken", F.lit(0)).alias("taken")).collect()


def test_mix_against_the_rule(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "en", str(rng.choice(["a", "b", "c", "d", "é"], p=[0.6, 0.2, 0.1, 0.06, 0.04]))) for i in range(400)]
    rows += [(900 + i, "x y", "en", None) for i in range(5)]
    docs = documents(spark, rows)
    plan, out = _mix(docs)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    targets = _targets(sizes)
    assert len(out) == len(rows)
    for source, target in targets.items():
        own = [r for r in out if r.source == source]
        assert all(abs(r.target - target) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 0.5 + 1e-6
        assert all(r.taken <= 3 * r.size for r in own)
    # every word of every pass lies in one slot, and slots differ by one word at most
    pieces = mixing.pieces(plan).groupBy("source_key", "slot").agg(F.sum(F.col("until_word") - F.col("from_word")).alias("n")).collect()
    assert len({p.slot for p in pieces}) == len(pieces)
    for key in {p.source_key for p in pieces}:
        n = [p.n for p in pieces if p.source_key == key]
        assert max(n) - min(n) <= 1
    assert sorted((r.id, r.taken) for r in _mix(docs)[1]) == sorted((r.id, r.taken) for r in out)


def test_mix_order_is_the_hash(spark):
    docs = documents(spark, [(i, "a b c") for i in range(10)] + [(100, "z " * 3, "en", "t")])
    taken = {r.id: r.taken for r in _mix(docs)[1] if r.source == "s"}
    order = sorted(taken, key=lambda i: hashlib.md5(f"0:v{i}".encode()).hexdigest())
    more = [taken[i] for i in order]
    assert more == sorted(more, reverse=True)


def test_mixed_rows_and_messy_documents(spark):
    docs = messy(spark)
    plan, out = _mix(docs)
    assert len(out) == docs.count()
    mixed = mixing.mixed_rows(docs, length="n_chars")
    assert mixed.columns == docs.columns
    words = sum(len(re.findall(r"[^ \t-\r]+", r.text)) for r in mixed.collect())
    assert words == sum(r.taken for r in out)
    assert _mix(nothing(spark))[1] == []
    assert mixing.mixed_rows(nothing(spark)).count() == 0


def test_mixed_rows_follow_the_schedule(spark):
    docs = documents(spark, [(i, "w " * (300 + 40 * i), "en", "abc"[i % 3]) for i in range(30)])
    plan = mixing.mix(docs, mixing.n_words("text"))
    slots: dict = {}
    for p in mixing.pieces(plan).collect():
        words, first = slots.get((p.id, p["pass"]), (0, (p.from_word, p.slot, p["at"])))
        slots[p.id, p["pass"]] = words + p.until_word - p.from_word, min(first, (p.from_word, p.slot, p["at"]))
    wanted = [(i, words) for (i, _), (words, _) in sorted(slots.items(), key=lambda kv: kv[1][1][1:])]
    assert [(r.doc_id, len(r.text.split())) for r in mixing.mixed_rows(docs).collect()] == wanted
    assert len({i % 3 for i, _ in wanted[:4]}) > 1


def test_mixed_rows_are_the_pieces_of_the_schedule(spark, monkeypatch):
    docs = documents(spark, [(i, "w " * 700, "en", "ab"[i % 2]) for i in range(12)])
    whole = mixing.pieces
    monkeypatch.setattr(mixing, "pieces", lambda plan: whole(plan).filter("source_key = 'va'"))
    assert {r.source for r in mixing.mixed_rows(docs).collect()} == {"a"}


def _check_packing(pieces, docs, window):
    bpe = byte_bpe(*vocabulary_files())
    ids = {i: np.append(bpe.encode(t or ""), 0).astype("<u4") for i, t in docs}
    seen: dict = {}
    sequences: dict = {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert zlib.crc32(part.tobytes()) == p.ids_crc32
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(seen) == set(ids)
    for i, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0


def test_packing_lays_each_id_down_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "UNITS_PER_SHARD", 16)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "x1", "é", "🙂"], int(rng.integers(0, 60))))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "w " * 9000)]
    pieces = packing.pack(documents(spark, rows), window=64).collect()
    _check_packing(pieces, rows, 64)


def test_packing_prefers_lexical_neighbours():
    weights = np.ones(50, dtype=np.float32)
    units = [np.array([1, 2, 3], dtype=np.uint16), np.array([7, 8], dtype=np.uint16), np.array([1, 3], dtype=np.uint16), np.array([9], dtype=np.uint16)]
    index = packing.Index(units, weights, 2.0)
    assert index.neighbours(0, np.array([0.0, 1, 1, 1])).tolist() == [2]
    pieces = list(packing.pack_shard([np.repeat(u, 2) for u in units], weights, 4.0, 8))
    first = [p[2] for p in pieces if p[0] == 0]
    assert first[:2] == [0, 2]


@pytest.mark.parametrize("long", [False, True])
def test_related_documents_meet_in_a_window(spark, monkeypatch, long):
    """Of a corpus many times a shard. What relates long documents stands in their full windows only."""
    monkeypatch.setattr(packing, "UNITS_PER_SHARD", 16)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(480):
        own = [str(100 + 6 * (i % 30) + int(x)) for x in rng.integers(0, 6, 40)]
        rest = [str(x) for x in rng.choice(CALM, 30)]
        rows.append((i, " ".join(own * 2 + rest if long else own[:12] + rest[:8])))
    pieces = packing.pack(documents(spark, rows), window=64).collect()
    _check_packing(pieces, rows, 64)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, set()).add(p.doc_id)
    pairs = [a % 30 == b % 30 for docs in sequences.values() for a in docs for b in docs if a < b]
    assert len(pairs) > 200 and sum(pairs) > 0.6 * len(pairs)


def test_units_of_one_text_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "UNITS_PER_SHARD", 16)
    rows = [(i, "the same words again") for i in range(300)]
    units = packing.encoded(documents(spark, rows), "doc_id", "text", 64, vocabulary_files())
    seen = packing.corpus_weights(units, byte_bpe(*vocabulary_files()).size)[0]
    sizes = [r["count"] for r in packing.dealt(units.drop("full"), seen).groupBy("shard").count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 48
    _check_packing(packing.pack(documents(spark, rows), window=64).collect(), rows, 64)


def test_packing_messy_documents(spark):
    pieces = packing.pack(messy(spark)).collect()
    bpe = byte_bpe(*vocabulary_files())
    expected = sum(len(bpe.encode(r.text or "")) + 1 for r in messy(spark).select("text").collect())
    assert sum(p.length for p in pieces) == expected
    assert packing.pack(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing(spark), window=100)


def test_texts_without_runs_of_blanks_need_no_word_table():
    """They go to the library whole; all others are cut into words that are looked up. The ids are the same."""
    bpe = byte_bpe(*vocabulary_files())
    rng = np.random.default_rng(8)
    parts = ["it's", "don't", "WE'LL", "'s", "x1y22", "42", "é", "naïve", "µ", "...", "a'b", "(c)", "zqxjv", "'", "-", "_"]
    single = ["", " ", "\n", "a", " a", "a ", "a\nb", "\ta\t", "a 'll b", *["".join(p + str(rng.choice([" ", "\n", "\t", ""])) for p in rng.choice(parts, 12)) for _ in range(300)]]
    runs = [x.replace(" ", str(rng.choice(["  ", " \n", "\n ", "\r\n", "   "]))) for x in single]
    bpe.words.clear()
    bpe.words.old = {}
    for text in single:
        assert bpe.encode(text).tolist() == bpe.whole.encode(text, add_special_tokens=False).ids
    assert not bpe.words
    for text in runs:
        assert bpe.encode(text).tolist() == bpe.whole.encode(text, add_special_tokens=False).ids
    assert bpe.words


def test_held_counts_ids():
    for ids in ([], [3], [5, 5, 2, 65535, 2, 5]):
        found, n = packing.held(np.array(ids, dtype=np.uint16))
        assert dict(zip(found.tolist(), n.tolist(), strict=True)) == {x: ids.count(x) for x in ids}
        assert (found.dtype, n.dtype) == (np.uint16, np.uint32)
