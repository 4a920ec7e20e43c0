"""Near-duplicate documents and vectors, nearest vectors and components against brute force."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm import minhash, neighbour_graph, posting_lists
from llm.graph import components, forest
from llm.shingles import shingle_sets
from tools import documents, messy, nothing


def _set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^ \t-\r]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def _reach(n, linked):
    label = list(range(n))
    for i, j in linked:
        a, b = label[i], label[j]
        if a != b:
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def _sets(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return shingle_sets(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t\x0b.", max_size=40), min_size=1, max_size=6))
def test_shingle_sets_are_those_of_the_words(texts):
    sets = _sets(texts)
    for i, a in enumerate(texts):
        assert len(sets.of(i)) == len(_set(a))
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets.of(i), sets.of(j))) == len(_set(a) & _set(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=40).filter(str.strip), min_size=1, max_size=6), st.sampled_from([50, 80, 85, 100]))
def test_similarity_is_exact(texts, percent):
    sets = _sets(texts)
    got = minhash.similar([sets.of(i) for i in range(len(texts))], percent)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert got[i, j] == (100 * len(_set(a) & _set(b)) >= percent * len(_set(a) | _set(b)))


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    names = sorted({x for link in links for x in link})
    label = _reach(len(names), [(names.index(a), names.index(b)) for a, b in links])
    least = {i: min(names[j] for j in range(len(names)) if label[j] == label[i]) for i in range(len(names))}
    assert all(rows.get(x, x) == least[i] for i, x in enumerate(names))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    linked = np.eye(4, dtype=bool)
    linked[0, 2] = linked[2, 0] = linked[2, 3] = linked[3, 2] = True
    assert forest(linked).tolist() == [0, 1, 0, 0]


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    """With small blocks the groups here are large ones: hubs first, then what stays outside."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    if block < 256:
        monkeypatch.setattr(minhash, "COUNTED_LIST", 5)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = list(rng.choice(words, int(rng.integers(3, 120))))
        for _ in range(int(rng.integers(1, 40))):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 4))):
                copy[at] = str(rng.choice(words)).upper()
            rows.append((int(rng.integers(10**9)), " ".join(copy)))
    rows += [(7, None), (8, ""), (9, " \t"), (10, "same"), (11, "SAME")]
    out = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    sets = [_set(t) for _, t in rows]
    linked = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    label = _reach(len(rows), linked)
    for i, (doc, _) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])
        assert (out[doc].n_shingles, out[doc].component_id, out[doc].kept) == (len(sets[i]), least, least == doc)


def test_pages_with_an_edited_paragraph_are_one_in_the_pipeline(spark):
    words = [f"w{i}" for i in range(204)]
    edited = words[:90] + [f"new{i}" for i in range(16)] + words[106:]
    sets = [_set(" ".join(x)) for x in (words, edited)]
    assert 0.80 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    docs = documents(spark, [(1, " ".join(words)), (2, " ".join(edited)), (3, "another text")])
    assert sorted(r.doc_id for r in minhash.one_of_each(docs).collect()) == [1, 3]
    assert all(r.kept for r in minhash.near_duplicates(docs).collect())


def test_of_an_id_only_the_near_copy_goes(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (5, base + " more"), (5, base.upper() + " more"), (5, "a text of its own"), (6, base), (7, None), (None, base)]
    kept = minhash.one_of_each(documents(spark, rows)).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == [(0, base), (1, base), (5, "a text of its own"), (7, "")]


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_coordinates_miss_as_few_pairs_as_said(percent):
    coordinates, least = minhash.scheme(percent)
    p = percent / 100
    missed = sum(math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k) for k in range(least))
    assert missed <= 1 / 60_000


def test_near_duplicates_of_messy_documents(spark):
    rows = minhash.near_duplicates(messy(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles) for r in rows).count((1, 2)) == 2
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    stay = minhash.one_of_each(messy(spark))
    assert stay.columns == messy(spark).columns
    assert stay.filter("doc_id = 1").count() == 2
    assert stay.count() == messy(spark).count() - 1
    assert minhash.near_duplicates(nothing(spark)).count() == 0
    assert minhash.one_of_each(nothing(spark)).count() == 0


def _vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("x") for c in ("node", "rep", "vector", "id", "rank")})


def _clustered(rng, n=600, dim=24):
    points = rng.standard_normal((n, dim))
    for _ in range(30):
        a = rng.integers(0, n)
        group = rng.integers(0, n, int(rng.integers(1, 30)))
        points[group] = points[a] + rng.standard_normal((len(group), dim)) * rng.choice([0.0, 0.05, 0.3])
    return points.astype(np.float32)


ODD = [(901, None, 0), (902, [], 0), (903, [0.0] * 24, 0), (904, [float("nan")] + [1.0] * 23, 0), (905, [None] + [1.0] * 23, 0), (906, [float("inf")] + [1.0] * 23, 0), (907, [1.0, 2.0], 0), (None, [1.0] * 24, 0)]


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbour_graph, "BLOCK", 16)
    points = _clustered(np.random.default_rng(4))
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    out = {r.vec_id: r for r in neighbour_graph.near_vectors(_vectors(spark, rows + ODD + rows[:3])).collect()}
    unit = points.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = _reach(len(points), list(zip(*np.nonzero(linked), strict=True)))
    wrong = sum(out[i].n_links != linked[i].sum() or out[i].component_id != min(j for j in range(len(points)) if label[j] == label[i]) for i in range(len(points)))
    assert wrong == 0
    for i, *_ in ODD:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert neighbour_graph.near_vectors(_vectors(spark, rows).limit(0)).count() == 0


def test_audit_sees_missing_links_of_few_and_uneven_classes(spark, monkeypatch):
    monkeypatch.setattr(neighbour_graph, "AUDITED", 64)
    rng = np.random.default_rng(8)
    points = rng.standard_normal((700, 24))
    points[690:] = points[:10] + 0.01 * rng.standard_normal((10, 24))
    points[300:400] = points[300] + 0.01 * rng.standard_normal((100, 24))
    rows = [(bytearray(f"{i:04}".encode()), bytearray(p.astype("<f4").tobytes()), 1 + i % 2) for i, p in enumerate(points)]
    classes = spark.createDataFrame(rows, "node binary, vector binary, copies long")
    none = spark.createDataFrame([], "node binary, links long")
    assert neighbour_graph._audit(classes, none, "<f4") == 0
    group = [(rows[i][0], sum(rows[j][2] for j in range(300, 400)) - rows[i][2]) for i in range(300, 400)]
    assert neighbour_graph._audit(classes, spark.createDataFrame(group, none.schema), "<f4") == pytest.approx(100 / 120)
    assert neighbour_graph._audit(classes.limit(0), none, "<f4") == 1


def test_near_vectors_keep_a_tight_group_together(spark):
    """Forty groups inside one group: the nearest ones of each vector are of its own small group, and
    nothing else may split the large one. A flat group has more than one block in each bucket."""
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(24)
    centres = np.repeat(centre + 0.05 * rng.standard_normal((40, 24)), 50, axis=0)
    nested = centres + 0.001 * rng.standard_normal((2000, 24))
    flat = -centre + 0.05 * rng.standard_normal((700, 24))
    points = np.concatenate([nested, flat, rng.standard_normal((300, 24))]).astype(np.float32)
    out = neighbour_graph.near_vectors(_vectors(spark, [(i, [float(x) for x in p], 0) for i, p in enumerate(points)])).collect()
    assert all((r.n_links, r.component_id) == (1999, 0) for r in out if r.vec_id < 2000)
    assert all((r.n_links, r.component_id) == (699, 2000) for r in out if 2000 <= r.vec_id < 2700)


def test_near_vectors_fail_when_links_stay_missing(spark, monkeypatch):
    monkeypatch.setattr(neighbour_graph, "_audit", lambda *_: 0.5)
    monkeypatch.setattr(neighbour_graph, "MOST_ATTEMPTS", 1)
    with pytest.raises(RuntimeError):
        neighbour_graph.near_vectors(_vectors(spark, [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0)]))


def test_nearest_vectors_recall_and_ties(spark):
    points = _clustered(np.random.default_rng(6))
    points[50:60] = points[0]
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    found = posting_lists.nearest(_vectors(spark, rows + ODD), F.col("id") % 50 == 0)
    out = found.collect()
    unit = points.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.id) for r in own] == sorted((-r.score, r.id) for r in own)
        sims = unit @ unit[q]
        assert all(abs(sims[r.id] - r.score) < 1e-9 and r.id != q for r in own)
        worst = np.sort(np.delete(sims, q))[-5]
        hits += sum(sims[r.id] >= worst - 1e-9 for r in own)
    assert hits >= 0.9 * 5 * 12
    assert [r.id for r in sorted((r for r in out if r.query_id == 0), key=lambda r: r["rank"])] == [50, 51, 52, 53, 54]
    assert posting_lists.nearest(_vectors(spark, rows).limit(0), F.col("id") % 50 == 0).count() == 0
    few = posting_lists.nearest(_vectors(spark, rows[:3]), F.col("id") == 0).collect()
    assert sorted(r.id for r in few) == [1, 2]


def test_repeated_rows_are_searched_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(62)]
    rows += [rows[0]] * 3 + [rows[13]] * 2 + [(70, rows[13][1])]
    found = posting_lists.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id").isin(0, 13)).collect()
    for query in (0, 13):
        mine = sorted((r for r in found if r.query_id == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert len({r.id for r in mine}) == 5 and query not in {r.id for r in mine}
    assert [r.id for r in found if r.query_id == 13 and r["rank"] == 1] == [70]


def test_nearest_vectors_meet_once_for_a_shelf(spark, monkeypatch):
    # All lists are searched, by blocks of 64 vectors: what is found is what brute force finds, ties by id.
    rng = np.random.default_rng(9)
    points = rng.integers(-8, 9, (700, 8)).astype(np.float32)
    points[:40] = np.outer(np.arange(1, 41), points[0])
    fit, written, rows = posting_lists.fit, posting_lists.written, {}

    def all_lists(*args):
        index = fit(*args)
        index.ratio, index.beam = np.inf, len(index.centers)
        rows["lists"], rows["blocks"] = len(index.centers), int(index.blocks.sum())
        return index

    def seen(df, name):
        out = written(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(posting_lists, "fit", all_lists)
    monkeypatch.setattr(posting_lists, "written", seen)
    monkeypatch.setattr(posting_lists, "VECTORS_PER_LIST", 20)
    monkeypatch.setattr(posting_lists, "MEETING_BYTES", 64 * points[0].nbytes, raising=False)
    found = posting_lists.nearest(_vectors(spark, [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]), F.col("id") % 3 == 0)
    held = np.flatnonzero((points != 0).any(axis=1))
    unit = points[held].astype(np.float64) / np.linalg.norm(points[held].astype(np.float64), axis=1, keepdims=True)
    wanted = set()
    for at, query in enumerate(held):
        if query % 3 == 0:
            sims = np.round(unit @ unit[at], 9)
            sims[at] = -2
            wanted |= {(int(query), rank + 1, int(held[i])) for rank, i in enumerate(np.lexsort((held, -sims))[:5])}
    got = {(r.query_id, r["rank"], r.id): r.score for r in found.collect()}
    assert len(got) == len(wanted)
    # Digits beyond the 9th may tell ties apart.
    for query, rank, i in set(got) - wanted:
        other = next(x for q, r, x in wanted if (q, r) == (query, rank))
        a, b, c = (points[x].astype(np.float64) / np.linalg.norm(points[x].astype(np.float64)) for x in (query, i, other))
        assert abs(a @ b - a @ c) < 1e-9
    # A query class is written once, not for every list, and there are several blocks.
    assert rows["searches"] <= (held % 3 == 0).sum() < rows["lists"] * 10 and rows["blocks"] > 4
