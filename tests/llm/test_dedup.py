"""Signatures, classes and components against brute force."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import bagminhash, common, components

from .helpers import ODD, documents, prose


def _bag(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter()


def _similarity(a, b):
    both = sum((a & b).values())
    total = sum((a | b).values())
    return both / total if total else 0.0


def _classes(rows, similarity=0.8):
    bags = {i: _bag(t) for i, t in rows if i is not None}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        if bags[a] and bags[b] and _similarity(bags[a], bags[b]) >= similarity:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in bags}


def _edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.random():.4f}"
    return " ".join(w)


def test_signatures_agree_as_often_as_bags_overlap():
    r, m = random.Random(5), 1500
    for share in (0.2, 0.5, 0.8):
        common_words = [f"w{k}" for k in range(40)]
        a = [w for w in common_words for _ in range(r.choice((1, 1, 2, 6)))]
        b = list(a)
        for k in range(int(len(b) * (1 - share))):
            b[k] = f"x{k}"
        bags = [collections.Counter(x) for x in (a, b)]
        keys = [pa.array(sorted(x)) for x in bags]
        h = [common.string_hashes(k) for k in keys]
        w = [np.array([x[s] for s in k.to_pylist()]) for x, k in zip(bags, keys, strict=True)]
        s = bagminhash.signatures(np.concatenate(h), np.concatenate(w), np.array([len(x) for x in h]), m)
        assert abs((s[0] == s[1]).mean() - _similarity(*bags)) < 4 * (0.25 / m) ** 0.5


def test_a_signature_ignores_the_documents_around_it():
    h = common.string_hashes(pa.array([f"g{k}" for k in range(300)]))
    w = np.ones(300, np.int64)
    alone = bagminhash.signatures(h[:100], w[:100], np.array([100]), 64)
    among = bagminhash.signatures(h, w, np.array([100, 0, 3, 197]), 64)
    assert (alone[0] == among[0]).all() and np.isinf(among[1]).all() and np.isfinite(among[2:]).all()


@pytest.mark.parametrize("extra", [False, True])
def test_classes_equal_brute_force(spark, extra, monkeypatch):
    if extra:
        monkeypatch.setattr(common, "HOT_ROWS", 3)  # most keys of these rows are hot ones
    passage = prose(99, 60)
    rows = list(ODD)
    for k in range(6):
        base = prose(k, 120)
        rows += [(1000 * (k + 1) + j, _edited(base, j % 7, j)) for j in range(12)]
    rows += [(20000 + k, f"{prose(500 + k, 60)} {passage}") for k in range(15)]
    rows += [(30000 + k, "again and again " * 40 + "end " * (k % 3)) for k in range(5)]
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(documents(spark, rows, extra)).collect()}
    want = _classes(rows)
    assert found.pop(None) is None
    assert found == want


def test_a_group_of_near_copies_becomes_one_class_without_all_pairs(spark):
    base = prose(7, 400)
    rows = [(k, _edited(base, 1 + k % 20, k)) for k in range(300)]
    got = bagminhash.classes(documents(spark, rows)).collect()
    assert len({r["class_id"] for r in got}) == len(set(_classes(rows).values()))


def test_deduplicated_keeps_one_row_of_each_class_and_all_columns(spark):
    base = prose(3, 80)
    rows = [(5, base), (4, base), (4, base), (9, _edited(base, 1, 1)), (10, prose(11, 80)), (None, base), (12, None), (13, "")]
    docs = documents(spark, rows, True)
    got = bagminhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([4, 10, None, 12, 13], key=str)
    assert bagminhash.deduplicated(documents(spark, [])).count() == 0


def test_texts_that_share_an_id_are_judged_apart(spark):
    base, other = prose(3, 80), prose(4, 80)
    rows = [(5, base), (5, other), (4, _edited(other, 1, 1)), (9, _edited(base, 1, 2)), (9, prose(6, 80)), (None, base)]
    got = sorted((r["doc_id"], r["class_id"]) for r in bagminhash.classes(documents(spark, rows)).where("doc_id is not null").collect())
    assert got == [(4, 4), (5, 4), (5, 5), (9, 5), (9, 9)]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in bagminhash.deduplicated(documents(spark, rows)).collect())
    assert left == sorted([(0, base), (4, rows[2][1]), (5, base), (9, rows[4][1])])


def test_a_keyed_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(60)] + [(None, 99)], "k long, v long")
    counts = left.where("k is not null and k <> 2").groupBy("k").count().withColumnRenamed("count", "n")
    for how, rows in (("inner", left.where("k is not null and k <> 2").count()), ("left", 61)):
        got = common.keyed_join(left, counts, ["k"], 61, how)
        assert got.exceptAll(left.join(counts, "k", how)).isEmpty() and got.count() == rows


@pytest.mark.parametrize("hot", [64, 2])
def test_components(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(r.randrange(900, 1000), r.randrange(900, 1000)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["id"]: r["class_id"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
