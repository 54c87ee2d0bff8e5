from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillguard.llm.graph import components
from quillguard.llm.minhash import NearDup, near_duplicates, signature
from quillguard.llm.scratch import Scratch
from quillguard.llm.text import U

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows):
    """doc_id to (n_shingles, component_id), ids being unique."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_brute_force(docs, sample):
    expected = brute([(i, t) for i, t, _ in sample])
    out = near_duplicates(docs)
    assert got(out) == expected
    assert {r["doc_id"] for r in out.where("kept").collect()} == {i for i, (_, c) in expected.items() if i == c}


def test_dense_group_and_blocks(spark):
    rng, base = random.Random(1), [f"b{k}" for k in range(150)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**7)}"
        rows.append((1000 - k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(df, params=NearDup(block=16, centres=3))) == brute(rows)


def test_pair_whose_bytes_agree_in_an_earlier_band(spark):
    """1 is the star's centre and too far from 2 and 3, whose signature bytes agree in band 0 while their first bucket is band 3's."""
    rng, base, rows = random.Random(1692), [f"b{k}" for k in range(150)], []
    for i, changes in ((1, 6), (2, 3), (3, 3)):
        words = list(base)
        for _ in range(changes):
            words[rng.randrange(150)] = f"z{rng.randrange(10**7)}"
        rows.append((i, " ".join(words)))
    expected = brute(rows)
    assert [c for _, c in expected.values()] == [1, 2, 2]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected


def test_one_id_with_several_texts(spark):
    """Two texts under each id and a near copy of each: every text keeps its own links."""
    rng, rows, expected = random.Random(1), [], []
    for i in range(20):
        for k in range(2):
            words = [f"i{i}k{k}w{x}" for x in range(150)]
            near = list(words)
            near[rng.randrange(150)] = "z"
            copy = 1000 + 10 * i + k
            rows += [(i, " ".join(words)), (copy, " ".join(near))]
            expected += [(i, 147, i), (copy, 147, i)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((r[0], r[1], r[2]) for r in out.collect()) == sorted(expected)


def test_test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(near_duplicates(df)) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_odd(odd, none):
    out = sorted(near_duplicates(odd).collect(), key=lambda r: (r["doc_id"] or 0, r["n_shingles"]))
    assert [tuple(r) for r in out] == [
        (None, 3, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True),
        (5, 1, 5, True), (5, 1, 5, True), (6, 1, 6, True), (7, 6, 7, True), (8, 1, 8, True),
    ]
    assert near_duplicates(none).collect() == []


def test_one_permutation_estimates_similarity():
    p, rng, errors = NearDup(), np.random.default_rng(3), []
    for n in (5, 50, 500, 5000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**63, n).astype(U) * U(2))
            y = np.unique(np.concatenate([x[: int(n * 0.9)], rng.integers(0, 2**63, n // 10).astype(U) * U(2)]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append((signature(x, p) == signature(y, p)).mean() - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


@pytest.mark.parametrize("edges", [[], [(5, 4), (4, 3), (3, 9), (7, 8), (2, 2)], [(k, k + 1) for k in range(40)], [(50, k) for k in range(40)]])
def test_components(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["label"] for r in components(df, Scratch(spark, "test"), "c").collect()} == {x: root(x) for x in parent}
