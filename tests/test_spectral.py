"""Spectral embedding against numpy's eigenvectors, and the tree of triangles against one."""

import random

import numpy as np
import pytest

from weftgraph.operators import graph
from weftgraph.operators.spectral import spectral_embedding, tall_triangle


def planted(seed, clusters, size, inner, outer):
    r = random.Random(seed)
    n = clusters * size
    return [(i, j) for i in range(n) for j in range(i) if r.random() < (inner if i // size == j // size else outer)]


def eigen(pairs, k):
    names = sorted({v for p in pairs for v in p})
    at = {v: i for i, v in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for x, y in pairs:
        a[at[x], at[y]] = a[at[y], at[x]] = 1
    d = a.sum(axis=0)
    values, vectors = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    return names, values[::-1][:k], vectors[:, ::-1][:, :k]


def edges(spark, pairs):
    return graph.symmetrize(spark.createDataFrame(pairs, "src long, dst long").repartition(3))


def test_angles_to_numpy(spark):
    pairs = planted(1, 4, 25, 0.5, 0.04)
    names, values, vectors = eigen(pairs, 5)
    out, found = spectral_embedding(edges(spark, [*pairs, (3, 3), (None, 1), (1, None)]), 4, rounds=30)
    x = {r["v"]: r["x"] for r in out.collect()}
    assert sorted(x) == names and found == pytest.approx(values[:4], abs=1e-3)
    got = np.array([x[v] for v in names])
    assert got.T @ got == pytest.approx(np.eye(4), abs=1e-9)
    cosines = np.linalg.svd(got.T @ vectors[:, :4])[1]  # of the angles between the two spaces
    assert cosines.min() > 1 - 1e-3
    assert all(abs(got[:, i] @ vectors[:, i]) > 0.99 for i in range(4) if min(abs(values[i] - values[j]) for j in range(5) if j != i) > 0.05)
    assert all(c[np.abs(c).argmax()] > 0 for c in got.T)


def test_components_are_told_apart(spark):
    two = [(a, b) for a in range(6) for b in range(a)] + [(10 + a, 10 + b) for a in range(5) for b in range(a)]
    out, values = spectral_embedding(edges(spark, two), 2, rounds=40)
    assert values == pytest.approx([1, 1], abs=1e-9)
    x = {r["v"]: np.array(r["x"]) for r in out.collect()}
    inside = [np.dot(x[a], x[b]) / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) for a, b in two]
    assert min(inside) > 1 - 1e-6 and abs(np.dot(x[0], x[10])) < 1e-6


def test_small_and_empty(spark):
    out, values = spectral_embedding(edges(spark, []), 3)
    assert out.count() == 0 and values == []
    out, values = spectral_embedding(edges(spark, [(1, 2)]), 3, rounds=3)
    assert values == pytest.approx([1, -1], abs=1e-9) and out.count() == 2
    for wrong in (0, 1000):
        with pytest.raises(ValueError):
            spectral_embedding(edges(spark, [(1, 2)]), wrong)


@pytest.mark.parametrize("branch", [2, 32])
def test_tree_of_triangles(spark, branch):
    x = np.random.default_rng(3).standard_normal((101, 4))
    table = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(9)
    r = tall_triangle(table, 4, branch)
    assert r == pytest.approx(np.triu(r)) and r.T @ r == pytest.approx(x.T @ x)
    few = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").repartition(5)
    assert (r := tall_triangle(few, 3, 2)).T @ r == pytest.approx(np.outer([1, 2, 3], [1, 2, 3]))
