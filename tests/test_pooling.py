"""Soft pooling: slopes against differences, sums against whole matrices, a planted partition found."""

import random
from collections import Counter

import numpy as np
import pytest

from weftgraph.operators import pooling
from weftgraph.operators.pooling import Layer


def small(seed, n=12, d=5, k=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    up = np.triu(r.integers(0, 3, (n, n)) * (r.random((n, n)) < 0.5), 1).astype(float)
    return x, up + up.T, Layer(r.standard_normal((d, k)), r.standard_normal(k))


def whole(layer, x, adjacency):
    """The objective from whole matrices."""
    s, d = layer.shares(x), adjacency.sum(axis=1)
    b = adjacency - np.outer(d, d) / d.sum()
    return -np.trace(s.T @ b @ s) / d.sum() + np.sqrt(s.shape[1]) / len(x) * np.linalg.norm(s.sum(axis=0)) - 1


def parts(layer, x, adjacency):
    d = adjacency.sum(axis=1)
    i, j = np.nonzero(adjacency)
    total = pooling.sums(layer, x, d)
    by_edge = pooling.edge_slope(layer, x[i], x[j], adjacency[i, j], d.sum())
    return by_edge + pooling.vertex_slope(layer, x, d, total, d.sum(), len(x)), pooling.objective(by_edge[-1], total, d.sum(), len(x))


@pytest.mark.parametrize("seed", range(4))
def test_slopes_against_differences(seed):
    x, adjacency, layer = small(seed)
    slope, value = parts(layer, x, adjacency)
    assert value == pytest.approx(whole(layer, x, adjacency))
    flat = np.r_[layer.weight.ravel(), layer.bias]
    for at in range(len(flat)):
        def moved(h):
            new = flat.copy()
            new[at] += h
            return whole(Layer(new[: layer.weight.size].reshape(layer.weight.shape), new[layer.weight.size :]), x, adjacency)
        assert slope[at] == pytest.approx((moved(1e-5) - moved(-1e-5)) / 2e-5, abs=1e-7)


def tables(spark, pairs, x, names=None):
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double").repartition(4)
    return edges, spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v]) for i, v in x], "v long, x array<double>").repartition(3)


def test_losses_equal_whole_matrices(spark):
    x, adjacency, _ = small(9, n=20)
    i, j = np.nonzero(adjacency)
    odd = [(0, 0, 5.0), (0, 1, 0.0), (0, 2, -1.0), (None, 1, 1.0), (1, None, 1.0), (0, 99, 1.0), (99, 0, 1.0), (0, 98, 1.0), (97, 0, 1.0), (96, 0, 1.0)]
    edges, feats = tables(spark, [*((int(a), int(b), float(adjacency[a, b])) for a, b in zip(i, j)), *odd], [*enumerate(x), (98, None), (97, [1.0]), (96, [float("nan")] * 5), (95, [None] * 5), (None, x[0])])
    layer = pooling.fit_pooling(edges, feats, 3, steps=3, seed=4)
    start = np.random.default_rng(4).standard_normal((5, 3)) / np.sqrt(5)
    assert layer.losses[0] == pytest.approx(whole(Layer(start, np.zeros(3)), x, adjacency)) and len(layer.losses) == 3
    got = {r["v"]: r for r in pooling.assign(feats, layer).collect()}
    for v in range(20):
        assert got[v]["shares"] == pytest.approx(layer.shares(x[v : v + 1])[0].tolist()) and got[v]["cluster"] == int(np.argmax(got[v]["shares"]))
    assert all(got[v]["shares"] is None and got[v]["cluster"] is None for v in (95, 96, 97, 98))
    s = layer.shares(x)
    pooled = {(r["src"], r["dst"]): r["weight"] for r in pooling.pooled_edges(edges, feats, layer).collect()}
    assert np.array([[pooled[a, b] for b in range(3)] for a in range(3)]) == pytest.approx(s.T @ adjacency @ s)


def test_planted_partition_is_found(spark):
    r, g = random.Random(1), np.random.default_rng(1)
    n, k, d = 240, 4, 16
    of = [r.randrange(k) for _ in range(n)]
    pairs = {(a, b) for a in range(n) for b in range(a) if r.random() < (0.25 if of[a] == of[b] else 0.02)}
    centers = g.standard_normal((k, d))
    x = np.array([centers[c] for c in of]) + 1.2 * g.standard_normal((n, d))  # features alone tell clusters apart badly
    edges, feats = tables(spark, [(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])], [*enumerate(x)])
    layer = pooling.fit_pooling(edges, feats, k, steps=40, rate=0.1, seed=2)
    assert layer.losses[-1] < layer.losses[0] - 0.2
    found = Counter((of[row["v"]], row["cluster"]) for row in pooling.assign(feats, layer).collect())
    assert sum(max(found[c, p] for c in range(k)) for p in range(k)) / n > 0.85


def test_nothing(spark):
    edges, feats = tables(spark, [], [])
    layer = pooling.fit_pooling(edges, feats, 2, steps=3)
    assert layer.losses == [] and pooling.assign(feats, layer).count() == 0 and pooling.pooled_edges(edges, feats, layer).count() == 0
    edges, feats = tables(spark, [], [(1, [1.0, 2.0])])
    layer = pooling.fit_pooling(edges, feats, 2, steps=3)
    assert layer.losses == [] and [r["cluster"] is not None for r in pooling.assign(feats, layer).collect()] == [True] * (layer.weight.shape[0] == 2) + [False] * (layer.weight.shape[0] != 2)
    with pytest.raises(ValueError):
        pooling.fit_pooling(edges, feats, 0)
