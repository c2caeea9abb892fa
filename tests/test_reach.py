"""Neighbourhood sizes against counting, personalised PageRank against the exact series."""

import random
from collections import defaultdict

import numpy as np
import pytest

from weftgraph.operators.reach import neighbourhood_sizes, personalised_pagerank


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long").repartition(4)


def graph(seed, n, m):
    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(0, i) for i in range(1, n // 3)}
    return sorted({p for a, b in pairs if a != b for p in ((a, b), (b, a))})


def within(pairs, hops):
    near, out = defaultdict(set), {}
    for a, b in pairs:
        near[a].add(b)
    for v in {v for p in pairs for v in p}:
        seen = {v}
        for hop in range(1, hops + 1):
            seen = seen | {y for x in seen for y in near[x]}
            out[v, hop] = len(seen)
    return out


def test_sizes_of_small_neighbourhoods_are_exact(spark):
    pairs = graph(1, 120, 150)
    odd = [*pairs, (None, 1), (1, None), pairs[0], (5, 5), (999, 0)]
    got = {(r["v"], r["hop"]): r["size"] for r in neighbourhood_sizes(edges(spark, odd), 3).collect()}
    assert got == within([*pairs, (999, 0)], 3)


def test_sizes_of_large_neighbourhoods_are_near(spark):
    pairs = [(i // 100, 1000 + i) for i in range(30_000)] + [(5000 * 1000, i) for i in range(300)]
    got = {(r["v"], r["hop"]): r["size"] for r in neighbourhood_sizes(edges(spark, pairs), 2, 10).collect()}
    want = within(pairs, 2)
    assert set(got) == set(want)
    big = want[5_000_000, 2]
    assert big > 30_000 and abs(got[5_000_000, 2] / big - 1) < 4 * 1.04 / 32
    assert np.mean([abs(got[k] / want[k] - 1) for k in want]) < 0.02


def test_sizes_of_nothing(spark):
    assert neighbourhood_sizes(edges(spark, []), 2).count() == 0
    with pytest.raises(ValueError):
        neighbourhood_sizes(edges(spark, []), 0)


def exact(pairs, seed, alpha):
    names = sorted({v for p in pairs for v in p})
    at = {v: i for i, v in enumerate(names)}
    step = np.zeros((len(names), len(names)))
    for a, b in pairs:
        step[at[b], at[a]] += 1
    degree = step.sum(axis=0)
    now = np.zeros(len(names))
    now[at[seed]] = 1
    total = alpha * np.linalg.solve(np.eye(len(names)) - (1 - alpha) * step / degree, now)
    return dict(zip(names, total)), dict(zip(names, degree))


@pytest.mark.parametrize("epsilon", [1e-2, 1e-4])
def test_ranks_are_short_of_the_exact_ones_by_no_more_than_stated(spark, epsilon):
    pairs = graph(3, 60, 80)
    seeds = [0, 7, 7, None, 777]
    got = {(r["seed"], r["v"]): r["rank"] for r in personalised_pagerank(edges(spark, [*pairs, (None, 2), (2, None)]), spark.createDataFrame([(s,) for s in seeds], "v long"), 0.2, epsilon).collect()}
    assert {s for s, _ in got} == {0, 7, 777} and got[777, 777] == 1.0
    for seed in (0, 7):
        want, degree = exact(pairs, seed, 0.2)
        for v in want:
            short = want[v] - got.get((seed, v), 0.0)
            assert -1e-12 <= short <= epsilon * degree[v] + 1e-12
    if epsilon == 1e-2:
        assert len(got) < 40  # far from the seeds nothing is touched


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "v long")
    assert personalised_pagerank(edges(spark, [(1, 2), (2, 1)]), none).count() == 0
    assert personalised_pagerank(edges(spark, []), none).count() == 0
    for alpha, epsilon in ((0, 1e-3), (1, 1e-3), (0.1, 0)):
        with pytest.raises(ValueError):
            personalised_pagerank(edges(spark, []), none, alpha, epsilon)
