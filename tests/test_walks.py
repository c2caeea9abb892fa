"""Biased walks: replayed in plain Python, and their steps' frequencies against the exact probabilities."""

import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.operators.walks import CELLS, DRAWS, numbered_neighbours, random_walks


def h(*values):
    seed = 42
    for v, kind in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed)
    return seed


def uniform(*values):
    return (h(*values) >> 12) / 2.0**52


def neighbours(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None:
            near[a].add(b)
    signed = lambda x: x - (x >> 63 << 64)
    return {v: sorted(x, key=lambda u: (signed(h((u, "q"))) % CELLS, u)) for v, x in near.items()}


def replay(pairs, starts, length, walks, p, q, seed):
    near, out = neighbours(pairs), []
    most = max(1.0, 1 / p, 1 / q)
    for start in sorted(set(starts) - {None}):
        for walk in range(1, walks + 1):
            u, v = None, start
            out.append((start, walk, 0, v))
            for step in range(1, length + 1):
                if v not in near:
                    break
                for draw in range(10_000):
                    key = [(seed, "i"), (start, "q"), (walk, "i"), (step, "i"), (draw, "i")]
                    x = near[v][int(uniform(*key, (0, "i")) * len(near[v]))]
                    weight = most if u is None else 1 / p if x == u else 1.0 if x in near.get(u, ()) else 1 / q
                    if uniform(*key, (1, "i")) * most < weight:
                        break
                u, v = v, x
                out.append((start, walk, step, v))
    return sorted(out)


GRAPH = sorted({e for a, b in [(0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (0, 6), (6, 7), (6, 8), *((0, 20 + i) for i in range(70))] for e in ((a, b), (b, a))} | {(5, 99)})


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long").repartition(5)


def test_numbers_without_gaps(spark):
    got = defaultdict(dict)
    for r in numbered_neighbours(edges(spark, [*GRAPH, *GRAPH[:9], (None, 1), (1, None)])).collect():
        assert r["at"] not in got[r["src"]]
        got[r["src"]][r["at"]] = r["dst"]
    assert {v: [x[i] for i in range(len(x))] for v, x in got.items()} == neighbours(GRAPH)


@pytest.mark.parametrize("p, q", [(0.25, 4.0), (1.0, 1.0), (5.0, 0.5)])
def test_replayed(spark, p, q):
    starts = [0, 3, 5, 5, None, 99, 777]
    got = random_walks(edges(spark, [*GRAPH, GRAPH[0], (None, 4)]), spark.createDataFrame([(s,) for s in starts], "v long"), 5, 6, p, q, seed=11)
    assert sorted(map(tuple, got.collect())) == replay(GRAPH, starts, 5, 6, p, q, 11)


def test_steps_have_the_stated_probabilities(spark):
    p, q = 0.5, 2.0
    pairs = [e for e in GRAPH if max(e) < 20]
    near = neighbours(pairs)
    got = random_walks(edges(spark, pairs), spark.createDataFrame([(1,), (0,)], "v long"), 2, 6000, p, q, seed=3)
    by = got.groupBy("start", "walk").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "v"))), lambda s: s["v"]).alias("path"))
    paths = Counter(tuple(r["path"]) for r in by.collect())
    assert sum(paths.values()) == 12_000
    for start in (0, 1):
        for v in near[start]:
            seen = {k[2]: n for k, n in paths.items() if k[:2] == (start, v)}
            weight = {x: 1 / p if x == start else 1.0 if x in near[start] else 1 / q for x in near[v]}
            total = sum(seen.values())
            assert abs(total / 6000 - 1 / len(near[start])) < 0.03 and set(seen) <= set(weight)
            for x, w in weight.items():
                assert abs(seen.get(x, 0) / total - w / sum(weight.values())) < 0.05


def test_nothing(spark):
    some, none = spark.createDataFrame([(1,)], "v long"), spark.createDataFrame([], "v long")
    assert [tuple(r) for r in random_walks(edges(spark, []), some, 3).collect()] == [(1, 1, 0, 1)]
    assert random_walks(edges(spark, GRAPH), none, 2).count() == 0 and DRAWS > 1
    for wrong in (dict(length=0), dict(length=1, walks=0), dict(length=1, p=0), dict(length=1, q=-1)):
        with pytest.raises(ValueError):
            random_walks(edges(spark, GRAPH), some, **wrong)
