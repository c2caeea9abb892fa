"""Neighbour sampling against drawing by hand."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.operators.sampling import bottom_k, sample_neighbours


def ticket(seed, hop, a, b):
    return hashlib.md5(f"{seed}|{hop}|{a}|{b}".encode()).hexdigest()


def by_hand(pairs, seeds, fanouts, seed=0, weights=None):
    near = defaultdict(list)
    for i, (a, b) in enumerate(pairs):
        if a is not None and b is not None and (weights is None or (weights[i] is not None and weights[i] > 0)):
            near[a].append((b, weights[i] if weights else None))
    at, out = set(seeds) - {None}, []
    for hop, k in enumerate(fanouts, 1):
        layer = []
        for a in at:
            def rank(x):
                t = ticket(seed, hop, a, x[0])
                return (t if weights is None else -math.log((int(t[:13], 16) + 0.5) / 16**13) / x[1], x[0])
            layer += [(hop, a, b) for b, _ in sorted(near[a], key=rank)[:k]]
        out += layer
        at = {b for _, _, b in layer}
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(4)
    found = {(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(400)) if a != b} | {(0, b) for b in range(1, 300)}
    return sorted(found | {(b, a) for a, b in found}, key=lambda p: hashlib.md5(repr(p).encode()).digest())


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("seeds, fanouts", [([0, 5, 7, 7, None, 999], [4, 2]), (range(60), [3]), ([0], [10, 3, 2])])
def test_equals_drawing_by_hand(spark, pairs, monkeypatch, few, seeds, fanouts):
    monkeypatch.setattr("weftgraph.operators.sampling.MOST_BROADCAST", few)
    odd = [*pairs, (None, 3), (3, None)]
    edges = spark.createDataFrame([(*p, "x") for p in odd], "src long, dst long, place string").repartition(5)
    got = sample_neighbours(edges, spark.createDataFrame([(s,) for s in seeds], "v long"), fanouts, seed=9)
    assert rows(got) == by_hand(odd, seeds, fanouts, seed=9)


def test_weights(spark):
    r = random.Random(1)
    pairs = [(0, b) for b in range(1, 40)]
    weights = [r.choice([None, 0.0, -1.0, 0.5, 3.0]) for _ in pairs]
    edges = spark.createDataFrame([(*p, w) for p, w in zip(pairs, weights)], "src long, dst long, w double")
    seeds = spark.createDataFrame([(0,)], "v long")
    assert rows(sample_neighbours(edges, seeds, [6], 2, "w")) == by_hand(pairs, [0], [6], 2, weights)
    # in proportion: one of two neighbours, one three times as heavy, drawn for many vertices
    many = spark.range(4000).select(F.col("id").alias("src"), F.explode(F.expr("array(-1L, -2L)")).alias("dst")).withColumn("w", F.when(F.col("dst") == -1, 3.0).otherwise(1.0))
    n = Counter(d for _, _, d in rows(sample_neighbours(many, many.select(F.col("src").alias("v")), [1], 5, "w")))
    assert n[-1] + n[-2] == 4000 and abs(n[-1] / 4000 - 0.75) < 0.03


def test_every_neighbour_is_as_likely(spark):
    edges = spark.range(3000).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(10_000), F.lit(10_009))).alias("dst"))
    n = Counter(d for _, _, d in rows(sample_neighbours(edges, edges.select(F.col("src").alias("v")), [2], 1)))
    assert sum(n.values()) == 6000 and all(abs(c / 600 - 1) < 0.15 for c in n.values())


def test_a_hub_is_cut_before_the_shuffle(spark):
    edges = spark.range(0, 50_000, 1, 8).select(F.pmod("id", F.lit(1)).alias("src"), F.col("id").alias("dst"))
    cut = bottom_k(edges, ["src"], ["dst"], 5)
    plan = cut._jdf.queryExecution().toString()
    assert plan.index("Final", plan.index("Physical Plan")) < plan.index("Exchange", plan.index("Physical Plan")) < plan.index("Partial", plan.index("Physical Plan")), plan
    assert [r["dst"] for r in cut.orderBy("dst").collect()] == [0, 1, 2, 3, 4]


def test_nothing(spark):
    none, seeds = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(1,)], "v long")
    assert rows(sample_neighbours(none, seeds, [2, 2])) == []
    assert rows(sample_neighbours(spark.createDataFrame([(1, 2)], "src long, dst long"), seeds.limit(0), [2])) == []
    for wrong in ([], [0], [2, -1]):
        with pytest.raises(ValueError):
            sample_neighbours(none, seeds, wrong)


def test_same_for_any_order_of_rows(spark, pairs):
    seeds = spark.createDataFrame([(0,), (3,)], "v long")
    a, b = (graph.symmetrize(spark.createDataFrame(p, "src long, dst long").repartition(n)) for p, n in ((pairs, 1), (pairs[::-1], 7)))
    assert rows(sample_neighbours(a, seeds, [5, 5])) == rows(sample_neighbours(b, seeds, [5, 5]))
