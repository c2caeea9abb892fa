"""Leiden levels: replayed in plain Python, connected, modularity not falling, planted clusters found."""

import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from weftgraph.operators import graph
from weftgraph.operators.leiden import connected, leiden


def coin(*values):
    seed = 42
    for v, kind in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed)
    return (seed - (seed >> 63 << 64)) % 2


def quality(e, of):
    total, inner, vol = 0, 0, Counter()
    for (a, b), w in e.items():
        total += w
        inner += w * (of[a] == of[b])
        vol[of[a]] += w
    return inner / total - sum(x * x for x in vol.values()) / total**2


def pulls(e, of):
    out = defaultdict(Counter)
    for (a, b), w in e.items():
        if a != b:
            out[a][of[b]] += w
    return out


def best(gains):
    return {v: -max(x)[1] for v, x in gains.items()}


def replay(edges, levels=10, rounds=10, refinements=4, seed=0):
    first = Counter()
    for a, b, w in edges:
        if a is not None and b is not None and w is not None and w > 0:
            first[a, b] += w
    total, e, at = sum(first.values()), first, None
    of = {a: a for a, _ in first}
    q = quality(e, of) if total else 0
    for level in range(levels if total else 0):
        degree = Counter()
        for (a, _), w in e.items():
            degree[a] += w
        now, idle = dict(of), 0
        for i in range(rounds):
            vol, pull, gains = Counter(), pulls(e, now), defaultdict(list)
            for v, c in now.items():
                vol[c] += degree[v]
            for v, x in pull.items():
                own = now[v]
                for c, w in x.items():
                    if (c < own if i % 2 == 0 else c > own) and (g := float(total) * float(w - x.get(own, 0)) - float(degree[v]) * float(vol[c] - (vol[own] - degree[v]))) > 0:
                        gains[v].append((g, -c))
            to = best(gains)
            now, idle = now | to, 0 if to else idle + 1
            if idle == 2:
                break
        if quality(e, now) <= q:
            break
        of, q = now, quality(e, now)
        part = {v: v for v in of}
        inner = {(a, b): w for (a, b), w in e.items() if of[a] == of[b]}
        for i in range(refinements):
            stay = {v: coin((v, "q"), (seed + level, "i"), (i, "i")) == 0 for v in of}
            vol, members, gains = Counter(), defaultdict(list), defaultdict(list)
            for v, p in part.items():
                vol[p] += degree[v]
                members[p].append(v)
            for v, x in pulls(inner, part).items():
                if len(members[part[v]]) == 1 and not stay[v]:
                    for p, w in x.items():
                        if p != part[v] and (len(members[p]) > 1 or stay[members[p][0]]) and (g := float(total) * float(w) - float(degree[v]) * float(vol[p])) > 0:
                            gains[v].append((g, -p))
            part |= best(gains)
        if all(v == p for v, p in part.items()):
            break
        wider = Counter()
        for (a, b), w in e.items():
            wider[part[a], part[b]] += w
        upper = {p: min(of[v] for v in of if part[v] == p) for p in set(part.values())}
        at = part if at is None else {v: part[c] for v, c in at.items()}
        e, of = wider, upper
    whole = of if at is None else {v: of[c] for v, c in at.items()}
    return split(first, whole)


def split(e, of):
    near = defaultdict(set)
    for a, b in e:
        if of[a] == of[b]:
            near[a].add(b)
    out = {}
    for v in sorted(of):
        if v not in out:
            stack = [v]
            while stack:
                x = stack.pop()
                if x not in out:
                    out[x] = v
                    stack += near[x]
    return out


def planted(seed, clusters, size, inner, outer):
    r = random.Random(seed)
    names = r.sample(range(10_000), clusters * size)
    pairs = set()
    for i in range(len(names)):
        for j in range(i):
            if r.random() < (inner if i // size == j // size else outer):
                pairs |= {(names[i], names[j]), (names[j], names[i])}
    return sorted(pairs), {names[i]: i // size for i in range(len(names))}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, weight long").repartition(3)


def found(df):
    return {r["v"]: r["cluster"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_replayed(spark, seed):
    pairs, _ = planted(seed, 6, 12, 0.45, 0.04)
    r = random.Random(seed)
    weights = {}
    edges = [(a, b, weights.setdefault((min(a, b), max(a, b)), r.randint(1, 4))) for a, b in pairs]
    edges += [edges[0], edges[0][1::-1] + edges[0][2:], (None, 1, 1), (1, None, 1), (1, 2, None), (pairs[0][0], pairs[0][0], 3)]
    got = found(leiden(frame(spark, edges), levels=4, rounds=5, refinements=3, seed=7))
    assert got == replay(edges, 4, 5, 3, 7)


def test_planted_clusters(spark):
    pairs, of = planted(5, 8, 20, 0.5, 0.02)
    edges = [(a, b, 1) for a, b in pairs]
    got = found(leiden(frame(spark, edges)))
    e = {(a, b): 1 for a, b in pairs}
    assert split(e, got) == got  # connected, named by the smallest
    assert quality(e, got) >= quality(e, of) - 0.02
    one = found(graph.louvain_level(frame(spark, edges)))
    assert quality(e, got) >= quality(e, one) - 1e-9
    both = Counter((of[v], c) for v, c in got.items())
    assert sum(max(n for (x, _), n in both.items() if x == c) for c in range(8)) / len(of) > 0.9


def test_clusters_in_pieces_are_divided(spark):
    edges = [(a, b, 1) for p in [(1, 2), (3, 4), (4, 5), (2, 3)] for a, b in (p, p[::-1])]
    labels = spark.createDataFrame([(1, 9), (2, 9), (3, 8), (4, 9), (5, 9)], "v long, cluster long")
    assert found(connected(frame(spark, edges), labels)) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_small_and_empty(spark):
    assert found(leiden(frame(spark, []))) == {}
    two = [(a, b, 1) for p in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)] for a, b in (p, p[::-1])]
    assert found(leiden(frame(spark, two))) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert found(leiden(frame(spark, [(1, 1, 4)]))) == {1: 1}
    assert found(leiden(frame(spark, two).drop("weight"))) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
