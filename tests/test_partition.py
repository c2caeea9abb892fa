"""Balanced partitioning: replayed in plain Python, and held against planted parts."""

import math
import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.operators import graph, partition
from weftgraph.operators.partition import balanced_partition


def h(*values):
    seed = 42
    for v, kind in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed)
    return seed - (seed >> 63 << 64)


def replay_match(near, size, limit):
    """near: {v: {u: w}} of all vertices with edges."""
    free, to = set(size), {v: v for v in size}
    for _ in range(partition.PROPOSALS):
        best = {}
        for a in free:
            found = [(w, h((min(a, b), "q"), (max(a, b), "q")), min(a, b), max(a, b), b) for b, w in near.get(a, {}).items() if b in free and size[a] + size[b] <= limit]
            if found:
                best[a] = max(found)[-1]
        pairs = [(a, b) for a, b in best.items() if a < b and best.get(b) == a]
        if not pairs:
            break
        for a, b in pairs:
            to[b] = a
            free -= {a, b}
    if len(free) > partition.UNMATCHED * len(size):
        hubs = defaultdict(list)
        for v in free:
            hubs[max(((w, -u, u) for u, w in near.get(v, {}).items()), default=(0, 0, None))[-1]].append(v)
        for vs in hubs.values():
            chunks, groups = math.ceil(2 * sum(size[v] for v in vs) / limit), defaultdict(list)
            for v in vs:
                groups[h((v, "q")) % chunks].append(v)
            for g in groups.values():
                if len(g) > 1 and sum(size[v] for v in g) <= limit:
                    to |= dict.fromkeys(g, min(g))
    return to


def merge(near, size, to):
    fewer, wider = Counter(), defaultdict(Counter)
    for v, n in size.items():
        fewer[to[v]] += n
    for a, x in near.items():
        for b, w in x.items():
            if to[a] != to[b]:
                wider[to[a]][to[b]] += w
    return wider, fewer


def cut(near, of):
    return sum(w for a, x in near.items() for b, w in x.items() if a < b and of[a] != of[b])


def replay_refine(near, size, of, most, rounds):
    now, idle = dict(of), 0
    for i in range(rounds):
        wanted = defaultdict(list)
        for a in near:
            pull = Counter()
            for b, w in near[a].items():
                pull[now[b]] += w
            found = [(w - pull[now[a]], -p) for p, w in pull.items() if (p > now[a] if i % 2 == 0 else p < now[a]) and w > pull[now[a]]]
            if found:
                gain, p = max(found)
                wanted[-p, math.floor(math.log2(gain)), h((a, "q"), (i, "i")) % partition.SLOTS].append(a)
        full, moved, taken = Counter(), False, Counter()
        for v, p in now.items():
            full[p] += size[v]
        new = dict(now)
        for (p, power, slot), vs in sorted(wanted.items(), key=lambda x: (x[0][0], -x[0][1], x[0][2])):
            taken[p] += sum(size[v] for v in vs)
            if full[p] + taken[p] <= most:
                moved = True
                new |= dict.fromkeys(vs, p)
        now, idle = new, 0 if moved else idle + 1
        if idle == 2:
            break
    return now if cut(near, now) < cut(near, of) else of


def replay(pairs, parts, slack, rounds=8, also=()):
    one = Counter()
    for a, b, w in pairs:
        if a is not None and b is not None and a != b and w:
            one[a, b] += w
    near = defaultdict(dict)
    for a, b in one:
        w = max(one[a, b], one.get((b, a), 0))
        if w > 0:
            near[a][b] = near[b][a] = w
    size = dict.fromkeys([*near, *also], 1)
    n = len(size)
    most, limit, few, levels = max(1, math.ceil(n * (1 + slack) / parts)), max(1, int(slack * n / parts / 2)), math.ceil(4 * parts / slack), []
    while len(size) > few and limit > 1:
        to = replay_match(near, size, limit)
        wider, fewer = merge(near, size, to)
        if len(fewer) > (1 - partition.SHRINK) * len(size):
            if len(size) <= 2 * few:
                break
            to = replay_match({}, size, limit)
            wider, fewer = merge(near, size, to)
        levels.append((near, size, to))
        near, size = wider, fewer
    heavy = {v: sorted(sorted(x.items(), key=lambda e: (-e[1], e[0]))[: partition.HEAVIEST]) for v, x in near.items()}
    of = replay_refine(near, size, partition.grow(size, heavy, parts, most), most, rounds)
    for near, size, to in reversed(levels):
        of = replay_refine(near, size, {v: of[to[v]] for v in size}, most, rounds)
    return of


def planted(seed, clusters, size, inner, outer):
    r = random.Random(seed)
    n = clusters * size
    names = list(range(n))
    r.shuffle(names)
    pairs = []
    for i in range(n):
        for _ in range(inner):
            j = i // size * size + r.randrange(size)
            pairs.append((names[i], names[j]))
        for _ in range(outer):
            pairs.append((names[i], names[r.randrange(n)]))
    return [p for p in pairs if p[0] != p[1]], {names[i]: i // size for i in range(n)}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long, weight long")


def parts_of(df):
    return {r["v"]: r["part"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_replayed(spark, seed):
    pairs, _ = planted(seed, 6, 60, 4, 1)
    r = random.Random(seed)
    weighted = [(a, b, r.randint(1, 5)) for a, b in pairs] + [(pairs[0][0], pairs[0][1], 9), (1, 1, 7), (None, 2, 3), (3, None, 1), (4, 5, None), (5, 6, 0)]
    got = parts_of(balanced_partition(frame(spark, weighted).repartition(3), 3, slack=0.3, rounds=4))
    assert got == replay(weighted, 3, 0.3, 4)


def test_star_and_loose_vertices_replayed(spark):
    star = [(0, i, 1) for i in range(1, 250)]
    loose = list(range(1000, 1150))
    got = parts_of(balanced_partition(frame(spark, star), 2, slack=0.2, rounds=2, vertices=spark.createDataFrame([(v,) for v in [*loose, None]], "v long")))
    assert got == replay(star, 2, 0.2, 2, loose)
    assert set(got) == set(range(250)) | set(loose) and max(Counter(got.values()).values()) <= math.ceil(400 * 1.2 / 2)


@pytest.mark.parametrize("clusters, size, parts", [(8, 40, 8), (12, 30, 4)])
def test_planted_parts(spark, clusters, size, parts):
    pairs, of = planted(3, clusters, size, 8, 1)
    e = frame(spark, [(a, b, 1) for a, b in pairs])
    got = parts_of(balanced_partition(e, parts, slack=0.1))
    sizes = Counter(got.values())
    assert len(got) == clusters * size and max(sizes.values()) <= math.ceil(1.1 * len(got) / parts) and len(sizes) == parts
    near = defaultdict(Counter)
    for a, b in {(min(p), max(p)) for p in pairs}:
        near[a][b] = near[b][a] = 1
    best = cut(near, of)
    labels = {r["v"]: r["cluster"] for r in graph.label_propagation(graph.symmetrize(e), 6).collect()}
    if parts == clusters:
        assert cut(near, got) <= 1.1 * best and cut(near, got) <= 1.1 * max(best, cut(near, labels))
    else:
        assert cut(near, got) <= 1.1 * best  # whole clusters go together
    shuffled = list(got.values())
    random.Random(0).shuffle(shuffled)
    assert cut(near, got) < 0.5 * cut(near, dict(zip(got, shuffled)))


def test_small_and_empty(spark):
    assert parts_of(balanced_partition(frame(spark, []), 4)) == {}
    two = parts_of(balanced_partition(frame(spark, [(1, 2, 1)]), 4))
    assert set(two) == {1, 2}
    triangles = [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 1)]
    got = parts_of(balanced_partition(frame(spark, triangles).drop("weight"), 2))
    assert got[0] == got[1] == got[2] != got[3] == got[4] == got[5]
    assert set(parts_of(balanced_partition(frame(spark, triangles), 1)).values()) == {0}
    for parts, slack in ((0, 0.1), (1000, 0.1), (2, 0)):
        with pytest.raises(ValueError):
            balanced_partition(frame(spark, triangles), parts, slack)


def test_intermediate_tables_go(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("table-*"))
    pairs, _ = planted(5, 4, 60, 4, 1)
    out = balanced_partition(frame(spark, [(a, b, 1) for a, b in pairs]), 2, slack=0.3, rounds=2)
    assert out.count() == 240 and len(set(folder.glob("table-*")) - before) == 1


def test_more_vertices_than_are_broadcast_replayed(spark, monkeypatch):
    monkeypatch.setattr(partition, "MOST_BROADCAST", 0)
    pairs, _ = planted(2, 4, 40, 4, 1)
    weighted = [(a, b, 1 + (a + b) % 3) for a, b in pairs]
    got = parts_of(balanced_partition(frame(spark, weighted), 2, slack=0.3, rounds=2))
    assert got == replay(weighted, 2, 0.3, 2)


def shuffled(spark, first):
    """Records that the stages of this session from number ``first`` on have written to shuffles, and the number after the last."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10000)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    mine = [stages.apply(i) for i in range(stages.size()) if stages.apply(i).stageId() >= first]
    return sum(x.shuffleWriteRecords() for x in mine), max((x.stageId() for x in mine), default=first - 1) + 1


def test_edges_stay_where_they_are(spark):
    """A round shuffles sums by vertex and part, no edges: with tables too large for Spark to broadcast of its own accord, less is shuffled than ten times the edges, however many rounds."""
    r = random.Random(4)
    pairs = {(min(p), max(p)) for p in ((r.randrange(300), r.randrange(300)) for _ in range(40_000)) if p[0] != p[1]}
    e = frame(spark, [(a, b, 1) for a, b in pairs]).repartition(3)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for x in names:
            spark.conf.set(x, "-1")
        _, first = shuffled(spark, 0)
        balanced_partition(e, 8, slack=0.1, rounds=6).count()
        records, _ = shuffled(spark, first)
    finally:
        for x in names:
            spark.conf.unset(x)
    assert records < 10 * 2 * len(pairs)
