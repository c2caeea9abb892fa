"""Graph operators on graphs that can be checked by hand, and invariants."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import build, graph
from weftgraph.operators.components import connected_components
from weftgraph.queries import QUERIES
from weftgraph.streaming.edges import windowed_activity

TWO_TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def two(spark):
    return graph.symmetrize(edges(spark, TWO_TRIANGLES)).cache()


@pytest.fixture(scope="module")
def halves(spark):
    return spark.createDataFrame([(v, v // 3) for v in range(6)], "v long, cluster long")


def test_symmetrize_drops_loops_and_repeats(spark):
    assert rows(graph.symmetrize(edges(spark, [(1, 2), (2, 1), (1, 2), (3, 3)]))) == [(1, 2), (2, 1)]
    assert rows(graph.symmetrize(edges(spark, []))) == []


def test_degree_norm(two):
    d = dict(rows(graph.degree(two)))
    assert d == {0: 2, 1: 2, 2: 3, 3: 3, 4: 2, 5: 2}
    for a, b, w in rows(graph.sym_norm(two)):
        assert w == pytest.approx(1 / math.sqrt(d[a] * d[b]))


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 30)] + [(7, 7), (999, 999)]
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    r.shuffle(pairs)
    assert rows(connected_components(edges(spark, pairs))) == sorted((v, find(v)) for v in root)


def test_components_of_nothing_and_nulls(spark):
    assert rows(connected_components(edges(spark, []))) == []
    assert rows(connected_components(edges(spark, [(1, None), (None, 2), (3, 4)]))) == [(3, 3), (4, 3)]


def test_propagation_and_scores(two, halves):
    found = dict(rows(graph.label_propagation(two, 4)))
    assert set(found) == set(range(6))
    q = graph.modularity(two, halves).first()[0]
    assert q == pytest.approx(12 / 14 - 2 * (7 / 14) ** 2)
    assert rows(graph.conductance(two, halves)) == [(0, pytest.approx(1 / 7)), (1, pytest.approx(1 / 7))]
    assert graph.triangles(two).first()[0] == 2
    assert rows(graph.coarsen(two, halves)) == [(0, 0, 6), (0, 1, 1), (1, 0, 1), (1, 1, 6)]


def test_agreement_ignores_names(spark, halves):
    other = halves.withColumn("cluster", 7 - F.col("cluster"))
    assert tuple(graph.agreement(halves, other).first()) == pytest.approx((1, 1, 1))


def test_means_and_smoothing_keep_constants(spark, two):
    ones = spark.createDataFrame([(v, [1.0, 2.0]) for v in range(6)], "v long, e array<double>")
    feats = graph.features(ones, "v", "e")
    assert {(p, x) for _, p, x in rows(graph.mean_messages(two, feats))} == {(0, 1.0), (1, 2.0)}
    assert graph.smoothed(two, feats, 2).count() == 12


def test_pagerank_sums(two):
    assert graph.pagerank(two, 10).agg(F.sum("rank")).first()[0] == pytest.approx(6)


def test_k_hop_and_core(spark, two):
    assert (0, 3) in rows(graph.k_hop(two, 2)) and (0, 4) not in rows(graph.k_hop(two, 2))
    tail = graph.symmetrize(edges(spark, TWO_TRIANGLES + [(5, 6), (6, 7)]))
    assert rows(graph.core(tail, 2)) == [(v,) for v in range(6)]
    assert rows(graph.core(tail, 5)) == []


def test_louvain_improves_modularity(two):
    found = graph.louvain_level(two)
    single = found.withColumn("cluster", F.col("v"))
    assert graph.modularity(two, found).first()[0] > 0.1 > graph.modularity(two, single).first()[0]
    assert rows(found) == rows(graph.louvain_level(two))


def test_knn_with_ties_and_odd_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 0.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<double>")
    found = rows(build.knn(df, "id", "v", 2, block=2))
    assert [x[:2] for x in found] == [(0, 1), (0, 3), (1, 0), (1, 3), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert rows(build.cosine_pairs(df, "id", "v", 0.9)) == [(0, 1, 1.0), (0, 3, 1.0), (1, 3, 1.0)]


def test_odd_vectors_take_no_part(spark):
    odd = [(6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (9, [1.0]), (10, [1.0, 0.0, 0.0]), (11, []), (None, [1.0, 0.0]), (12, [None, None])]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), *odd], "id long, v array<double>")
    assert [x[:2] for x in rows(build.knn(df, "id", "v", 1))] == [(0, 1), (1, 0), (2, 0)]
    assert rows(build.cosine_pairs(df, "id", "v", 0.9)) == [(0, 1, 1.0)]
    nothing = df.where("id > 99")
    assert rows(build.knn(nothing, "id", "v", 1)) == rows(build.cosine_pairs(nothing, "id", "v", 0.9)) == []


def cliques(n, size):
    """``n`` cliques in a ring, one edge from each to the next."""
    inside = [(c * size + i, c * size + j) for c in range(n) for i in range(size) for j in range(i)]
    return inside + [(c * size, (c + 1) % n * size + 1) for c in range(n)]


@pytest.mark.parametrize("flip", [False, True])
def test_louvain_finds_planted_cliques(spark, flip):
    last = 6 * 5 - 1
    pairs = [(last - a, last - b) if flip else (a, b) for a, b in cliques(6, 5)]
    near = graph.symmetrize(edges(spark, pairs))
    planted = spark.createDataFrame([(v, v // 5) for v in range(30)], "v long, cluster long")
    found = graph.louvain_level(near, rounds=30)
    assert graph.modularity(near, found).first()[0] >= 0.9 * graph.modularity(near, planted).first()[0]
    assert rows(graph.louvain_level(near, rounds=60)) == rows(found)  # it has ended by itself


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables of 300 vectors around ten centres."""
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(10)]
    found = [(i, [x + r.gauss(0, 0.08) for x in centres[i % 10]], i % 10) for i in range(300)]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(found, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, found


def test_kmeans_finds_planted_clusters(spark, planted):
    folder, found = planted
    truth = spark.createDataFrame([(i, c) for i, _, c in found], "v long, cluster long")
    assert graph.agreement(truth, QUERIES["kmeans_embeddings"](spark, folder)).first()["purity"] >= 0.9


def test_power_iteration_keeps_planted_clusters_whole(spark, planted):
    folder, found = planted
    clusters = dict(rows(QUERIES["power_iteration_clustering"](spark, folder)))
    assert set(clusters) == {i for i, _, _ in found} and len(set(clusters.values())) > 1
    whole = [max(Counter(clusters[i] for i, _, c in found if c == k).values()) for k in range(10)]
    assert sum(whole) >= 0.9 * len(found)


def test_clusters_of_embeddings_are_the_planted_ones(spark, planted):
    """A round or a few leave many labels in each planted cluster; it has one when the labels have settled."""
    folder, found = planted
    clusters = dict(rows(QUERIES["cluster_embeddings"](spark, folder)))
    assert set(clusters) == {i for i, _, _ in found}
    assert {frozenset(i for i in clusters if clusters[i] == k) for k in set(clusters.values())} == {frozenset(range(c, 300, 10)) for c in range(10)}


def test_cluster_embeddings_leaves_one_table(spark, planted):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("table-*"))
    assert QUERIES["cluster_embeddings"](spark, planted[0]).count() == 300
    assert len(set(folder.glob("table-*")) - before) == 1


def settled(pairs):
    """Rounds in plain Python until two rounds ago comes again, and their number; the smaller of the labels that a vertex then has."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    before, now, rounds = None, {v: v for v in near}, 0
    while True:
        heard = {v: Counter(now[w] for w in near[v]) for v in near}
        new, rounds = {v: min(n, key=lambda c: (-n[c], c)) for v, n in heard.items()}, rounds + 1
        if new == before:
            return sorted((v, min(now[v], new[v])) for v in new), rounds
        before, now = now, new


def both_ways(pairs):
    return pairs + [(b, a) for a, b in pairs]


@pytest.mark.parametrize("seed", range(3))
def test_settled_labels_against_plain_rounds(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(50)]  # with loops, counted twice, and repeated rows
    pairs += [(100, 101), *((200 + i, 210 + j) for i in range(3) for j in range(4)), *((300, 301 + i) for i in range(9))]  # whose labels swap for ever
    pairs += [(400 + a, 400 + b) for a, b in cliques(6, 5)]
    want, rounds = settled(both_ways(pairs))
    assert rounds > 4 and rows(graph.settled_labels(edges(spark, both_ways(pairs)))) == want
    of = dict(want)
    assert of[100] == of[101] == 100 and {of[v] for v in (200, 201, 202, 210, 211, 212, 213)} == {200} and {of[300 + i] for i in range(10)} == {300}


def test_labels_settle_at_the_end_of_a_chain(spark):
    """On a chain whose names rise the least label goes a step a round: no number of rounds would do for all graphs."""
    pairs = both_ways([(i, i + 1) for i in range(20)])
    want, rounds = settled(pairs)
    assert rounds >= 20 and rows(graph.settled_labels(edges(spark, pairs))) == want == [(v, 0) for v in range(21)]


def test_settled_labels_of_nothing_nulls_and_one_way(spark):
    assert rows(graph.settled_labels(edges(spark, []))) == []
    assert rows(graph.settled_labels(edges(spark, [(1, None), (None, 2), (None, None), (3, 4), (4, 3)]))) == [(3, 3), (4, 3)]
    with pytest.raises(ValueError, match="both directions"):
        graph.settled_labels(edges(spark, [(1, 2), (2, 3), (3, 1)]))


def test_lsh_join_against_brute_force(spark, planted):
    folder, found = planted
    want = {(a, b): math.dist(x, y) for a, x, _ in found for b, y, _ in found if a < b and math.dist(x, y) <= 1.1}
    got = {(a, b): d for a, b, d in rows(QUERIES["lsh_join"](spark, folder))}
    assert set(got) <= set(want) and all(got[p] == pytest.approx(want[p], abs=1e-5) for p in got)
    assert len(got) >= 0.9 * len(want) > 1000


def test_copurchase_counts_groups_once(spark):
    items = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 6), (2, 5), (3, 5), (None, 6), (4, None)], "o long, p long")
    assert rows(build.copurchase(items, "o", "p", 2)) == [(5, 6, 2)]


def test_a_giant_group_is_spread(spark):
    """One group has half of all rows: its pairs are made in many places, and no pair is lost or made twice."""
    r = random.Random(2)
    items = [(0, m) for m in range(150)] + [(g, r.randrange(150)) for g in range(1, 60) for _ in range(3)]
    df = spark.createDataFrame(items, "o long, p long")
    want = Counter()
    for g in range(60):
        own = sorted({m for o, m in items if o == g})
        want.update((a, b) for i, a in enumerate(own) for b in own[i + 1 :])
    assert rows(build.copurchase(df, "o", "p", 1, heavy=16)) == rows(build.copurchase(df, "o", "p", 1)) == sorted((*p, n) for p, n in want.items())


def test_transitions_by_period(spark):
    r = random.Random(5)
    ev = [(r.choice([1, 1, 1, 2, 3, None]), t, r.choice(["a", "b", "c", None])) for t in range(400)]
    df = spark.createDataFrame(ev, "u long, t long, k string").repartition(5)
    by_actor = {}
    for u, _, k in ev:
        by_actor.setdefault(u, []).append(k)
    want = Counter((a, b) for x in by_actor.values() for a, b in zip(x, x[1:]) if b is not None)
    key = lambda x: tuple(map(str, x))
    for period in (None, F.floor(F.col("t") / 7), F.floor(F.col("t") / 150), F.lit(0)):
        got = build.transitions(df, "u", "k", ["t"], period).collect()
        assert sorted(map(tuple, got), key=key) == sorted(((*p, n) for p, n in want.items()), key=key)
    assert build.transitions(df.limit(0), "u", "k", ["t"], F.col("t")).count() == 0


def test_null_ends(spark):
    e = edges(spark, [(1, 2), (2, 1), (None, 1), (2, None), (None, None)])
    assert rows(graph.symmetrize(e)) == [(1, 2), (2, 1)]
    assert dict(graph.degree(e).collect()) == {1: 1, 2: 2, None: 2}
    assert rows(graph.sym_norm(e)) == [(1, 2, pytest.approx(1 / math.sqrt(2))), (2, 1, pytest.approx(1 / math.sqrt(2)))]
    x = graph.features(spark.createDataFrame([(1, [1.0, None]), (2, None), (3, []), (None, [5.0])], "v long, x array<double>"), "v", "x")
    assert x.count() == 3 and rows(graph.mean_messages(e.where("src is not null"), x)) == [(2, 0, 1.0), (2, 1, None)]
    left, right = spark.createDataFrame([(1, 7), (None, 8), (2, None)], "k long, a long"), spark.createDataFrame([(1, 5), (1, 5), (None, 6), (2, 9)], "k2 long, b long")
    assert sorted(map(tuple, build.bipartite(left, right, ("k", "k2"), "a", "b").collect()), key=str) == [(7, 5), (None, 9)]


def test_scores_of_nothing(spark):
    none, labels = edges(spark, []), spark.createDataFrame([], "v long, cluster long")
    assert graph.louvain_level(none).count() == 0 and graph.conductance(none, labels).count() == 0 and graph.coarsen(none, labels).count() == 0
    assert graph.modularity(none, labels).first()[0] is None and graph.agreement(labels, labels).first() is not None


@pytest.mark.parametrize("name", ["degree", "nearest_centroid", "louvain_level", "components", "core_k", "neighbour_sample"])
def test_queries_leave_one_table(spark, name):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("table-*"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(set(folder.glob("table-*")) - before) == 1


def test_transitions(spark):
    ev = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "a")], "u long, t long, k string")
    assert rows(build.transitions(ev, "u", "k", ["t"])) == [("a", "b", 1), ("b", "a", 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows_ = [(f"2024-01-0{1 + i % 3} 00:00:00", i % 4, "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows_, "ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_activity(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("activity")) == rows(windowed_activity(df))
