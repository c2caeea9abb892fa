"""Blocks of vectors that meet: nearest neighbours and pairs in shared buckets, against brute force."""

import numpy as np
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.sql import functions as F

from weftgraph.operators import build, graph
from weftgraph.queries import QUERIES, _ml_vectors

SF = "/root/testdata/sf0.001"


def nearest(ids, v, k, digits=6):
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    cosines = np.round(unit @ unit.T, digits)
    out = []
    for i in range(len(ids)):
        others = sorted((-cosines[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])
        out += [(ids[i], j, -w) for w, j in others[:k]]
    return sorted(out)


def awkward(n=700):
    """Random vectors, of which many are copies or nearly so, some are scaled copies, and some share an id."""
    g = np.random.default_rng(4)
    v = g.standard_normal((n, 12)).astype(np.float32)
    v[50:250] = v[3]
    v[250:300] = v[4] * np.float32(2)
    v[300:400] = v[5] + (1e-6 * g.standard_normal((100, 12))).astype(np.float32)
    ids = g.permutation(n) * 3
    ids[-4:] = ids[-5]
    return ids.astype(np.int64), v.astype(float)


@pytest.mark.parametrize("chunk, tile", [(16, 8), (64, 512), (2048, 100)])
def test_nearest_of_several_blocks(monkeypatch, chunk, tile):
    monkeypatch.setattr(build, "CHUNK", chunk)
    monkeypatch.setattr(build, "TILE", tile)
    ids, v = awkward()
    blocks = [build.Block(ids[i::3], v[i::3], np.zeros((len(ids[i::3]), 0), np.int64)) for i in range(3)]
    found = []
    for own in blocks:
        best = build.Nearest(own, 5, 6)
        for other in blocks:
            list(best.meet(other, own is other))
        rows = [r for columns in best.end() for r in zip(*(c.tolist() for c in columns))]
        assert len(rows) == 5 * len(own.ids)  # what is kept of a vector doesn't grow with the blocks it met
        found += rows
    assert sorted(found) == nearest(ids.tolist(), v, 5)


def test_copies_are_passed_in_single_precision(monkeypatch):
    """Of ever so many copies only the first few of a block are scored."""
    scored = []
    cosines = build.Block.cosines
    monkeypatch.setattr(build.Block, "cosines", lambda self, r, *a: (scored.append(len(r)), cosines(self, r, *a))[1])
    monkeypatch.setattr(build, "CHUNK", 64)
    block = build.Block(np.arange(4096), np.tile([1.0, 2.0, 3.0], (4096, 1)), np.zeros((4096, 0), np.int64))
    best = build.Nearest(block, 4, 6)
    list(best.meet(block, True))
    assert (best.weight == 1).all() and best.id[9].tolist() == [0, 1, 2, 3] and best.id[2].tolist() == [0, 1, 3, 4]
    assert sum(scored) < 4096 * 200


def test_knn_over_many_blocks(spark):
    ids, v = awkward()
    df = spark.createDataFrame([(i, x) for i, x in zip(ids.tolist(), v.tolist())], "id long, x array<float>").repartition(5)
    for block in (40, 16384):
        got = sorted(tuple(r) for r in build.knn(df, "id", "x", 5, block=block).collect())
        want = [r for r in nearest(ids.tolist(), v, 5) if r[0] != ids[-1]]
        assert [r for r in got if r[0] != ids[-1]] == want  # rows that share an id are listed together
        assert sum(r[0] == ids[-1] for r in got) == 5


def brute(ids, v, hashes, radius):
    near = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) < radius
    share = (hashes[:, None] == hashes[None]).any(2)
    return sorted((ids[i], ids[j]) for i, j in np.argwhere(near & share).tolist() if ids[i] < ids[j])


@pytest.mark.parametrize("block, spread", [(30, 1), (16384, 1), (30, 40)])
def test_pairs_in_shared_buckets(spark, block, spread):
    """Few large buckets and many small ones; no pair is lost or made twice; zero vectors and lengths of all sizes."""
    ids, v = awkward(400)
    ids = np.arange(len(ids))
    v[::50] = 0
    v[7] *= 1000
    hashes = np.floor(v[:, :3] * spread).astype(np.int64)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())] + [(900, None), (901, [1.0]), (902, [float("nan")] * 12), (None, [1.0] * 12)], "id long, x array<double>")
    buckets = lambda rows: rows.withColumn("hashes", F.array(*[F.floor(F.col("v")[i] * spread) for i in range(3)]))
    got = build.bucket_pairs(df, "id", "x", buckets, 2.5, block=block).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == brute(ids.tolist(), v, hashes, 2.5)
    assert all(r["distance"] == pytest.approx(np.linalg.norm(v[r["src"]] - v[r["dst"]]), abs=1e-9) for r in got)
    assert build.bucket_pairs(df.limit(0), "id", "x", buckets, 2.5).collect() == []


def test_lsh_join_is_the_library_join_without_its_rows_for_pairs(spark):
    rows = _ml_vectors(spark, SF)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=2.0, numHashTables=3, seed=1).fit(rows)
    want = model.approxSimilarityJoin(rows, rows, 1.1, "distance").where("datasetA.v < datasetB.v").select("datasetA.v", "datasetB.v", F.round("distance", 6))
    found = QUERIES["lsh_join"](spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")  # buckets are joined with their sizes; candidates are no rows of a join


def test_smoothing_sends_vectors_whole(spark):
    """Nulls, missing positions, a hub over many batches; held against plain sums. No join or shuffle has a row for each position."""
    g = np.random.default_rng(6)
    pairs = {(0, i) for i in range(1, 400)} | {tuple(sorted(p)) for p in g.integers(0, 400, (600, 2)).tolist() if p[0] != p[1]}
    edges = graph.symmetrize(spark.createDataFrame(sorted(pairs), "src long, dst long"))
    feats = {(v, p): (None if g.random() < 0.1 else float(g.normal())) for v in range(0, 400) for p in (0, 1, 5000000) if g.random() < 0.8}
    near = {v: {v} for v in range(400)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    near = {v: n for v, n in near.items() if len(n) > 1}
    want = feats
    for _ in range(2):
        sums = {}
        for v, n in near.items():
            for u in n:
                for p in (0, 1, 5000000):
                    if (u, p) in want:
                        x = want[u, p]
                        old = sums.setdefault((v, p), None)
                        if x is not None:
                            sums[v, p] = (old or 0.0) + x / (len(n) * len(near[u])) ** 0.5
        want = sums
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([(v, p, x) for (v, p), x in feats.items()] + [(None, 0, 1.0)], "v long, pos int, x double")
        found = graph.smoothed(edges, df, 2)
        got = {(r["v"], r["pos"]): r["x"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # rows by position come last
