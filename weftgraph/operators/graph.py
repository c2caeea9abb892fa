"""Propagation, clustering and scores over edge tables (src, dst, and a weight where it matters)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import discard, materialize
from weftgraph.plans.workers import map_in_arrow

#: Components of centroids up to which they are broadcast (20 bytes each).
MOST_BROADCAST = 1_000_000


def symmetrize(edges: DataFrame) -> DataFrame:
    """(src, dst): both directions of every edge once, without self-loops. Edges with a null end are left out; an empty table stays empty."""
    one = edges.select("src", "dst").where("src <> dst")
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """(v, degree) of a symmetric edge table: its rows by src, repeated ones and, as null, those without one included."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def sym_norm(edges: DataFrame, loops: bool = False) -> DataFrame:
    """(src, dst, weight): 1 / sqrt(d(src) d(dst)); ``loops``: every vertex also has itself as a neighbour. Edges with a null end, or to a vertex without edges of its own, are left out."""
    if loops:
        v = edges.select("src").distinct()
        edges = edges.union(v.select("src", F.col("src").alias("dst")))
    d = degree(edges)
    a, b = d.toDF("src", "d_a"), d.toDF("dst", "d_b")
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (1 / F.sqrt(F.col("d_a") * F.col("d_b"))).alias("weight"))


def features(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(v, pos, x): vectors in long form. Null and empty vectors have no rows, null components are null."""
    return df.select(F.col(key).alias("v"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))


def mean_messages(edges: DataFrame, feats: DataFrame) -> DataFrame:
    """(v, pos, x): the mean of the neighbours' features that are not null. A vertex without such a neighbour has no rows; null ends meet nothing."""
    sent = edges.join(feats.withColumnRenamed("v", "dst"), "dst")
    return sent.groupBy(F.col("src").alias("v"), "pos").agg(F.avg("x").alias("x"))


def added(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(src, pos, x), a row for each src in order of its first: the sums of x times weight at each position of (src, weight, pos, x). What is null adds nothing; a sum of nulls only is null."""
    code = rows.column("src").dictionary_encode()
    names, pos = code.dictionary, rows.column("pos").flatten().to_numpy()
    x = rows.column("x").flatten()
    there = x.is_valid().to_numpy(zero_copy_only=False)
    size = rows.column("pos").value_lengths().to_numpy()
    place = np.repeat(code.indices.to_numpy().astype(np.int64), size)
    at, pos = np.unique(pos, return_inverse=True)
    cell = place * len(at) + pos
    x = np.where(there, x.fill_null(0.0).to_numpy() * np.repeat(rows.column("weight").to_numpy(), size), 0.0)
    cells, where = np.unique(cell, return_inverse=True) if len(names) * len(at) > 4 * len(cell) else (np.arange(len(names) * len(at)), cell)
    sums, seen, known = (np.bincount(where, w, len(cells)) for w in (x, None, there))
    keep = seen > 0
    row, offsets = cells[keep] // max(len(at), 1), np.zeros(len(names) + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=len(names)), out=offsets[1:])
    lists = [pa.ListArray.from_arrays(pa.array(offsets), v) for v in (pa.array(at[cells[keep] % max(len(at), 1)].astype(np.int32)), pa.array(sums[keep], mask=known[keep] == 0))]
    return pa.RecordBatch.from_arrays([names, *lists], names=["src", "pos", "x"])


def _sums(sent: DataFrame) -> DataFrame:
    """(v, pos, x): ``added`` over (src, weight, pos, x), one row for each src. Every batch is added up before the shuffle, so a hub sends a row for a batch; after it a task holds one batch and one row."""
    kind = f"src {sent.schema['src'].dataType.simpleString()}, pos array<int>, x array<double>"

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield added(batch)

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.append_column("weight", pa.array(np.ones(batch.num_rows)))
            if last is not None:
                batch = pa.concat_batches([last.append_column("weight", pa.array(np.ones(1))).cast(batch.schema), batch])
            sums = added(batch)
            yield sums.slice(0, sums.num_rows - 1)
            last = sums.slice(sums.num_rows - 1)
        if last is not None:
            yield last

    met = map_in_arrow(sent, before, kind).repartition("src").sortWithinPartitions("src")
    return map_in_arrow(met, after, kind).withColumnRenamed("src", "v")


def smoothed(edges: DataFrame, feats: DataFrame, hops: int) -> DataFrame:
    """(v, pos, x): features propagated ``hops`` times over the normalised graph with self-loops.

    A vertex sends its vector whole, not a row for each position.
    """
    w = sym_norm(edges, loops=True)
    whole = feats.where("v is not null").groupBy("v").agg(F.collect_list(F.struct("pos", "x")).alias("all")).select("v", F.col("all.pos").alias("pos"), F.col("all.x").alias("x"))
    for _ in range(hops):
        whole = _sums(w.join(whole.withColumnRenamed("v", "dst"), "dst").select("src", "weight", "pos", "x"))
    return whole.select("v", F.explode(F.arrays_zip("pos", "x")).alias("at")).select("v", "at.pos", "at.x")


def _heard(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, cluster): what is most frequent among the neighbours' labels, ties to the smaller."""
    heard = edges.join(labels.withColumnRenamed("v", "dst"), "dst").groupBy(F.col("src").alias("v"), "cluster").agg(F.count("*").alias("n"))
    return heard.groupBy("v").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(v, cluster): every vertex starts as its own cluster and takes, in each round at once, the most frequent of its neighbours', ties to the smaller."""
    labels = edges.select(F.col("src").alias("v")).distinct().withColumn("cluster", F.col("v"))
    for _ in range(rounds):
        labels = _heard(edges, labels)
    return labels


def settled_labels(edges: DataFrame) -> DataFrame:
    """(v, cluster): ``label_propagation`` of a symmetric edge table for as many rounds as it takes, until the labels are those of two rounds before.

    With both directions of every edge there, that always comes (Poljak and Sura,
    1983): the edges whose ends agree, one as it is and one as it was a round ago,
    grow in number or, at ties, labels get smaller, in every round that changes
    what was two rounds before. From there on a vertex keeps its label or has two
    in turn, as the sides of a bipartite part do; it gets the smaller. The number
    of rounds is the graph's: few where labels meet, as many as steps along a
    chain whose names rise. Edges with a null end take no part, repeated rows
    count repeatedly; an edge without its other direction raises ValueError. The
    result reads a table in the shared folder.
    """
    edges = edges.where("src is not null and dst is not null").select("src", "dst")
    there, back = edges.agg(*[F.sum(F.xxhash64(*ends).cast("decimal(20,0)")) for ends in (("src", "dst"), ("dst", "src"))]).first()
    if there != back:
        raise ValueError("the edges need both directions of each")
    first = edges.select(F.col("src").alias("v")).distinct().withColumn("cluster", F.col("v"))
    now = materialize(first.withColumn("before", F.when(F.lit(False), F.col("v"))))
    while True:
        was = now.select("v", F.col("cluster").alias("before"), F.col("before").alias("older"))
        new = materialize(_heard(edges, now.select("v", "cluster")).join(was, "v").withColumn("moves", ~F.col("cluster").eqNullSafe(F.col("older"))).drop("older"))
        discard(now)
        now = new
        if not now.where("moves").limit(1).count():
            return now.select("v", F.least("before", "cluster").alias("cluster"))


def _ends(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    a, b = clusters.toDF("src", "c_a"), clusters.toDF("dst", "c_b")
    return edges.join(a, "src").join(b, "dst")


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(modularity): Newman's Q of a partition (v, cluster) of a symmetric, unweighted edge table."""
    by = _ends(edges, clusters).groupBy("c_a").agg(F.count("*").alias("vol"), F.count_if(F.col("c_a") == F.col("c_b")).alias("inner"))
    total = by.agg(F.sum("vol").alias("m"), F.sum("inner").alias("i"), F.sum(F.pow(F.col("vol").cast("double"), 2.0)).alias("s"))
    return total.select((F.col("i") / F.col("m") - F.col("s") / F.pow(F.col("m").cast("double"), 2.0)).alias("modularity"))


def conductance(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, conductance): cut over the smaller of the cluster's volume and the rest's."""
    by = _ends(edges, clusters).groupBy(F.col("c_a").alias("cluster")).agg(F.count("*").alias("vol"), F.count_if(F.col("c_a") != F.col("c_b")).alias("cut"))
    m = by.agg(F.sum("vol").alias("m"))
    return by.join(F.broadcast(m), F.lit(True)).select("cluster", (F.col("cut") / F.least("vol", F.col("m") - F.col("vol"))).alias("conductance"))


def triangles(edges: DataFrame) -> DataFrame:
    """(triangles) of a symmetric edge table. Edges point to the end of higher degree, so that hubs do not square."""
    d = degree(edges)
    a, b = d.toDF("src", "d_a"), d.toDF("dst", "d_b")
    up = edges.join(a, "src").join(b, "dst").where("d_a < d_b or (d_a = d_b and src < dst)").select("src", "dst")
    x, y, z = up.toDF("p", "q"), up.toDF("p", "r"), up.toDF("q", "r")
    return x.join(y, "p").where("q <> r").join(z, ["q", "r"]).agg(F.count("*").alias("triangles"))


def contingency(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, n): how many vertices have cluster a in ``left`` and b in ``right``."""
    return left.toDF("v", "a").join(right.toDF("v", "b"), "v").groupBy("a", "b").agg(F.count("*").alias("n"))


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """(purity, nmi, ari) of clustering ``right`` against classes ``left``."""
    t = contingency(left, right)
    by_a, by_b = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    size = t.agg(F.sum("n").alias("s"))
    best = t.groupBy("b").agg(F.max("n").alias("m")).agg(F.sum("m").alias("best"))
    ha = by_a.join(F.broadcast(size), F.lit(True)).agg(F.sum(-F.col("na") / F.col("s") * F.log(F.col("na") / F.col("s"))).alias("ha"), F.sum(pairs("na")).alias("pa"))
    hb = by_b.join(F.broadcast(size), F.lit(True)).agg(F.sum(-F.col("nb") / F.col("s") * F.log(F.col("nb") / F.col("s"))).alias("hb"), F.sum(pairs("nb")).alias("pb"))
    both = t.join(by_a, "a").join(by_b, "b").join(F.broadcast(size), F.lit(True))
    mi = both.agg(F.sum(F.col("n") / F.col("s") * F.log(F.col("n") * F.col("s") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(pairs("n")).alias("pn"))
    all_ = size.join(best).join(ha).join(hb).join(mi)  # one row each
    expected = F.col("pa") * F.col("pb") / pairs("s")
    ari = (F.col("pn") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)
    return all_.select((F.col("best") / F.col("s")).alias("purity"), (2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"), ari.alias("ari"))


def coarsen(edges: DataFrame, clusters: DataFrame, weight: Column | None = None) -> DataFrame:
    """(src, dst, weight): clusters as vertices, weights of the edges between them summed."""
    w = F.lit(1) if weight is None else weight
    return _ends(edges, clusters).groupBy(F.col("c_a").alias("src"), F.col("c_b").alias("dst")).agg(F.sum(w).alias("weight"))


def nearest_centroid(feats: DataFrame, clusters: DataFrame, digits: int = 6) -> DataFrame:
    """(v, cluster): the cluster whose mean has the largest rounded inner product with the vertex, ties to the smaller.

    Centroids are broadcast up to MOST_BROADCAST components, so the features, which
    have few positions to be dealt by, stay where they are. The result reads a
    table in the shared folder.
    """
    feats = materialize(feats)
    means = materialize(feats.join(clusters.toDF("v", "cluster"), "v").groupBy("cluster", "pos").agg(F.avg("x").alias("mean")))
    few = means.count() <= MOST_BROADCAST
    scores = feats.join(F.broadcast(means) if few else means, "pos").groupBy("v", "cluster").agg(F.round(F.sum(F.col("x") * F.col("mean")), digits).alias("score"))
    out = materialize(scores.groupBy("v").agg(F.max_by("cluster", F.struct("score", -F.col("cluster"))).alias("cluster")))
    discard(means)
    discard(feats)
    return out


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(v, rank): ``rounds`` power iterations from 1, not normalised: 1 - damping + damping times what the neighbours pass on."""
    out = degree(edges).toDF("src", "d")
    ranks = out.select(F.col("src").alias("v"), F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        passed = edges.join(out, "src").join(ranks.withColumnRenamed("v", "src"), "src")
        ranks = passed.groupBy(F.col("dst").alias("v")).agg((F.lit(1 - damping) + damping * F.sum(F.col("rank") / F.col("d"))).alias("rank"))
    return ranks


def k_hop(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst): vertices within ``hops`` steps, itself left out."""
    reach = edges.select("src", "dst").distinct()
    for _ in range(hops - 1):
        more = reach.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))
        reach = reach.union(more).where("src <> dst").distinct()
    return reach


def core(edges: DataFrame, k: int) -> DataFrame:
    """(v) of the k-core: vertices of fewer than ``k`` neighbours are peeled off until none is left."""
    now, size = materialize(edges.select("src", "dst")), None
    while True:
        few = degree(now).where(F.col("degree") < k).select("v")
        new = materialize(now.join(few.toDF("src"), "src", "left_anti").join(few.toDF("dst"), "dst", "left_anti").select("src", "dst"))
        n = new.count()
        discard(now)
        now = new
        if n == size or n == 0:
            return now.select(F.col("src").alias("v")).distinct()
        size = n


def louvain_level(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(v, cluster): moves of single vertices by modularity, all of a round at once; deterministic.

    In a round a vertex may only move to a cluster of smaller name in even
    rounds and of larger name in odd ones, so that neighbours do not swap. It
    ends when two rounds in a row, one of each kind, have no moves.
    """
    edges = materialize(edges.select("src", "dst"))
    d = materialize(degree(edges))
    m = float(edges.count() or 1)
    labels, idle = d.select("v", F.col("v").alias("cluster")), 0
    for i in range(rounds):
        volume = labels.join(d, "v").groupBy("cluster").agg(F.sum("degree").alias("vol"))
        near = edges.join(labels.toDF("dst", "cluster"), "dst").groupBy(F.col("src").alias("v"), "cluster").agg(F.count("*").alias("w"))
        own = labels.toDF("v", "own").join(d, "v").join(volume.toDF("own", "vol_own"), "own")
        stay = near.toDF("v", "own", "w_own")
        gain = near.join(volume, "cluster").join(own, "v").join(stay, ["v", "own"], "left").where(F.col("cluster") < F.col("own") if i % 2 == 0 else F.col("cluster") > F.col("own"))
        better = F.col("w") - F.coalesce("w_own", F.lit(0)) - F.col("degree") * (F.col("vol") - (F.col("vol_own") - F.col("degree"))) / F.lit(m)
        moves = gain.select("v", "cluster", better.alias("gain")).where("gain > 1e-9").groupBy("v").agg(F.max_by("cluster", F.struct("gain", -F.col("cluster"))).alias("to"))
        new = materialize(labels.join(moves, "v", "left").select("v", F.coalesce("to", "cluster").alias("cluster"), F.col("to").isNotNull().alias("moved")))
        if i:
            discard(labels)
        labels, idle = new.select("v", "cluster"), 0 if new.where("moved").limit(1).count() else idle + 1
        if idle == 2:
            break
    out = labels if rounds else materialize(labels)
    discard(edges)
    discard(d)
    return out
