"""Leiden clustering: levels of moves by modularity, with a refinement that keeps clusters connected (Traag et al., 2019).

Moves are synchronous and deterministic: all of a round at once, up and down the
clusters' names in turn, so that neighbours do not swap. All quantities are whole
numbers until they are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import connected_components
from weftgraph.operators.graph import coarsen
from weftgraph.plans.lineage import discard, materialize


def _gain(total: int, w: Column, w_own: Column, degree: Column, vol: Column, vol_own: Column) -> Column:
    """Total times what modularity gains, up to a factor, by a move to a cluster of volume ``vol``, to which ``w`` of a vertex's weight leads."""
    return F.lit(float(total)) * (w - w_own).cast("double") - degree.cast("double") * (vol - (vol_own - degree)).cast("double")


def modularity_of(edges: DataFrame, labels: DataFrame, total: int) -> float:
    """Newman's Q of (v, cluster) over weighted edges, both directions and loops included, whose weights add up to ``total``. The sums are exact."""
    of = labels.select("v", "cluster")
    ends = edges.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst")
    by = ends.groupBy("a").agg(F.sum("weight").alias("vol"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0)).alias("inner"))
    row = by.agg(F.sum("inner").alias("i"), F.sum(F.col("vol").cast("decimal(19,0)") * F.col("vol").cast("decimal(19,0)")).alias("s")).first()
    return 0.0 if row["i"] is None else row["i"] / total - int(row["s"]) / total**2


def _pulls(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, cluster, w): how much of each vertex's weight leads to each cluster, its loop left out."""
    return edges.where("src <> dst").join(labels.select(F.col("v").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("v"), "cluster").agg(F.sum("weight").alias("w"))


def _best(gains: DataFrame) -> DataFrame:
    return gains.where("gain > 0").groupBy("v").agg(F.max(F.struct("gain", (-F.col("cluster")).alias("minus"))).alias("m")).select("v", (-F.col("m.minus")).alias("to"))


def _relabelled(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return materialize(labels.join(moves, "v", "left").select("v", F.coalesce("to", "cluster").alias("cluster"), F.col("to").isNotNull().alias("moved")))


def moved(edges: DataFrame, degrees: DataFrame, labels: DataFrame, total: int, rounds: int) -> DataFrame:
    """(v, cluster) after rounds of moves to the neighbouring cluster of largest gain, ties to the smaller name. Ends after a round of each kind without moves."""
    now, idle = materialize(labels.select("v", "cluster")), 0
    for i in range(rounds):
        of = now.select("v", "cluster")
        volume = of.join(degrees, "v").groupBy("cluster").agg(F.sum("degree").alias("vol"))
        pulls = _pulls(edges, of)
        own = of.toDF("v", "own").join(degrees, "v").join(volume.toDF("own", "vol_own"), "own").join(pulls.toDF("v", "own", "w_own"), ["v", "own"], "left")
        may = pulls.join(volume, "cluster").join(own, "v").where(F.col("cluster") < F.col("own") if i % 2 == 0 else F.col("cluster") > F.col("own"))
        gain = _gain(total, F.col("w"), F.coalesce("w_own", F.lit(0)), F.col("degree"), F.col("vol"), F.col("vol_own"))
        new = _relabelled(of, _best(may.select("v", "cluster", gain.alias("gain"))))
        discard(now)
        now, idle = new, 0 if new.where("moved").limit(1).count() else idle + 1
        if idle == 2:
            break
    return now.select("v", "cluster")


def refined(edges: DataFrame, degrees: DataFrame, labels: DataFrame, total: int, rounds: int, seed: int) -> DataFrame:
    """(v, cluster): parts of the clusters of ``labels``, each connected.

    Every vertex starts alone. In a round a hash draws those who stay; a vertex
    alone that does not stay joins the part of its cluster, of one who stays or of
    several already, with the largest gain. Whoever has been joined never leaves,
    so a part is held together by the edges along which it grew.
    """
    inner = materialize(edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", "weight"))
    now = materialize(labels.select("v", F.col("v").alias("cluster")))
    for i in range(rounds):
        of = now.select("v", "cluster")
        stays = F.pmod(F.xxhash64("v", F.lit(seed), F.lit(i)), F.lit(2)) == 0
        parts = of.join(degrees, "v").groupBy("cluster").agg(F.sum("degree").alias("vol"), F.count("*").alias("n"), F.max(stays).alias("stay"))
        alone = of.where(~stays).join(parts.where("n = 1").select("cluster", "vol"), "cluster").select("v", F.col("vol").alias("degree"))
        open_ = parts.where("n > 1 or stay").select("cluster", "vol")
        may = _pulls(inner, of).join(alone, "v").join(open_, "cluster")
        none = F.lit(0)
        gain = _gain(total, F.col("w"), none, F.col("degree"), F.col("vol"), F.col("degree"))
        new = _relabelled(of, _best(may.select("v", "cluster", gain.alias("gain"))))
        discard(now)
        now = new
    discard(inner)
    return now.select("v", "cluster")


def connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, cluster) with clusters divided into their connected parts, each named by its smallest vertex; modularity does not fall."""
    inner = edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").where("a = b and src <> dst")
    parts = connected_components(inner)
    out = materialize(labels.select("v").join(parts, "v", "left").select("v", F.coalesce("component", "v").alias("cluster")))
    discard(parts)
    return out


def leiden(edges: DataFrame, levels: int = 10, rounds: int = 10, refinements: int = 4, seed: int = 0) -> DataFrame:
    """(v, cluster): clusters of high modularity, each connected and named by its smallest vertex.

    ``edges``: (src, dst) and optionally a whole-numbered weight, both directions
    of each; repeated rows add up, null ends and weights not above zero take no
    part, a loop counts once in its vertex's degree. Each level moves vertices
    between clusters, refines these, and makes the refined parts the vertices of
    the next level, which starts from the clusters found. A level that does not
    raise modularity is not taken and ends the levels. Deterministic; an empty
    graph has no rows. Pulls and volumes are sums, combined before every shuffle,
    so a hub or a giant cluster is never in one task. The result reads a table in
    the shared folder.
    """
    w = F.col("weight").cast("bigint") if "weight" in edges.columns else F.lit(1).cast("bigint")
    first = materialize(edges.where("src is not null and dst is not null").select("src", "dst", w.alias("weight")).where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    total = first.agg(F.sum("weight")).first()[0] or 0
    e, at = first, None
    labels = materialize(first.select(F.col("src").alias("v")).distinct().withColumn("cluster", F.col("v")))
    quality = modularity_of(e, labels, total) if total else 0.0
    for level in range(levels if total else 0):
        degrees = materialize(e.groupBy(F.col("src").alias("v")).agg(F.sum("weight").alias("degree")))
        new = moved(e, degrees, labels, total, rounds)
        better = modularity_of(e, new, total)
        if better <= quality:
            discard(new)
            discard(degrees)
            break
        discard(labels)
        labels, quality = new, better
        parts = refined(e, degrees, labels, total, refinements, seed + level)
        discard(degrees)
        if parts.where("v <> cluster").limit(1).count() == 0:
            discard(parts)
            break
        wider = materialize(coarsen(e, parts, F.col("weight")))
        upper = materialize(labels.join(parts.toDF("v", "part"), "v").groupBy(F.col("part").alias("v")).agg(F.min("cluster").alias("cluster")))
        to = materialize(parts if at is None else at.join(parts.toDF("cluster", "to"), "cluster").select("v", F.col("to").alias("cluster")))
        for old in (labels, parts, *([at] if at is not None else []), *([e] if e is not first else [])):
            discard(old)
        e, labels, at = wider, upper, to
    whole = labels if at is None else at.join(labels.toDF("cluster", "top"), "cluster").select("v", F.col("top").alias("cluster"))
    out = connected(first, whole)
    for old in (labels, *([at] if at is not None else []), *([e] if e is not first else []), first):
        discard(old)
    return out
