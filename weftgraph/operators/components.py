"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import discard, materialize


#: Vertices up to which a round broadcasts the least neighbour of each (16 bytes each): no vertex's edges then meet in one task.
MOST_BROADCAST = 1_000_000


def _moved(e: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    return e.join(F.broadcast(least) if few else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(e: DataFrame, few: bool) -> DataFrame:
    """Every neighbour above a vertex moves to the least vertex of its neighbourhood."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _moved(both.where("b > a"), least, few)


def _small_star(e: DataFrame, few: bool) -> DataFrame:
    """A vertex and its neighbours below it move to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _moved(down, least, few).where("a <> b").union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(v, component) for every vertex of ``edges``; component is the smallest vertex reachable.

    Large-star and small-star steps alternate until the edge set no longer
    changes (Kiveris et al., 2014): the work of a round is in proportion to the
    edges, and the number of rounds grows with the logarithm of the longest path.
    Rows with a null end are ignored; a self-loop makes its vertex a component.
    Minima are combined before the shuffle. While edges are few the minima are
    broadcast, beyond that they are joined, and AQE can split the side where one
    vertex has most of the edges. The result reads tables in the shared folder;
    ``discard`` it when it is no longer read.
    """
    pairs = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"))
    vertices = pairs.select("a").distinct().union(pairs.select("b").distinct()).toDF("v").distinct()
    now = materialize(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few, mark = 2 * now.count() <= MOST_BROADCAST, None
    while True:
        new = materialize(_small_star(_large_star(now, few), few).distinct())
        row = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if (row[0], row[1]) == mark:
            break
        few, mark = 2 * row[0] <= MOST_BROADCAST, (row[0], row[1])
    found = now.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("component"))
    return vertices.join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))
