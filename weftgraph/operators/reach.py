"""What is within reach of vertices: sizes of neighbourhoods by sketches, and personalised PageRank by residual push."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import discard, materialize

#: Rounds of pushes at most, by which no residual is left in practice: each leaves at most 1 - alpha of what was pushed.
MOST_ROUNDS = 500


def neighbourhood_sizes(edges: DataFrame, hops: int, precision: int = 12) -> DataFrame:
    """(v, hop, size): about how many vertices are within each of 1 to ``hops`` steps of every vertex, itself included (Boldi et al., 2011).

    Every vertex has a sketch of 2^``precision`` registers at most; in a hop it
    merges those of the vertices that its edges lead to. What is sent grows with
    the edges and not with the pairs of vertices that ``k_hop`` lists. Sizes up
    to some hundreds are exact but for collisions of hashes; the standard error
    of larger ones is 1.04 / sqrt(2^precision), 1.6 % by default. Merging is a
    maximum, combined before the shuffle, so a hub costs a task a sketch. Edges
    with a null end take no part, repeated ones and loops change nothing; a
    vertex without edges that lead from it has itself only. An empty table has no
    rows. The result reads tables in the shared folder.
    """
    if hops < 1:
        raise ValueError("one hop at least")
    one = materialize(edges.where("src is not null and dst is not null").select("src", "dst"))
    vertices = one.select("src").union(one.select("dst")).toDF("v").distinct()
    now = vertices.groupBy("v").agg(F.hll_sketch_agg(F.col("v").cast("string"), F.lit(precision)).alias("sketch"))
    found = []
    for hop in range(1, hops + 1):
        sent = one.join(now.withColumnRenamed("v", "dst"), "dst").select(F.col("src").alias("v"), "sketch")
        now = materialize(sent.unionByName(now).groupBy("v").agg(F.hll_union_agg("sketch").alias("sketch")))
        found.append(now)
    out = None
    for hop, sketches in enumerate(found, 1):
        sizes = sketches.select("v", F.lit(hop).alias("hop"), F.hll_sketch_estimate("sketch").alias("size"))
        out = sizes if out is None else out.unionByName(sizes)
    out = materialize(out)
    for old in (one, *found):
        discard(old)
    return out


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, epsilon: float = 1e-4) -> DataFrame:
    """(seed, v, rank): for every seed, where a walk from it is that ends in each step with probability ``alpha`` (Andersen et al., 2006).

    ``edges``: (src, dst), both directions of each; rows that repeat weigh more.
    ``seeds``: (v). Only residuals above ``epsilon`` times a vertex's degree are
    pushed on, all of a round at once, so work stays near the seeds: what is
    pushed in all is at most 1 / (alpha epsilon) edges a seed, whatever the size
    of the graph. A rank is never above the exact one, and short of it by at most
    ``epsilon`` times the vertex's degree, where edges go both ways. Vertices that
    were never pushed have no row. Null ends and null seeds take no part; seeds
    without edges have themselves with rank 1. Deterministic but for the last
    digits, which depend on the order of sums. The result reads a table in the
    shared folder.
    """
    if not 0 < alpha < 1 or epsilon <= 0:
        raise ValueError("alpha between 0 and 1, epsilon above 0")
    one = materialize(edges.where("src is not null and dst is not null").select("src", "dst"))
    degrees = materialize(one.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d")))
    asked = materialize(seeds.select(F.col("v")).where("v is not null").distinct())
    known = asked.join(degrees, "v", "left")
    alone = known.where("d is null").select(F.col("v").alias("seed"), "v", F.lit(1.0).alias("rank"))
    state = materialize(known.where("d is not null").select(F.col("v").alias("seed"), "v", "d", F.lit(0.0).alias("rank"), F.lit(1.0).alias("rest")))
    for _ in range(MOST_ROUNDS):
        pushed = state.where(F.col("rest") > F.lit(epsilon) * F.col("d")).select("seed", "v", "d", "rest")
        if pushed.isEmpty():
            break
        sent = pushed.join(one.withColumnRenamed("src", "v"), "v").groupBy("seed", F.col("dst").alias("v")).agg(F.sum(F.lit(1 - alpha) * F.col("rest") / F.col("d")).alias("rest"))
        sent = sent.join(degrees, "v").select("seed", "v", "d", F.lit(0.0).alias("rank"), "rest")
        over = F.col("rest") > F.lit(epsilon) * F.col("d")
        kept = state.select("seed", "v", "d", F.when(over, F.col("rank") + alpha * F.col("rest")).otherwise(F.col("rank")).alias("rank"), F.when(over, 0.0).otherwise(F.col("rest")).alias("rest"))
        new = materialize(kept.unionByName(sent).groupBy("seed", "v", "d").agg(F.sum("rank").alias("rank"), F.sum("rest").alias("rest")))
        discard(state)
        state = new
    out = materialize(state.where("rank > 0").select("seed", "v", "rank").unionByName(alone))
    for old in (one, degrees, asked, state):
        discard(old)
    return out
