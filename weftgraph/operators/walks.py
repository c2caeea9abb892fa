"""Biased random walks of the second order, drawn by rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import discard, materialize, materialize_all

#: Cells that a vertex's neighbours are numbered in, so that no task sorts a hub's; draws of a step that are made at once.
CELLS, DRAWS = 64, 4


def numbered_neighbours(edges: DataFrame) -> DataFrame:
    """(src, at, dst): the distinct neighbours of every vertex with numbers from 0 without gaps. Null ends take no part."""
    one = edges.where("src is not null and dst is not null").select("src", "dst").distinct().withColumn("cell", F.pmod(F.xxhash64("dst"), F.lit(CELLS)))
    cells = one.groupBy("src", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = one.withColumn("k", F.row_number().over(Window.partitionBy("src", "cell").orderBy("dst")) - 1)
    return within.join(cells.select("src", "cell", before.alias("before")), ["src", "cell"]).select("src", (F.col("before") + F.col("k")).cast("bigint").alias("at"), "dst")


def _uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key only: 52 bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 12).cast("double") / F.lit(float(1 << 52))


def random_walks(edges: DataFrame, starts: DataFrame, length: int, walks: int = 1, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """(start, walk, step, v): ``walks`` walks of up to ``length`` steps from every vertex of ``starts`` (v); step 0 is the start.

    From v, to which it came from u, a walk goes to a neighbour x of v with a
    weight of 1 / ``p`` if x is u, of 1 if u and x are neighbours, and of
    1 / ``q`` otherwise (Grover and Leskovec, 2016). A neighbour of v is drawn
    evenly by its number, and kept with its weight's share of the largest; what
    is not kept draws again. So a step asks for one neighbour and one edge a
    draw: the neighbours of neighbours are never listed, and a hub costs a walk
    no more than another vertex. The first step is even. Draws depend on the
    seed, the start, the walk and the step alone, so the same graph gives the
    same walks, whatever the order of rows. Edges count once, null ends and null
    starts take no part, a walk ends early at a vertex without edges that lead
    from it. The result reads a table in the shared folder.
    """
    if length < 1 or walks < 1 or p <= 0 or q <= 0:
        raise ValueError("at least one walk of one step, and weights above zero")
    near = materialize(numbered_neighbours(edges))
    degrees = materialize(near.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d")))
    known = near.select(F.col("src").alias("u"), F.col("dst").alias("x"), F.lit(True).alias("linked"))
    most = max(1.0, 1 / p, 1 / q)
    first = starts.select(F.col("v").cast("bigint").alias("start")).where("start is not null").distinct()
    none = F.lit(None).cast("bigint")
    now = materialize(first.select("start", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.lit(0).alias("step"), F.col("start").alias("v"), none.alias("u")))
    temporary = [near, degrees, now]

    def taken(open_: DataFrame, step: int, at: int) -> DataFrame:
        """The first draw kept, of DRAWS from the ``at``-th on, of walks (start, walk, v, u, d): with x, null where none was."""
        drawn = open_.withColumn("draw", F.explode(F.sequence(F.lit(at), F.lit(at + DRAWS - 1))))
        key = [F.lit(seed), F.col("start"), F.col("walk"), F.lit(step), F.col("draw")]
        drawn = drawn.withColumn("at", F.floor(_uniform(*key, F.lit(0)) * F.col("d")).cast("bigint")).withColumn("luck", _uniform(*key, F.lit(1)))
        met = drawn.join(near.select(F.col("src").alias("v"), "at", F.col("dst").alias("x")), ["v", "at"]).join(known, ["u", "x"], "left")
        weight = F.when(F.col("u").isNull(), most).when(F.col("x") == F.col("u"), 1 / p).when(F.col("linked"), 1.0).otherwise(1 / q)
        kept = F.when(F.col("luck") * most < weight, F.struct("draw", "x"))
        return met.groupBy("start", "walk", "v", "u", "d").agg(F.min(kept)["x"].alias("x"))

    def steps():
        nonlocal now
        yield now.select("start", "walk", "step", "v")
        for step in range(1, length + 1):
            open_, at, found = now.join(degrees, "v").select("start", "walk", "v", "u", "d"), 0, []
            while True:
                tried = materialize(taken(open_, step, at))
                temporary.append(tried)
                found.append(tried.where("x is not null"))
                open_ = tried.where("x is null").drop("x")
                if open_.isEmpty():
                    break
                at += DRAWS
            now = found[0]
            for more in found[1:]:
                now = now.unionByName(more)
            now = now.select("start", "walk", F.lit(step).alias("step"), F.col("x").alias("v"), F.col("v").alias("u"))
            yield now.select("start", "walk", "step", "v")

    out = materialize_all(steps())
    for old in temporary:
        discard(old)
    return out
