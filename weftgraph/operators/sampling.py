"""Neighbour sampling: bounded neighbourhoods for the mini-batches of a graph network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import materialize

#: Vertices up to which a layer's sources are broadcast (8 bytes each), so that only their edges are read on.
MOST_BROADCAST = 1_000_000
#: Hexadecimal digits of a ticket that make its uniform number: 52 bits are exact in a double.
DIGITS = 13


def ticket(seed: int, hop: int, src: str = "src", dst: str = "dst") -> Column:
    """The hexadecimal MD5 of ``seed|hop|src|dst``: the same draw in any engine, whatever the order of rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(hop)), F.col(src).cast("string"), F.col(dst).cast("string")).cast("binary"))


def rank_of(drawn: Column, weight: str | None) -> Column:
    """What edges are ranked by, smallest first: the ticket, or its exponential rank -ln(u) / weight, so that heavier edges are drawn in proportion."""
    if weight is None:
        return drawn
    u = (F.conv(F.substring(drawn, 1, DIGITS), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(16**DIGITS))
    return -F.log(u) / F.col(weight).cast("double")


def bottom_k(rows: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group. Every task cuts its own part of a group to ``k`` rows before they are shuffled (WindowGroupLimit, for k below a thousand), so a hub sends no more than k rows a task."""
    taken = {c.lower() for c in rows.columns}
    place = "place"
    while place in taken:
        place += "_"
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= k).drop(place)


def sample_neighbours(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 0, weight: str | None = None) -> DataFrame:
    """(hop, src, dst): for every vertex that a hop reaches, ``fanouts[hop - 1]`` of its neighbours, or all where there are fewer.

    Hop 1 starts at the distinct ``v`` of ``seeds``, each further hop at the
    distinct neighbours drawn by the one before. What a vertex draws depends on
    ``seed``, the hop and its edges alone: it is the same for every batch, every
    order of rows and every number of tasks. Without ``weight`` all neighbours
    are equally likely; with it, they are drawn without replacement in
    proportion, and weights that are null, NaN or not above zero are never drawn.
    Edges with a null end and null seeds take no part; seeds without edges have
    no rows; an edge that is in the table twice can be drawn twice. Ties of the
    ticket go to the smaller neighbour. A layer's edges are cut before the join
    with its sources, unless these are few: then they are broadcast and other
    edges are not ranked at all. The result reads tables in the shared folder.
    """
    if not fanouts or min(fanouts) < 1:
        raise ValueError("every hop draws at least one neighbour")
    kept = edges.where("src is not null and dst is not null").select("src", "dst", *([weight] if weight else []))
    if weight:
        kept = kept.where((F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double")))
    at = seeds.select(F.col("v").alias("src")).where("src is not null").distinct()

    def layers():
        nonlocal at
        for hop, k in enumerate(fanouts, 1):
            few = at.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
            drawn = bottom_k(kept.join(F.broadcast(at), "src", "left_semi") if few else kept, ["src"], [rank_of(ticket(seed, hop), weight), F.col("dst")], k)
            layer = materialize((drawn if few else drawn.join(at, "src", "left_semi")).select(F.lit(hop).alias("hop"), "src", "dst"))
            at = layer.select(F.col("dst").alias("src")).distinct()
            yield layer

    first, *others = layers()
    for layer in others:
        first = first.unionByName(layer)
    return first
