"""Balanced graph partitioning, multilevel: parts of nearly equal size with few edges between them.

Vertices are matched along heavy edges and merged, level by level, until few are
left; these are dealt to parts by growing each part along its heaviest edges; on
the way back every level moves vertices to the part that most of their edges lead
to, as far as the parts' limit allows. All that depends on the graph's size is
joins and sums; only the coarsest graph, whose size the number of parts bounds,
is grown in one task.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph import coarsen
from weftgraph.operators.sampling import bottom_k
from weftgraph.plans.lineage import discard, materialize
from weftgraph.plans.workers import map_in_arrow

#: Parts at most; heaviest edges of a vertex of the coarsest graph that growing looks at; cells of equal gain that moves are accepted by.
MOST_PARTS, HEAVIEST, SLOTS = 512, 32, 64
#: Proposals of a level; unmatched share from which vertices with a common neighbour are merged; share of the vertices that a level must leave fewer.
PROPOSALS, UNMATCHED, SHRINK = 4, 0.25, 0.02
#: Vertices up to which what is known of each is broadcast to the edges (some 60 bytes each), which then stay where they are.
MOST_BROADCAST = 1_000_000
#: The place, before all of its cells, of what a part has already.
HELD = 1 << 20


def _edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops; weights, 1 where there are none, summed over repeated edges."""
    w = F.col("weight").cast("bigint") if "weight" in edges.columns else F.lit(1).cast("bigint")
    one = edges.where("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("weight"), (F.col("src") < F.col("dst")).alias("up"))
    # an edge given in both directions is one edge: its weight is the larger direction's sum
    each = one.groupBy("a", "b", "up").agg(F.sum("weight").alias("weight")).groupBy("a", "b").agg(F.max("weight").alias("weight")).where("weight > 0")
    return each.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "weight").select("e.src", "e.dst", "weight")


def _laid(edges: DataFrame) -> DataFrame:
    """``edges`` written with a vertex's edges side by side, a hub's in several places: what is summed by vertex is then few rows before any shuffle."""
    return materialize(edges.repartitionByRange("src", "dst"))


def _small(known: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(known) if few else known


def _both(edges: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """Edges whose ends are both in ``known`` (v, ...), its other columns beside them as _a for src and _b for dst. Both ends read one broadcast table, if ``few``."""
    rest = [c for c in known.columns if c != "v"]
    a, b = (known.select(F.col("v").alias(end), *(F.col(c).alias(c + of) for c in rest)) for end, of in (("src", "_a"), ("dst", "_b")))
    return edges.join(_small(a, few), "src").join(_small(b, few), "dst")


def propose(edges: DataFrame, free: DataFrame, limit: int, few: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of free vertices, each the other's heaviest free neighbour with which it stays within ``limit``.

    ``free``: (v, size). Edges are ordered by weight and then by a hash that both
    ends see alike, so the heaviest edge of any neighbourhood is always proposed
    from both ends. ``few``: free vertices may be broadcast.
    """
    open_ = _both(edges, free, few).where(F.col("size_a") + F.col("size_b") <= limit)
    ends = F.least("src", "dst"), F.greatest("src", "dst")
    best = open_.groupBy("src").agg(F.max_by("dst", F.struct("weight", F.xxhash64(*ends), *ends)).alias("dst"))
    return best.groupBy(ends[0].alias("a"), ends[1].alias("b")).agg(F.count("*").alias("n")).where("n = 2").select("a", "b")


def beside(edges: DataFrame, free: DataFrame, limit: int) -> DataFrame:
    """(v, merged): free vertices that have the same heaviest neighbour, or none at all, merged in groups within ``limit`` under their smallest.

    Groups are dealt by a hash to twice as many as the limit asks for, so none
    is ever gathered: what one task sees of a hub's leaves are sums.
    """
    heavy = edges.groupBy("src").agg(F.max_by("dst", F.struct("weight", -F.col("dst"))).alias("hub"))
    at = free.join(heavy.withColumnRenamed("src", "v"), "v", "left")
    chunks = at.groupBy(F.col("hub").alias("of")).agg(F.ceil(2 * F.sum("size") / F.lit(limit)).alias("chunks"))
    dealt = at.join(chunks, F.col("hub").eqNullSafe(F.col("of"))).select("v", "size", "hub", F.pmod(F.xxhash64("v"), "chunks").alias("chunk"))
    groups = dealt.groupBy("hub", "chunk").agg(F.min("v").alias("merged"), F.sum("size").alias("all"), F.count("*").alias("n")).where(F.col("all") <= limit).where("n > 1")
    return dealt.alias("d").join(groups.alias("g"), F.col("d.hub").eqNullSafe(F.col("g.hub")) & (F.col("d.chunk") == F.col("g.chunk"))).select("v", "merged")


def matched(edges: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """(v, size, merged) for every vertex of ``sizes`` (v, size): the smallest vertex of those it is merged with."""
    pairs, free, n = [], sizes, sizes.count()
    unmatched = n
    for _ in range(PROPOSALS):
        new = materialize(propose(edges, free, limit, unmatched <= MOST_BROADCAST))
        pairs.append(new)
        found = new.count()
        if not found:
            break
        left = materialize(free.join(new.select(F.explode(F.array("a", "b")).alias("v")), "v", "left_anti"))
        if free is not sizes:
            discard(free)
        free, unmatched = left, unmatched - 2 * found
    both = pairs[0]
    for p in pairs[1:]:
        both = both.unionByName(p)
    found = both.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("a").alias("merged")), F.struct(F.col("b").alias("v"), F.col("a").alias("merged")))).alias("m")).select("m.*")
    if unmatched > UNMATCHED * n:
        found = found.unionByName(beside(edges, free, limit))
    out = materialize(sizes.join(found, "v", "left").select("v", "size", F.coalesce("merged", "v").alias("merged")))
    for p in pairs:
        discard(p)
    if free is not sizes:
        discard(free)
    return out


def grow(sizes: dict[int, int], near: dict[int, list[tuple[int, int]]], parts: int, most: int) -> dict[int, int]:
    """A part for each vertex of a small graph: parts grow one after the other along their heaviest edges up to an equal share of what is left; no part exceeds ``most``."""
    free, of, full = dict(sorted(sizes.items())), {}, [0] * parts
    rest = sum(sizes.values())
    waiting = iter(list(free))
    for p in range(parts):
        share, pull, heap = rest / (parts - p), defaultdict(int), []
        while free and full[p] < share:
            v = None
            while heap:
                w, v = heapq.heappop(heap)
                if v in free and -w == pull[v]:
                    break
                v = None
            if v is None:
                v = next((x for x in waiting if x in free), None)
            if v is None or full[p] + free[v] > most:
                if v is None or not heap:
                    break
                continue
            full[p] += free[v]
            rest -= free.pop(v)
            of[v] = p
            for u, w in near.get(v, ()):
                if u in free:
                    pull[u] += w
                    heapq.heappush(heap, (-pull[u], u))
    for v in sorted(free, key=lambda v: (-free[v], v)):
        to = defaultdict(int)
        for u, w in near.get(v, ()):
            if u in of:
                to[of[u]] += w
        fits = [p for p in range(parts) if full[p] + free[v] <= most]
        of[v] = max(fits, key=lambda p: (to[p], -full[p], -p)) if fits else min(range(parts), key=lambda p: (full[p], p))
        full[of[v]] += free[v]
    return of


def _start(edges: DataFrame, sizes: DataFrame, parts: int, most: int) -> DataFrame:
    """(v, part) of the coarsest graph, in one task: its vertices are few whatever the graph's size, and it sees the heaviest edges of each."""
    heavy = bottom_k(edges, ["src"], [F.desc("weight"), "dst"], HEAVIEST)
    rows = sizes.select("v", "size", F.lit(None).cast("bigint").alias("dst")).unionByName(heavy.select(F.col("src").alias("v"), F.col("weight").alias("size"), "dst"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, near = {}, defaultdict(list)
        for batch in batches:
            for v, n, dst in zip(*(c.to_pylist() for c in batch.columns)):
                if dst is None:
                    held[v] = n
                else:
                    near[v].append((dst, n))
        if held:
            of = grow(held, {v: sorted(x) for v, x in near.items()}, parts, most)
            yield pa.RecordBatch.from_pydict({"v": pa.array(list(of), pa.int64()), "part": pa.array(list(of.values()), pa.int32())})

    return map_in_arrow(rows.coalesce(1), run, "v bigint, part int")


def cut_of(edges: DataFrame, labels: DataFrame, few: bool = False) -> int:
    """The weight of all edges, each counted once, whose ends are in two parts."""
    return _both(edges, labels.select("v", "part"), few).where("part_a <> part_b and src < dst").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]


def wishes(edges: DataFrame, labels: DataFrame, up: bool, seed: int, few: bool = False) -> DataFrame:
    """(v, size, part, out, to, place) for every vertex of ``labels`` (v, size, part), by one pass over the edges.

    ``out``: the weight of its edges to other parts. ``to``: the part of another
    number, above its own if ``up`` and below otherwise, to which most of its
    weight leads, if that is more than leads to its own; else null. ``place``: the
    cell in which it waits there, the larger the earlier: by falling gain, in
    powers of two, and within one by hash.
    """
    led = _both(edges, labels, few).select(F.col("src").alias("v"), F.col("size_a").alias("size"), F.col("part_a").alias("part"), F.col("part_b").alias("to"), F.col("weight").alias("w"))
    own = labels.select("v", "size", "part", F.col("part").alias("to"), F.lit(0).cast("bigint").alias("w"))  # vertices without edges too
    pull = led.unionByName(own).groupBy("v", "size", "part", "to").agg(F.sum("w").alias("w"))
    there = F.col("to") > F.col("part") if up else F.col("to") < F.col("part")
    best = pull.groupBy("v", "size", "part").agg(
        F.sum(F.when(F.col("to") == F.col("part"), F.col("w")).otherwise(0)).alias("w_own"),
        F.sum(F.when(F.col("to") != F.col("part"), F.col("w")).otherwise(0)).alias("out"),
        F.max(F.when(there, F.struct("w", (-F.col("to")).alias("minus")))).alias("m"),
    )
    gain = F.col("m.w") - F.col("w_own")
    place = F.floor(F.log2(gain.cast("double"))) * SLOTS + (SLOTS - 1) - F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(SLOTS))
    return best.select("v", "size", "part", "out", F.when(gain > 0, -F.col("m.minus")).alias("to"), F.when(gain > 0, place).cast("int").alias("place"))


def accepted(wished: DataFrame, parts: int, most: int) -> tuple[list[int], int]:
    """For each part the last place it takes moves from, ``HELD`` or above if it takes none; and the cut before any move.

    A part takes moves as whole cells, in their order, as long as all of them fit
    beside what it has: no part exceeds ``most``, and no task sees more of a part
    than its cells. As cells are taken without gaps, the last one says it all.
    """
    held = F.struct(F.col("part").alias("to"), F.lit(HELD).alias("place"), "size", F.col("out").cast("decimal(20,0)").alias("out"))
    asked = F.struct("to", "place", "size", F.lit(0).cast("decimal(20,0)").alias("out"))
    cells = wished.select(F.explode(F.array(held, asked)).alias("c")).select("c.*").where("to is not null").groupBy("to", "place").agg(F.sum("size").alias("size"), F.sum("out").alias("out"))
    so_far = cells.withColumn("so_far", F.sum("size").over(Window.partitionBy("to").orderBy(F.desc("place"))))
    rows = so_far.groupBy("to").agg(F.min(F.when(F.col("so_far") <= most, F.col("place"))).alias("last"), F.sum("out").alias("out")).collect()
    last = [HELD] * parts
    for r in rows:
        last[r["to"]] = HELD if r["last"] is None else r["last"]
    return last, int(sum(r["out"] for r in rows)) // 2


def refined(edges: DataFrame, labels: DataFrame, parts: int, most: int, rounds: int, few: bool = False) -> DataFrame:
    """``labels`` (v, size, part) after rounds of moves, upwards and downwards in turn; unchanged if the cut would not be smaller. Reads one table in the shared folder."""
    before, now, idle = 0, labels, 0
    for i in range(rounds):
        wished = materialize(wishes(edges, now, i % 2 == 0, i, few))
        if now is not labels:
            discard(now)
        last, cut = accepted(wished, parts, most)
        before = cut if i == 0 else before
        now = wished.select("v", "size", F.when(F.col("place") >= F.get(F.lit(last), F.col("to")), F.col("to")).otherwise(F.col("part")).cast("int").alias("part"))
        idle = 0 if min(last) < HELD else idle + 1
        if idle == 2:
            break
    if now is labels:
        return labels
    if cut_of(edges, now, few) < before:
        discard(labels)
        return now
    discard(now)
    return labels


def balanced_partition(edges: DataFrame, parts: int, slack: float = 0.1, rounds: int = 8, vertices: DataFrame | None = None) -> DataFrame:
    """(v, part): every vertex in one of ``parts`` parts, of which none has more than (1 + ``slack``) times an equal share, rounded up.

    ``edges``: (src, dst) and optionally a whole-numbered weight, as 1 otherwise;
    directions don't matter. ``vertices``: (v) that count besides those of the
    edges. Null ends and vertices, loops and edges without weight take no part;
    repeated edges add up. Deterministic. An empty graph has no rows, and where
    there are fewer vertices than parts some parts are empty. Hubs: proposals,
    pulls and merges are sums and maxima, combined before every shuffle. The
    result reads a table in the shared folder; ``discard`` it when it is no
    longer read.
    """
    if not 1 <= parts <= MOST_PARTS or slack <= 0:
        raise ValueError(f"1 to {MOST_PARTS} parts, and some slack")
    e = _laid(_edges(edges))
    all_ = e.select(F.col("src").alias("v")) if vertices is None else e.select(F.col("src").alias("v")).union(vertices.select(F.col("v").cast("bigint")).where("v is not null"))
    sizes = materialize(all_.distinct().withColumn("size", F.lit(1).cast("bigint")))
    n = total = sizes.count()
    most = max(1, math.ceil(total * (1 + slack) / parts))
    limit, few = max(1, int(slack * total / parts / 2)), math.ceil(4 * parts / slack)
    levels = []
    while n > few and limit > 1:
        to = matched(e, sizes, limit)
        fewer = materialize(to.groupBy(F.col("merged").alias("v")).agg(F.sum("size").alias("size")))
        m = fewer.count()
        if m > (1 - SHRINK) * n:
            discard(to)
            discard(fewer)
            if n <= 2 * few:
                break
            # no edge is left along which more can be merged: light vertices go together, so that few remain whatever the graph
            to = matched(e.limit(0), sizes, limit)
            fewer = materialize(to.groupBy(F.col("merged").alias("v")).agg(F.sum("size").alias("size")))
            m = fewer.count()
        levels.append((e, to, n))
        e = _laid(coarsen(e, _small(to.select("v", "merged"), n <= MOST_BROADCAST), F.col("weight")).where("src <> dst"))
        discard(sizes)
        sizes, n = fewer, m
    start = materialize(sizes.join(_start(e, sizes, parts, most), "v").select("v", "size", "part"))
    labels = refined(e, start, parts, most, rounds, n <= MOST_BROADCAST)
    discard(e)
    discard(sizes)
    for e, to, n in reversed(levels):
        wide = materialize(to.join(labels.select(F.col("v").alias("merged"), "part"), "merged").select("v", "size", "part"))
        discard(labels)
        labels = refined(e, wide, parts, most, rounds, n <= MOST_BROADCAST)
        discard(e)
        discard(to)
    return labels.select("v", "part")
