"""Approximate nearest-neighbour graphs by neighbour descent.

A neighbour of a neighbour is likely a neighbour (Dong et al., 2011). Every
vector keeps a list of the best it has met. In a round each vector introduces to
each other those that are in its list and those in whose lists it is; pairs of
which neither is new to the list have met before and are left out. What a round
costs grows with the vectors times the square of the lists' length, in place of
all pairs of vectors. Who introduces is dealt to cells; in a round a vector is
sent to each cell once, in 16 bits a component, for however many of the cell
introduce it. The lists that remain are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.build import _kind, _number, _usable
from weftgraph.operators.sampling import bottom_k
from weftgraph.plans.lineage import discard, materialize
from weftgraph.plans.workers import map_in_arrow

#: Members of a group that start out as each other's neighbours, on average; twice as many at most, about. Groupings by which sides of random planes vectors are on.
START, PLANES = 16, 6
#: Components in a round are whole numbers of 16 bits, of which so many are one.
ONE = 32767
#: Vectors of 64 components that introduce in one cell, about; a task holds those whom they introduce.
CELL = 32768
#: What is learned in a cell, in rows, of which the best are picked at once.
LEARNED = 1 << 19
STATE = ["v", "u", "weight", "fresh"]


def _learned(ids: np.ndarray, fresh: np.ndarray, last: np.ndarray, x: np.ndarray, length: int, digits: int) -> pa.RecordBatch | None:
    """What ``introduced`` makes of one group."""
    products = x @ x.T if x.dtype == float else x.astype(float) @ x.T.astype(float) / ONE**2
    scores = np.round(products, digits)
    scores[~(fresh[:, None] | fresh[None, :]) | (ids[:, None] == ids[None, :]) | (scores <= last[:, None])] = -9.0
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :length]
    r, c = np.repeat(np.arange(len(ids)), order.shape[1]), order.ravel()
    ok = scores[r, c] > -9.0
    return pa.RecordBatch.from_arrays([pa.array(ids[r[ok]]), pa.array(ids[c[ok]]), pa.array(scores[r[ok], c[ok]])], names=["v", "u", "weight"]) if ok.any() else None


def introduced(batches: Iterator[pa.RecordBatch], length: int, digits: int) -> Iterator[pa.RecordBatch]:
    """(v, u, weight): what members of a group learn of each other: the ``length`` best that beat the last of their lists.

    Rows (center, member, fresh, last, x) come group by group, of which one is
    held; a pair is compared if one of the two is fresh. Whole numbers are parts
    of ONE; their products are exact, so a pair scores the same in any group.
    """
    held: list[pa.RecordBatch] = []

    def met(rows: pa.Table) -> pa.RecordBatch | None:
        ids, fresh, last = (rows.column(c).to_numpy() for c in ("member", "fresh", "last"))
        return _learned(ids, fresh, last, rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1), length, digits)

    def cuts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        center = batch.column("center").to_numpy()
        at = [0, *(np.flatnonzero(np.diff(center)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            if b > a:
                yield batch.slice(a, b - a)

    for batch in batches:
        for piece in cuts(batch):
            if held and held[0].column("center")[0] != piece.column("center")[0]:
                if (out := met(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            held.append(piece)
    if held and (out := met(pa.Table.from_batches(held))) is not None:
        yield out


def introduced_in_cell(batches: Iterator[pa.RecordBatch], length: int, digits: int) -> Iterator[pa.RecordBatch]:
    """``introduced`` over the rows (member, last, centers, fresh, x) of one cell: each member once, with whoever introduces it and whether as fresh."""
    rows = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    ids, last = rows.column("member").to_numpy(), rows.column("last").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    fresh = rows.column("fresh").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    center = rows.column("centers").combine_chunks()
    member, center = np.repeat(np.arange(len(ids)), center.value_lengths().to_numpy()), center.flatten().to_numpy()
    order = np.lexsort((ids[member], center))
    cuts = [0, *(np.flatnonzero(np.diff(center[order])) + 1).tolist(), len(order)]
    held, size = [], 0
    for a, b in zip(cuts, cuts[1:]):
        at, own = member[order[a:b]], fresh[order[a:b]]
        if (out := _learned(ids[at], own, last[at], x[at], length, digits)) is not None:
            held.append(out)
            size += out.num_rows
        if size > LEARNED:
            yield _best(held, length)
            held, size = [], 0
    if held:
        yield _best(held, length)


def _best(learned: list[pa.RecordBatch], length: int) -> pa.RecordBatch:
    """Of all that is learned, once each, the ``length`` best of each vector: no list can take more of these."""
    v, u, weight = (np.concatenate([b.column(i).to_numpy() for b in learned]) for i in range(3))
    order = np.lexsort((u, -weight, v))
    v, u, weight = v[order], u[order], weight[order]
    once = np.ones(len(v), bool)
    once[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
    v, u, weight = v[once], u[once], weight[once]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    keep = np.arange(len(v)) - np.repeat(first, np.diff([*first, len(v)])) < length
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (v, u, weight)], names=["v", "u", "weight"])


def _meet(groups: DataFrame, last: DataFrame | None, codes: DataFrame, cells: int, length: int, digits: int) -> DataFrame:
    """``introduced`` over (center, member, fresh), a few rows to a center, with ``last`` (member, last) of each list, or none yet. A vector is sent to a cell once."""
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64(F.lit(1), "center"), F.lit(cells)).cast("int")).repartition("member")
    dealt = dealt.groupBy("member", "cell").agg(F.collect_list(F.struct("center", "fresh")).alias("all"))
    dealt = dealt.join(last, "member") if last is not None else dealt.withColumn("last", F.lit(-8.0))
    sent = dealt.join(codes.withColumnRenamed("id", "member"), "member").select("cell", "member", "last", F.col("all.center").alias("centers"), F.col("all.fresh").alias("fresh"), "x")
    return map_in_arrow(sent.repartitionById(cells, F.col("cell")), lambda batches: introduced_in_cell(batches, length, digits), "v bigint, u bigint, weight double")


def _sides(codes: DataFrame, n: int, seed: int) -> DataFrame:
    """(center, member): groups of vectors on the same sides of random planes, PLANES times with other planes, and twice groups drawn by hash. A group of more than twice START is divided by hash."""
    bits = max(0, int(np.log2(max(1, n / START))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and bits:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], PLANES * bits))
                side = ((x @ planes).reshape(len(x), PLANES, bits) > 0) @ (1 << np.arange(bits))
                t = np.tile(np.arange(2, PLANES + 2), len(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), PLANES)), pa.array(t), pa.array(side.ravel())], names=["member", "t", "side"])

    drawn = lambda t, places: F.pmod(F.xxhash64(F.lit(seed), t, "member"), places)
    found = map_in_arrow(codes.select("id", "x"), run, "member bigint, t bigint, side bigint")
    large = found.groupBy("t", "side").agg(F.count("*").alias("m")).where(F.col("m") > 2 * START).select("t", "side", F.ceil(F.col("m") / START).alias("places"))
    part = found.join(large, ["t", "side"], "left").select(F.xxhash64("t", "side", F.coalesce(drawn(F.col("t"), F.col("places")), F.lit(0))).alias("center"), "member")
    some = codes.select(F.col("id").alias("member"), F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    some = some.select(F.xxhash64("t", F.lit(0), drawn(F.col("t"), F.lit(max(1, -(-n // START))))).alias("center"), "member")
    return part.unionByName(some).distinct()


def _exact(lists: DataFrame, vectors: DataFrame, dimension: int, k: int, digits: int) -> DataFrame:
    """(src, dst, weight): the ``k`` best of each list by cosines of the whole vectors. Only those that the rounding of ``lists`` can't rule out are sent with theirs."""
    off = (0.5 / ONE) * dimension**0.5
    least = F.nth_value("weight", k).over(Window.partitionBy("v").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = lists.select("v", "u", "weight", least.alias("least")).where(F.col("least").isNull() | (F.col("weight") >= F.col("least") - 2 * (off * (2 + off) + 10.0**-digits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(c).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1) for c in ("a", "b"))
                length = [np.sqrt((x * x).sum(1)) for x in (a, b)]
                w = np.round(np.einsum("ij,ij->i", a, b) / length[0] / length[1], digits)
                yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("u"), pa.array(w)], names=["src", "dst", "weight"])

    met = near.select("v", "u").join(vectors.select(F.col("id").alias("u"), F.col("v").alias("b")), "u").join(vectors.select(F.col("id").alias("v"), F.col("v").alias("a")), "v")
    return bottom_k(map_in_arrow(met, run, "src bigint, dst bigint, weight double"), ["src"], [F.desc("weight"), "dst"], k)


def neighbour_descent(df: DataFrame, key: str, vector: str, k: int = 8, length: int | None = None, rounds: int = 12, stop: float = 0.002, seed: int = 0, digits: int = 6) -> DataFrame:
    """(src, dst, weight): about the ``k`` nearest others of every vector by rounded cosine, ties to the smaller key.

    Lists are ``length`` long while they improve, three times ``k`` and 24 at
    least by default: longer ones find more and cost their square. Ends after
    ``rounds``, or when fewer than ``stop`` of all places in the lists change.
    Null ids, vectors that are null or zero, hold null or non-finite components
    or have another length than most take no part; rows that repeat an id are
    one vector, the smallest. Among many copies of a vector any may be found.
    Vectors that are in many lists introduce a hash-drawn ``length`` of each
    kind in a round, cut before the shuffle, and others in later rounds. The
    result reads a table in the shared folder.
    """
    rows, n = _usable(df, key, vector)
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    one = rows.select("id", F.col("v").cast(f"array<{_kind(df, vector)}>").alias("v")).groupBy("id").agg(F.min("v").alias("v")).withColumn("norm", norm)
    vectors = materialize(one.select("id", "v", F.transform("v", lambda x: F.round(x / F.col("norm") * ONE).cast("short")).alias("x")))
    codes = vectors.select("id", "x")
    dimension = some["d"] if (some := vectors.select(F.size("x").alias("d")).first()) else 0
    cells = max(_number(n, CELL), -(-n * dimension // (64 * CELL)))
    length = length or max(24, 3 * k)
    start = _sides(codes, n, seed).select("center", "member", F.lit(True).alias("fresh"))
    order = [F.desc("weight"), "u"]
    now = materialize(bottom_k(_meet(start, None, codes, cells, length, digits).distinct(), ["v"], order, length).select("v", "u", "weight", F.lit(True).alias("fresh")))
    for i in range(rounds):
        # of what is new to a list, and of where a vector is new, as many as a list is long; the rest waits
        drawn = materialize(bottom_k(now.where("fresh"), ["v"], [F.xxhash64(F.lit(seed), F.lit(2 * i), "v", "u"), "u"], max(1, length // 2)).select("v", "u"))
        known = now.where("not fresh").select(F.col("v").alias("center"), F.col("u").alias("member"), F.lit(False).alias("fresh"))
        forward = known.unionByName(drawn.select(F.col("v").alias("center"), F.col("u").alias("member"), F.lit(True).alias("fresh")))
        back = bottom_k(forward.select(F.col("member").alias("center"), F.col("center").alias("member"), "fresh"), ["center", "fresh"], [F.xxhash64(F.lit(seed), F.lit(2 * i + 1), "center", "member"), "member"], max(1, length // 2))
        busy = drawn.select(F.explode(F.array("v", "u")).alias("center")).distinct()  # who has nobody new has nobody to introduce
        both = forward.unionByName(back).join(busy, "center", "left_semi").groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
        last = now.groupBy(F.col("v").alias("member")).agg(F.when(F.count("*") >= length, F.min("weight")).otherwise(F.lit(-8.0)).alias("last"))
        met = _meet(both, last, codes, cells, length, digits)
        held = now.withColumn("born", F.lit(False)).unionByName(drawn.select("v", "u", F.lit(None).cast("double").alias("weight"), F.lit(False).alias("fresh"), F.lit(False).alias("born")))
        all_ = held.unionByName(met.select("v", "u", "weight", F.lit(True).alias("fresh"), F.lit(True).alias("born"))).groupBy("v", "u").agg(F.max("weight").alias("weight"), F.bool_and("fresh").alias("fresh"), F.bool_and("born").alias("born"))
        new = materialize(bottom_k(all_, ["v"], order, length))
        changed = new.where("born").count()
        discard(now)
        discard(drawn)
        now = new.select(*STATE)
        if changed <= stop * n * length:
            break
    out = materialize(_exact(now, vectors, dimension, k, digits))
    discard(now)
    discard(vectors)
    return out
