"""SimHash fingerprints and their near neighbours, by a Gray-order hierarchical index.

Fingerprints are computed in one pass. Distinct ones are then routed by masked
patterns: the 64 bits make four blocks, two fingerprints with at most two
differing bits agree in two of the blocks, so each goes to six nodes, one for
every pair of blocks, named by the mask and the bits under it. A node with very
many members is refined by the same step over its free bits; after that at most
16 bits are free, so a group never holds more than 65,536 fingerprints, whatever
the data. Within a group the members are sorted by Gray rank, neighbours in that
order share long masked patterns, and these are factored into the nodes of a
hierarchy: a search adds up the bits that differ from the patterns on its way
down and drops a node with all below it as soon as the sum passes the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import documents, in_arrow, per_batch, texts
from weftgraph.operators.components import connected_components
from weftgraph.plans.lineage import discard, materialize

#: Members of a node above which it is refined.
REFINE = 2048
#: Members below a leaf of the hierarchy, and children of its other nodes.
FAN = 16
#: Shingles hashed at once.
BLOCK = 1 << 18

_SPREAD = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _SPREAD[_b] = [_b >> 7 - i & 1 for i in range(8)]
_SPREAD = _SPREAD.view(np.uint64).ravel()


def shingles(text: str, k: int) -> list[bytes]:
    """Runs of ``k`` words of the text in lower case (A-Z only), or all words where there are fewer; none without words."""
    w = text.encode().lower().split()
    if len(w) <= k:
        return [b" ".join(w)] if w else []
    return [*map(b" ".join, zip(*(w[i:] for i in range(k))))]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the (big-endian) hashes have each bit, the highest first.

    Every byte is spread over the eight lanes of a 64-bit number, and up to 255
    of those are added before a lane can overflow.
    """
    total = np.zeros(64, np.int64)
    raw = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)
    for a in range(0, len(raw), BLOCK):
        part = raw[a : a + BLOCK]
        starts = np.arange(0, len(part), 255)
        for byte in range(8):
            lanes = np.add.reduceat(_SPREAD[part[:, byte]], starts)
            total[8 * byte : 8 * byte + 8] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return total


def hashed(parts: list[bytes], seed: int = 42) -> np.ndarray:
    """XXH64 of each."""
    return np.frombuffer(b"".join([xxhash.xxh64_digest(p, seed) for p in parts]), ">u8").astype(np.uint64)


def fingerprint(text: str, k: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text; 0 without words. A bit is set if over half of the shingles' hashes have it."""
    h = hashed(shingles(text, k), seed)
    return int.from_bytes(np.packbits(2 * bit_counts(h) > len(h)).tobytes()) if len(h) else 0


def fingerprints(df: DataFrame, k: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp bigint): the fingerprint's 64 bits as a signed number.

    Null texts are empty; empty texts and those without words have fingerprint
    zero. Very long texts are hashed whole. Every row has a fingerprint, rows that
    repeat the same one; an empty table gives an empty one.
    """
    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, k, seed) for t in texts(batch)], np.uint64)
        return {"k": batch.column("k"), "fp": fps.view(np.int64)}

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return per_batch(rows, run, f"k {rows.schema['k'].dataType.simpleString()}, fp bigint").select(F.col("k").alias(key), "fp")


# ---- the index of one group


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Places in the Gray sequence: each bit is the parity of the bits from there up."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """A hierarchy of shared masked patterns over fingerprints in Gray order."""

    def __init__(self, fps: np.ndarray):
        """``fps``: distinct uint64 numbers, in any order."""
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        ones, zeros = self.fps, ~self.fps  # bits that all below a node have set, and unset
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask, pattern) from the leaves up
        while len(ones) > 1:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones | zeros, ones))
        for i in range(len(self.levels) - 1):  # what a parent has factored out is not looked at again below it
            above = np.repeat(self.levels[i + 1][0], FAN)[: len(self.levels[i][0])]
            self.levels[i] = (self.levels[i][0] & ~above, self.levels[i][1])

    def within(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, place in ``fps``) of every pair that differs in at most ``limit`` bits."""
        q, node, sums = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for mask, pattern in reversed(self.levels):
            keep = node < len(mask)
            q, node, sums = q[keep], node[keep], sums[keep]
            sums = sums + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            keep = sums <= limit
            q, node, sums = (np.repeat(x[keep], FAN) for x in (q, node, sums))
            node = node * FAN + np.tile(np.arange(FAN), len(node) // FAN)
        keep = node < len(self.fps)
        q, node = q[keep], node[keep]
        keep = np.bitwise_count(queries[q] ^ self.fps[node]) <= limit
        return q[keep], node[keep]


def links_within(fps: np.ndarray, limit: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``fps`` that connect everything within ``limit`` bits: a star for each component of the group."""
    index = GrayIndex(fps)
    root = np.arange(len(fps))
    for a in range(0, len(fps), block):
        q, x = index.within(index.fps[a : a + block], limit)
        _unite(root, q + a, x)
    away = np.flatnonzero(root != np.arange(len(fps)))
    return index.fps[root[away]], index.fps[away]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of all pairs in place; every entry ends at the least of its component."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


# ---- over the cluster


def _patterns(fp: Column, bits: list[list[int]]) -> Column:
    """One struct (mask, bits under it) for each pair of blocks."""
    masks = [sum(1 << b for b in x + y) for x, y in combinations(bits, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("mask"), fp.bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)])


def _blocks(bits: list[int], n: int = 4) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def nodes(fps: DataFrame, refine: int = REFINE) -> DataFrame:
    """(mask, part, mask2, part2, fp): every distinct fingerprint in each of its nodes. Nodes of one member are left out."""
    blocks = _blocks(list(range(64)))
    first = fps.select("fp", F.explode(_patterns(F.col("fp"), blocks)).alias("n")).select("fp", "n.mask", "n.part")
    sizes = first.groupBy("mask", "part").agg(F.count("*").alias("size")).where("size > 1")
    placed = first.join(sizes, ["mask", "part"])
    few = placed.where(F.col("size") <= refine).select("mask", "part", F.lit(-1).alias("mask2"), F.lit(0).cast("bigint").alias("part2"), "fp")
    finer = [
        F.when(F.col("mask") == i, _patterns(F.col("fp"), _blocks([b for k, x in enumerate(blocks) if k not in pair for b in x])))
        for i, pair in enumerate(combinations(range(4), 2))
    ]
    many = placed.where(F.col("size") > refine).select("mask", "part", "fp", F.explode(F.coalesce(*finer)).alias("n"))
    return few.unionByName(many.select("mask", "part", F.col("n.mask").alias("mask2"), F.col("n.part").alias("part2"), "fp"))


def links(fps: DataFrame, limit: int = 2, refine: int = REFINE) -> DataFrame:
    """(src, dst) of fingerprints whose links give the same components as all pairs within ``limit`` bits, at most 2.

    ``fps``: distinct ``fp``. Nodes are dealt whole to tasks and read in order;
    a task holds one node at a time.
    """
    if not 0 <= limit <= 2:
        raise ValueError("the nodes are exact for at most two differing bits")
    names = ["mask", "part", "mask2", "part2"]
    grouped = nodes(fps, refine).repartition(*names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((0, 5), np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(1)])
            size = np.diff(np.r_[cut, len(rows)])
            fp = rows[:, 4].astype(np.int64).view(np.uint64)
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            small = np.repeat(size <= FAN, size)
            node = np.repeat(np.arange(len(cut)), size)
            for d in range(1, FAN):  # small nodes are leaves: compared directly, all nodes at once
                if d < len(rows):
                    same = np.flatnonzero(small[:-d] & (node[d:] == node[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= limit))
                    a.append(fp[same])
                    b.append(fp[same + d])
            for i in np.flatnonzero(size > FAN):
                x, y = links_within(fp[cut[i] : cut[i] + size[i]], limit)
                a.append(x)
                b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["src", "dst"])

        for batch in batches:
            rows = np.concatenate([tail, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(np.int64)])
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1)) if len(rows) else np.zeros(0, int)
            stop = last[-1] + 1 if len(last) else 0
            if stop:
                yield found(rows[:stop])
            tail = rows[stop:]
        if len(tail):
            yield found(tail)

    return in_arrow(grouped.select(*names, "fp"), run, "src bigint, dst bigint").distinct()


def components(fps: DataFrame, limit: int = 2, key: str = "doc_id", refine: int = REFINE) -> DataFrame:
    """``fps`` (key, fp) with component_id: the smallest key reachable by links of at most ``limit`` bits.

    Equal fingerprints link. A null key is never the smallest unless alone.
    Copies meet only in sums (the least key of each fingerprint), combined
    before the shuffle; links are between distinct fingerprints. Rows that repeat
    are returned each; an empty table gives an empty one.
    """
    least = materialize(fps.groupBy("fp").agg(F.min(key).alias("least")))
    groups = connected_components(links(least.select("fp"), limit, refine))
    of = least.join(groups.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(fps.join(of.select("fp", "root").join(smallest, "root").drop("root"), "fp"))
    discard(least)
    discard(groups)
    return found


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint of three-word shingles and the component of fingerprints within two bits."""
    fps = materialize(fingerprints(documents(spark, sf_dir)))
    found = components(fps)
    discard(fps)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
