"""Sharding by best-fit-decreasing bin packing.

Rows of equal texts are a group that no shard boundary divides. Groups, largest
first, enter the open bin whose remaining capacity is the tightest that still
holds them; a new bin is opened where none does. Open bins are kept in a balanced
tree by what remains of them. What is packed is bounded whatever the table's
size: groups below a grain, a small part of a bin, are first dealt by hash to
parcels of about a grain each, and many bins are packed in several regions, each
by its own task. For a given number of shards the least capacity that suffices is
searched for; groups above an equal share get a shard of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import documents, free_name, in_arrow
from weftgraph.plans.lineage import discard, materialize

#: Grains that a number of shards are divided into; shards at most, so that one has 64 of them.
GRAINS, MOST_SHARDS = 1 << 17, 2048
#: Of fixed capacity: grains of a bin, and bins of a region.
BIN_GRAINS, REGION = 1 << 12, 32
#: Rows of the tables of units and of numbered cells up to which they are broadcast (at most 30 bytes each).
MOST_BROADCAST = 400_000


class Tree:
    """Keys in order, in leaves of bounded size below one root: adding and taking cost the logarithm of their number."""

    LEAF = 64

    def __init__(self) -> None:
        self.leaves: list[list] = []
        self.last: list = []

    def add(self, key) -> None:
        if not self.leaves:
            self.leaves, self.last = [[key]], [key]
            return
        i = min(bisect_left(self.last, key), len(self.last) - 1)
        leaf = self.leaves[i]
        insort(leaf, key)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[i : i + 1] = [leaf[:half], leaf[half:]]
            self.last[i : i + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.last[i] = leaf[-1]

    def take(self, least):
        """The smallest key that is at least ``least``, no longer in the tree; None if there is none."""
        i = bisect_left(self.last, least)
        if i == len(self.last):
            return None
        leaf = self.leaves[i]
        key = leaf.pop(bisect_left(leaf, least))
        if leaf:
            self.last[i] = leaf[-1]
        else:
            del self.leaves[i], self.last[i]
        return key


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each of ``sizes``, which fall; None if more than ``most`` bins would be opened.

    Equal sizes in a row fill the bin that they have entered as far as it goes,
    which stays the tightest. What exceeds the capacity has a bin of its own.
    """
    tree, bins, out, at = Tree(), 0, [], 0
    while at < len(sizes):
        size = sizes[at]
        run = at + 1
        while run < len(sizes) and sizes[run] == size:
            run += 1
        while at < run:
            left, bin_ = tree.take((size, -1)) or (max(capacity, size), bins)
            if bin_ == bins:
                bins += 1
                if most is not None and bins > most:
                    return None
            n = min(run - at, left // size)
            out += [bin_] * n
            at += n
            if left > n * size:
                tree.add((left - n * size, bin_))
    return out


def equal_fit(sizes: list[int], bins: int) -> list[int]:
    """The bin of each of ``sizes``, which fall, by best fit under the least capacity found to need no more than ``bins``."""
    rest, alone = sum(sizes), 0
    while alone < min(bins - 1, len(sizes)) and sizes[alone] * (bins - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    own, few = list(range(alone)), bins - alone
    sizes = sizes[alone:]
    if not sizes:
        return own
    low = max(-(-rest // few), sizes[0])
    found, step = best_fit(sizes, low, few), max(1, low >> 14)
    if found is None:
        while (found := best_fit(sizes, low + step, few)) is None:
            low, step = low + step, 2 * step
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            if (better := best_fit(sizes, middle, few)) is None:
                low = middle
            else:
                found, high = better, middle
    return own + [alone + b for b in found]


def _packed(units: DataFrame, count: int | None, capacity: int | None) -> DataFrame:
    """(region, big, x, y, bin) of units with their bytes: a region is packed as one, in one task."""
    order = ["region", F.desc("bytes"), "big", "x", "y"]

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = rows.column("bytes").to_pylist()
        bins = equal_fit(sizes, count) if count else best_fit(sizes, capacity)
        yield from rows.drop_columns(["bytes"]).append_column("bin", pa.array(bins, pa.int32())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            region = batch.column("region").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(region)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column("region")[0].as_py() != int(region[a]):
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from packed(pa.Table.from_batches(held))

    dealt = units.select("region", "big", "x", "y", "bytes").repartition("region").sortWithinPartitions(*order)
    return in_arrow(dealt, run, "region int, big boolean, x long, y long, bin int")


def _numbered(rows: DataFrame, shard: str, at: str) -> DataFrame:
    """``rows`` with ``at``: how many rows of the same shard come before in the same task."""
    schema = T.StructType([*rows.schema.fields, T.StructField(at, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            of = batch.column(shard).to_numpy()
            n = np.bincount(of, minlength=len(seen))
            seen = np.pad(seen, (0, len(n) - len(seen)))
            order = np.argsort(of, kind="stable")
            place = np.empty(len(of), np.int64)
            place[order] = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seen, n)
            seen = seen + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, at])

    return in_arrow(rows, run, schema)


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def shards(docs: DataFrame, count: int | None = None, capacity: int | None = None, text: str = "text", carry: list[str] | None = None, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: ``count`` shards of nearly equal bytes, or as few of ``capacity`` bytes as best fit decreasing finds.

    A row has the bytes of its text in UTF-8 and one more; null is the empty
    text. Rows of equal texts share a shard (equal: 128 bits of two hashes), so a
    group above an equal share, or above the capacity, has a shard of its own
    size. ``slot`` numbers a shard's rows from 0 without gaps, in the order in
    which tasks read them; the same files give the same slots. Shards may be
    empty where there are fewer groups; an empty table stays empty. Rows that
    repeat are placed each. ``carry`` names the columns of ``docs`` that are
    returned, all by default; those that have the new names are replaced. A
    group's rows are summed before they are shuffled, and no row moves to its
    shard: that is left to the writer. The result reads a table in the shared
    folder.
    """
    if (count is None) == (capacity is None) or (count if capacity is None else capacity) < 1 or (count or 0) > MOST_SHARDS:
        raise ValueError(f"give either a count of 1 to {MOST_SHARDS} shards or a capacity in bytes")
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in (shard.lower(), slot.lower())]
    a, b, cell, at, before, parcel, region, own, shared = (free_name([*docs.columns, shard, slot], n) for n in ("hash_a", "hash_b", "cell", "at", "before", "parcel", "region", "own_bin", "shared_bin"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keys = [F.xxhash64(body).alias(a), F.xxhash64(F.lit(12), body).alias(b)]
    groups = materialize(docs.select(*keys, (F.octet_length(body) + F.lit(1)).cast("bigint").alias("bytes")).groupBy(a, b).agg(F.sum("bytes").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    if count:
        regions, grain = 1, max(1, total // GRAINS)
    else:
        regions, grain = max(1, -(-total // (capacity * REGION))), max(1, capacity // BIN_GRAINS)
    sand = groups.where(F.col("bytes") < grain)
    parcels = max(1, -(-(sand.agg(F.sum("bytes")).first()[0] or 0) // (grain * regions)))

    def place(x: str, n: int) -> Column:
        return F.pmod(F.col(x), F.lit(n))

    in_region = place(b, regions).cast("int").alias("region")
    big = groups.where(F.col("bytes") >= grain).select(in_region, F.lit(True).alias("big"), F.col(a).alias("x"), F.col(b).alias("y"), "bytes")
    small = sand.groupBy(in_region, place(a, parcels).alias("x")).agg(F.sum("bytes").alias("bytes")).select("region", F.lit(False).alias("big"), "x", F.lit(0).cast("bigint").alias("y"), "bytes")
    packed = materialize(_packed(big.unionByName(small), count, capacity))
    if regions > 1:  # bins are numbered on through the regions, of which there is one for REGION bins
        sizes = packed.groupBy("region").agg((F.max("bin") + 1).alias("bins"))
        first = F.coalesce(F.sum("bins").over(Window.orderBy("region").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = packed.join(sizes.select("region", first.alias("first")), "region").withColumn("bin", (F.col("bin") + F.col("first")).cast("int"))
    else:
        bins = packed
    alone = bins.where("big").select(F.col("x").alias(a), F.col("y").alias(b), F.col("bin").alias(own))
    together = bins.where("not big").select(F.col("region").alias(region), F.col("x").alias(parcel), F.col("bin").alias(shared))
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], *keys).join(_few(alone), [a, b], "left")
    rows = rows.withColumns({region: place(b, regions).cast("int"), parcel: place(a, parcels)}).join(_few(together), [region, parcel], "left")
    placed = rows.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(own, shared).alias(shard), F.spark_partition_id().alias(cell))
    numbered = materialize(_numbered(placed, shard, at))
    discard(groups)
    discard(packed)
    cells = numbered.groupBy(shard, cell).agg((F.max(at) + 1).alias(before))
    earlier = F.coalesce(F.sum(before).over(Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select(shard, cell, earlier.alias(before))
    out = numbered.join(_few(offsets), [shard, cell])
    return out.select(*[F.col(f"`{c}`") for c in carried], shard, (F.col(before) + F.col(at)).alias(slot))


def op12_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes; equal texts share one."""
    body = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", "text", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    out = shards(docs, count=8, carry=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
