"""Near duplicates by wide SimHash fingerprints: texts whose sets of five-word shingles are at least 0.8 alike (Jaccard).

At that similarity two fingerprints differ in a seventh of their bits, too many
for an index of two bits. Each text therefore has a wide fingerprint: its
shingles are summed with random signs into SKETCH buckets, a Hadamard rotation
turns the sums into SKETCH projections, and their signs are the bits. Keys come
from the projections that are most certain: a key names, for two other rotations
of BLOCK projections, the one farthest from zero and its sign. Near duplicates
mostly agree in those. A text is listed under PROBES keys of each of TABLES
pairs of rotations, the runners-up included. The keys are the same for every
size of table, and so is the chance that near duplicates share one. Small sets of
shingles are listed under their lowest hashes instead, which misses nothing.

A key that more than LEAF texts have is left, as its rows stream by, for finer ones:
its texts are listed anew under the strongest projections of a further rotation,
REFINED for each, and so on for LEVELS. Keys of lowest hashes stay as they are.

Under a key few texts are compared pair by pair. Where many are near each other,
each is compared with a few that come first in a fixed order (the same under every
key, so that one text serves them all); what that leaves in different components
is then compared pair by pair, in tiles of bounded size that texts reach with their
shingles, and only links that join components leave a tile. A text copied with changes a great many times meets its like in the partition that
it is read in, and only those which come first go on to the others. The
fingerprints estimate the similarity; what is not clear is decided by the
shingles themselves.

Before that, the dealt index has its turn: 64-bit fingerprints of three-word
shingles, within two bits of each other by masked patterns and the Gray-order
hierarchy (``simhash``). What it links is decided by the shingles too, so that
both ways find the same thing: texts that it has joined are one component when
the tiles ask what is still apart, and a close pair that shares no key is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import in_arrow, per_batch
from weftgraph.llm.simhash import FAN, fingerprints, hashed, links, shingles
from weftgraph.operators.components import connected_components
from weftgraph.plans.lineage import discard, materialize

SHINGLE, SIMILARITY = 5, 0.8
#: Buckets of the sketch, and bits of a fingerprint; projections of a rotation that a key chooses from.
SKETCH, BLOCK = 4096, 1024
#: Pairs of rotations, and keys for each: texts 0.8 alike share one of a pair's keys in 48 %, so one of all in 99.9 %.
TABLES, PROBES = 12, 4
#: Estimates this far above the threshold count as clear, and those this far below as unlike. Their standard deviation is
#: 0.016 (0.019 for sets of 64 shingles): over four of them above, and 99.9 % of pairs 0.8 alike are within those below.
ABOVE, BELOW = 0.07, 0.055
#: Pairs with a set of fewer shingles are decided by the shingles alone: their projections are too coarse.
SMALL = 64
#: Bits of 96 in which texts under one key may differ to be compared at all: 0.8 gives 15, 18 for the smallest sets; 4.5 deviations more.
NEAR, NEAR_SMALL = 31, 36
#: Texts that the others of a dense group are compared with at first; members of a group up to which all pairs are looked at.
ROUNDS, LEAF = 8, 4096
#: Finer keys for each key that too many texts have, and how often keys are refined: what 0.8 alike share a finer key is
#: tested to be so much that, with the tables, 99 % of pairs still share one.
REFINED, LEVELS = 3, 3
#: Members that a group has in one partition before only those which come first go on.
HOT = 64
#: Members of a group compared with each other at once and their shingles (eight bytes each); pairs at once.
TILE, TILE_SHINGLES, PAIRS = 4096, 1 << 22, 1 << 14
#: Rows up to which ids are broadcast (8 bytes each).
MOST_BROADCAST = 1_000_000

_RANDOM = np.random.default_rng(8)
_FOLD = _RANDOM.choice(np.float32([-1, 1]), SKETCH)
_SIGNS = _RANDOM.choice(np.float32([-1, 1]), (2 * TABLES, BLOCK))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


_H = {n * n: hadamard(n) for n in (32, 64)}


def rotated(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of every row: whole numbers stay whole, so results don't depend on the order of sums."""
    h = _H[x.shape[1]]
    return (h @ (x.reshape(len(x), *h.shape) @ h)).reshape(x.shape)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Sums of the hashes of each set in SKETCH buckets: with a sign, and weights of 7 to 9 so that sums of few are seldom zero."""
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    weight = (7 + (h >> np.uint64(16)) % np.uint64(3)).astype(float) * (1 - 2 * (h >> np.uint64(12) & np.uint64(1)).astype(float))
    place = row * SKETCH + (h & np.uint64(SKETCH - 1)).astype(np.int64)
    return np.bincount(place, weight, len(sets) * SKETCH).reshape(-1, SKETCH).astype(np.float32)


def strongest(z: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` places of each row that are farthest from zero, twice the place plus the sign, and how far they are."""
    far, rows = np.abs(z), np.arange(len(z))
    code, size = np.empty((k, len(z)), np.int64), np.empty((k, len(z)), np.float32)
    for i in range(k):
        at = far.argmax(1)
        code[i], size[i] = 2 * at + (z[rows, at] > 0), far[rows, at]
        far[rows, at] = -1
    return code, size


def keys_of(x: np.ndarray) -> np.ndarray:
    """The keys of each sketch: table above, and for two rotations a strong projection with its sign."""
    folded = (x * _FOLD).reshape(len(x), -1, BLOCK).sum(1)
    out = []
    for t in range(TABLES):
        (one, far), (two, away) = (strongest(rotated(folded * _SIGNS[2 * t + i])) for i in range(2))
        ways = list(product(range(len(one)), repeat=2))
        less = np.stack([far[0] - far[i] + away[0] - away[j] for i, j in ways], 1)
        keys = np.stack([(t * 2 * BLOCK + one[i]) * 2 * BLOCK + two[j] for i, j in ways], 1)
        out.append(np.take_along_axis(keys, np.argsort(less, axis=1, kind="stable")[:, :PROBES], 1))
    return np.concatenate(out, 1)


def prefix_keys(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a small set: its lowest hashes, as many that two sets so similar must share one of them. Sets that only copies are like have none."""
    n = len(hashes)
    need = int(np.ceil(similarity * n - 1e-9))
    if int(np.ceil(similarity * (n + 1) - 1e-9)) > n and need >= n:
        return np.zeros(0, np.int64)
    low = np.sort(hashes)[: n - need + 1]
    return (low >> np.uint64(1)).view(np.int64) | np.int64(1 << 62)


def jaccard_estimate(differing: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sets of a and b shingles whose fingerprints differ in so many bits: the angle gives the cosine, it gives the overlap."""
    common = np.cos(np.pi * differing / SKETCH) * np.sqrt(a.astype(float) * b)
    return common / np.maximum(a + b - common, 1e-9)


def shingle_hashes(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(hashed(shingles(text, SHINGLE)))


def set_of_each(rows: DataFrame) -> DataFrame:
    """(doc, hashes) of (doc, text): the hashes of the shingles, eight bytes each."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc": batch.column("doc"), "hashes": [shingle_hashes(v.as_py() or "").tobytes() for v in batch.column("text")]}

    return per_batch(rows, run, "doc bigint, hashes binary")


def profiles(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, same, n, print, near, more, keys) of (doc, text): a name that copies share, shingles, fingerprint, its first 64 bits, 32 further bits above n, keys.

    Sets that can be like one below SMALL are listed under their lowest hashes,
    which misses nothing; those that can be like one from SMALL on under projections.
    """

    def some(docs: list[int], sets: list[np.ndarray]) -> dict:
        x = sketches(sets)
        bits = np.packbits(rotated(x) > 0, axis=1)
        n = np.array([len(s) for s in sets])
        more = bits[:, 8:12].copy().view(">u4").ravel().astype(np.int64) << 32 | n
        listed = list(keys_of(x))
        for i in np.flatnonzero(similarity * n < SMALL):
            low = prefix_keys(sets[i], similarity)
            listed[i] = low if n[i] < SMALL else np.concatenate([listed[i], low])
        return {
            "doc": docs,
            "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "n": n.astype(np.int32),
            "print": [b.tobytes() for b in bits],
            "near": bits[:, :8].copy().view(">i8").ravel().astype(np.int64),
            "more": more,
            "keys": [np.unique(k) for k in listed],
        }

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            yield some(part.column("doc"), [shingle_hashes(v.as_py() or "") for v in part.column("text")])

    return per_batch(rows, run, "doc bigint, same binary, n int, print binary, near bigint, more bigint, keys array<bigint>")


def may_match(fp: np.ndarray, more: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts in places ``i`` and ``j`` can be alike, by the sizes of their sets and 96 bits of their fingerprints."""
    n = (more & np.uint64(0xFFFFFFFF)).astype(np.int64)
    least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    off = np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count((more[i] ^ more[j]) >> np.uint64(32))
    return (least >= similarity * most) & (off <= np.where(least < SMALL, NEAR_SMALL, NEAR))


def all_pairs(fp: np.ndarray, more: np.ndarray, similarity: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a group that may match, by place."""
    found = [np.zeros((2, 0), np.int64)]
    for s in range(0, len(fp), block):
        off = np.bitwise_count(fp[s : s + block, None] ^ fp[s:]) + np.bitwise_count((more[s : s + block, None] ^ more[s:]) >> np.uint64(32))
        i, j = np.nonzero(off <= NEAR_SMALL)
        i, j = s + i[i < j], s + j[i < j]
        ok = may_match(fp, more, i, j, similarity)
        found.append(np.stack([i[ok], j[ok]]))
    return tuple(np.concatenate(found, 1))


def stars(group: np.ndarray, order: np.ndarray, fp: np.ndarray, more: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, first), by place: for each group its first text by ``order`` with all that may match it; then so for the rest, ROUNDS times."""
    rest = np.lexsort((order, group))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _ in range(ROUNDS):
        if not len(rest):
            break
        head = np.r_[True, group[rest[1:]] != group[rest[:-1]]]
        first = rest[head][np.cumsum(head) - 1]
        close = ~head & may_match(fp, more, rest, first, similarity)
        a.append(rest[close])
        b.append(first[close])
        rest = rest[~head & ~close]
    return np.concatenate(a), np.concatenate(b)


def in_fixed_order(doc: np.ndarray) -> np.ndarray:
    """A number for each text, the same under all keys."""
    x = doc.view(np.uint64) * _MIX
    return (x ^ (x >> np.uint64(32))) * _MIX


def by_key(fn: Callable[..., Iterator[pa.RecordBatch]], most: int | None = None, beyond: Callable[..., Iterator[pa.RecordBatch]] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` of the columns of whole keys, over batches in order of their first column. Only a key that goes on in the next batch is put together, once.

    A key that goes on and has over ``most`` rows already is not: ``beyond`` gets
    its rows as they come, and no more than a batch and ``most`` rows are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        passing = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, begin = batch.column(0).to_numpy(), 0
            if passing is not None and key[0] == passing:
                begin = int(np.searchsorted(key, passing, side="right"))
                yield from beyond(*batch.slice(0, begin).columns)
                if begin == len(key):
                    continue
                batch, key, begin = batch.slice(begin), key[begin:], 0
            passing = None
            last = int(np.searchsorted(key, key[-1]))  # where the last key begins
            if held:
                if held[0].column(0)[0].as_py() == key[0]:
                    begin = int(np.searchsorted(key, key[0], side="right"))
                    held.append(batch.slice(0, begin))
                    if most is not None and sum(b.num_rows for b in held) > most:
                        for b in held:
                            yield from beyond(*b.columns)
                        passing = key[0]
                if passing is None:
                    if begin == len(key):
                        continue
                    yield from fn(*pa.Table.from_batches(held).combine_chunks().columns)
                held = []
                if begin == len(key):
                    continue
            if last > begin:
                yield from fn(*batch.slice(begin, last - begin).columns)
            held, passing = [batch.slice(last)], None
        if held:
            yield from fn(*pa.Table.from_batches(held).combine_chunks().columns)

    return run


def groups_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin, and how many members they have."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return cut, np.diff(np.r_[cut, len(key)])


def forwarded(listed: DataFrame, similarity: float) -> DataFrame:
    """(key, doc, near, more, first, stands) of (doc, near, more, keys), every text under every key.

    Where a partition has HOT texts under a key, most have ``first``: a text of the
    group and partition that they may match, and that ``stands`` for them.
    """
    rows = listed.select(F.explode("keys").alias("key"), "doc", "near", "more").sortWithinPartitions("key")

    def run(*cols: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        key, doc, near, more = (c.to_numpy() for c in cols)
        cut, size = groups_of(key)
        group = np.repeat(np.arange(len(cut)), size)
        first, stands = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        led = np.zeros(len(key), bool)
        at = np.flatnonzero(size[group] >= HOT)
        if len(at):
            m, c = stars(group[at], in_fixed_order(doc[at]), near[at].view(np.uint64), more[at].view(np.uint64), similarity)
            first[at[m]], led[at[m]], stands[at[c]] = doc[at[c]], True, True
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (key, doc, near, more)), pa.array(first, mask=~led), pa.array(stands)], names=["key", "doc", "near", "more", "first", "stands"])

    return in_arrow(rows, by_key(run), "key bigint, doc bigint, near bigint, more bigint, first bigint, stands boolean")


def candidate_pairs(listed: DataFrame, similarity: float = SIMILARITY, leaf: int = LEAF) -> DataFrame:
    """(key, a, b, over) of (doc, near, more, keys): texts to compare, a < b and no key; members a of dense groups, b null; and members of keys that over ``leaf`` texts have, ``over``.

    All pairs of a group that may match are there, and those of a dense one (with
    more pairs than could be a forest, or HOT in a partition) with its first
    texts; all its members that may match any are listed. A key that too many
    have is not looked at further: they want finer ones.
    """
    rows = forwarded(listed, similarity)
    to = F.when(F.col("first").isNull(), F.col("key")).otherwise(F.col("doc"))  # what another text stands for is spread
    rows = rows.withColumn("to", to).repartition("to").drop("to").sortWithinPartitions("key")

    def pairs(*cols: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        led = cols[4].is_valid().to_numpy(zero_copy_only=False)
        key, doc, near, more, first = (c.fill_null(0).to_numpy() for c in cols[:5])
        stands = cols[5].to_numpy(zero_copy_only=False)
        a, b, names, members = [doc[led]], [first[led]], [key[led]], [doc[led]]
        key, doc, fp, more, stands = key[~led], doc[~led], near[~led].view(np.uint64), more[~led].view(np.uint64), stands[~led]
        if len(key):
            cut, size = groups_of(key)
            group = np.repeat(np.arange(len(cut)), size)
            forward = np.logical_or.reduceat(stands, cut)
            i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            at = np.flatnonzero((size[group] > 1) & (size[group] <= min(FAN, leaf)))
            for d in range(1, min(FAN, len(at))):
                same = np.flatnonzero(group[at[d:]] == group[at[:-d]])
                x, y = at[same], at[same + d]
                ok = may_match(fp, more, x, y, similarity)
                i.append(x[ok])
                j.append(y[ok])
            over = size > leaf
            for g in np.flatnonzero((size > FAN) & ~over):
                x, y = all_pairs(fp[cut[g] : cut[g] + size[g]], more[cut[g] : cut[g] + size[g]], similarity)
                i.append(cut[g] + x)
                j.append(cut[g] + y)
            i, j = np.concatenate(i), np.concatenate(j)
            dense = (np.bincount(group[i], minlength=len(cut)) >= size) & ~over
            near_any = np.zeros(len(key), bool)
            near_any[i] = near_any[j] = True
            keep = ~dense[group[i]]
            at = np.flatnonzero(dense[group])
            m, c = stars(group[at], in_fixed_order(doc[at]), fp[at], more[at], similarity)
            a.extend([doc[i[keep]], doc[at[m]]])
            b.extend([doc[j[keep]], doc[at[c]]])
            open_ = forward[group] & (~over[group] | stands) | dense[group] & near_any
            names.append(key[open_])
            members.append(doc[open_])
            if over.any():
                yield listing(key[over[group]], doc[over[group]], True)
        yield pairing(np.concatenate(a), np.concatenate(b))
        yield listing(np.concatenate(names), np.concatenate(members), False)

    def pairing(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.zeros(len(both), bool))], names=["key", "a", "b", "over"])

    def listing(key: np.ndarray, doc: np.ndarray, over: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.nulls(len(doc), pa.int64()), pa.array(np.full(len(doc), over))], names=["key", "a", "b", "over"])

    def beyond(*cols: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        led = cols[4].is_valid().to_numpy(zero_copy_only=False)
        key, doc, first = (c.fill_null(0).to_numpy() for c in (cols[0], cols[1], cols[4]))
        stands = cols[5].to_numpy(zero_copy_only=False)
        yield pairing(doc[led], first[led])
        yield listing(key[led | stands], doc[led | stands], False)
        yield listing(key[~led], doc[~led], True)

    return in_arrow(rows, by_key(pairs, leaf, beyond), "key bigint, a bigint, b bigint, over boolean")


def finer_keys(x: np.ndarray, at: np.ndarray, key: np.ndarray, level: int) -> np.ndarray:
    """REFINED keys for each ``key``, of the sketch in row ``at`` of ``x``: the key and a strong projection of a rotation of the key's table and the level."""
    folded = (x * _FOLD).reshape(len(x), -1, BLOCK).sum(1)
    table = np.where(key >> np.int64(61) & 1, key & np.int64(15), key // (2 * BLOCK) ** 2)
    out = np.zeros((len(key), REFINED), np.int64)
    for t in np.unique(table):
        own = np.flatnonzero(table == t)
        signs = np.random.default_rng([8, level, int(t)]).choice(np.float32([-1, 1]), BLOCK)
        rows, back = np.unique(at[own], return_inverse=True)
        code = strongest(rotated(folded[rows] * signs), REFINED)[0][:, back]
        mixed = (key[own].view(np.uint64) + np.uint64(level)) * _MIX ^ code.astype(np.uint64)
        mixed = (mixed ^ mixed >> np.uint64(32)) * _MIX
        mixed = mixed ^ mixed >> np.uint64(29)
        out[own] = ((mixed >> np.uint64(7) << np.uint64(4)).view(np.int64) | np.int64(1 << 61) | np.int64(t)).T
    return out


def refined(over: DataFrame, rows: DataFrame, listed: DataFrame, level: int) -> DataFrame:
    """(doc, near, more, keys): the texts of ``over`` (key, doc) under finer keys. A text is cut into shingles once more, whatever its keys."""
    of = over.groupBy("doc").agg(F.collect_set("key").alias("old"))  # a text has a bounded number of keys
    few = over.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    wanted = rows.join(F.broadcast(of) if few else of, "doc").select("doc", "text", "old")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            x = sketches([shingle_hashes(v.as_py() or "") for v in part.column("text")])
            old = part.column("old")
            sizes = old.value_lengths().to_numpy()
            keys = finer_keys(x, np.repeat(np.arange(len(sizes)), sizes), old.flatten().to_numpy(), level)
            yield {"doc": part.column("doc"), "keys": [k.ravel() for k in np.split(keys, np.cumsum(sizes)[:-1])]}

    return per_batch(wanted, run, "doc bigint, keys array<bigint>").join(listed.select("doc", "near", "more"), "doc")


def joined_by(root: np.ndarray, x: int, ys: np.ndarray) -> Iterator[int]:
    """Those of ``ys``, in order, that bring ``x`` another component; ``root`` (the first place of each component) is kept up to date."""
    for y in ys:
        if (p := root[x]) != (q := root[y]):
            root[root == max(p, q)] = min(p, q)
            yield y


def apart_in_tile(doc: np.ndarray, of: np.ndarray, n: np.ndarray, wide: np.ndarray, home: np.ndarray, hashes: np.ndarray, similarity: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links of a text at ``home`` and a visitor that are alike and in different components ``of``: a forest that joins all that such pairs would join.

    ``hashes`` has the sets of all texts, one after the other, of ``n`` each.
    """
    start = np.cumsum(n) - n
    order = np.argsort(n, kind="stable")
    doc, n, wide, home, start = doc[order], n[order], wide[order], home[order], start[order]
    root = np.unique(of[order], return_inverse=True)[1]
    root = np.unique(root, return_index=True)[1][root]
    a, b = [], []
    for s in range(0, len(doc), block):
        e = min(s + block, len(doc))
        end = np.searchsorted(n, n[e - 1] / similarity + 1e-9, side="right")
        other = (root[s:e, None] != root[s:end]) & (home[s:e, None] != home[s:end])
        if not other.any():
            continue
        off = np.zeros(other.shape, np.int16)
        for w in range(2):
            off += np.bitwise_count(wide[s:e, None, w] ^ wide[s:end, w])
        limit = np.where(n[s:e] < SMALL, NEAR_SMALL, NEAR) * 4 // 3
        i, j = np.nonzero(other & (off <= limit[:, None]))
        i, j = i + s, j + s
        keep = (i < j) & (n[i] >= similarity * n[j]) & (doc[i] != doc[j])
        i, j = i[keep], j[keep]
        bits = np.concatenate([np.bitwise_count(wide[i[k : k + PAIRS]] ^ wide[j[k : k + PAIRS]]).sum(1, dtype=np.int64) for k in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)])
        alike = np.where(n[i] < SMALL, similarity, jaccard_estimate(bits, n[i], n[j]))
        order = np.lexsort((-alike, i))  # the likeliest first
        i, j, alike = i[order], j[order], alike[order]
        for x, y, likely in _runs(i, j, alike, similarity - BELOW):
            for z in joined_by(root, x, y[likely >= similarity + ABOVE]):
                a.append(x)
                b.append(z)
            y = y[(likely < similarity + ABOVE) & (root[y] != root[x])]
            if len(y):
                common = _common(hashes, start[x], n[x], start[y], n[y])
                for z in joined_by(root, x, y[common >= similarity * (n[x] + n[y] - common)]):
                    a.append(x)
                    b.append(z)
    return doc[np.array(a, int)], doc[np.array(b, int)]


def _runs(i: np.ndarray, j: np.ndarray, alike: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, its j, their estimates) of pairs in order of i, without those below ``least``."""
    keep = alike >= least
    i, j, alike = i[keep], j[keep], alike[keep]
    if len(i):
        for s, size in zip(*groups_of(i)):
            yield int(i[s]), j[s : s + size], alike[s : s + size]


def _common(hashes: np.ndarray, at: int, n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of the ``n`` hashes from ``at`` are in each of the other sets. Sets are sorted."""
    own = hashes[at : at + n]
    cut = np.cumsum(sizes) - sizes
    others = hashes[np.repeat(starts - cut, sizes) + np.arange(sizes.sum())]
    found = own[np.minimum(np.searchsorted(own, others), n - 1)] == others
    return np.add.reduceat(found, cut, dtype=np.int64)


def in_tiles(members: DataFrame, of: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, doc, of, home): ``members`` (key, doc) of groups with several components, under keys of tiles: at home some TILE texts and TILE_SHINGLES shingles at most, and as many visitors.

    All members are at home in one of the group's tiles. Those outside of its
    largest component visit every tile, so every two members of different
    components meet once at least.
    """
    docs = members.groupBy("doc").agg(F.collect_list("key").alias("keys"))  # a text has a bounded number of keys
    docs = docs.join(of.toDF("doc", "of"), "doc", "left").join(listed.select("doc", "n"), "doc")
    every = materialize(docs.select(F.explode("keys").alias("key"), "doc", F.coalesce("of", "doc").alias("of"), "n"))
    sizes = every.groupBy("key", "of").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max_by(F.struct("of", "size", "n"), F.struct("size", "of")).alias("most"))
    rows = every.drop("n").join(sizes.where("size > most.size"), "key")
    parts = lambda size, n: F.greatest(F.ceil(size / TILE), F.ceil(n / TILE_SHINGLES))
    tiles, shares = parts(F.col("size"), F.col("n")), parts(F.col("size") - F.col("most.size"), F.col("n") - F.col("most.n"))
    at = lambda n, seed: F.pmod(F.xxhash64("doc", F.lit(seed)), n)
    up_to = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    homes = rows.select("key", "doc", "of", F.lit(True).alias("home"), at(tiles, 1).alias("tile"), F.explode(up_to(shares)).alias("share"))
    visits = rows.where(F.col("of") != F.col("most.of")).select("key", "doc", "of", F.lit(False).alias("home"), F.explode(up_to(tiles)).alias("tile"), at(shares, 2).alias("share"))
    dealt = materialize(homes.unionByName(visits).select(F.xxhash64("key", "tile", "share").alias("key"), "doc", "of", "home"))
    discard(every)
    return dealt


def links_in_dense(members: DataFrame, listed: DataFrame, rows: DataFrame, of: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: links of dense groups' ``members`` (key, doc) that join what is alike and in different components ``of`` (v, component).

    Texts come with their sets of shingles, so pairs are decided where they meet,
    and a tile sends fewer links than it has texts.
    """
    dealt = in_tiles(members, of, listed)
    ids = dealt.select("doc").distinct()
    few = dealt.count() <= MOST_BROADCAST
    wanted = rows.join(F.broadcast(ids) if few else ids, "doc", "left_semi")
    sets = listed.select("doc", "n", "print").join(set_of_each(wanted), "doc")
    sent = dealt.join(sets, "doc").select("key", "doc", "of", "n", "home", "print", "hashes").repartition("key").sortWithinPartitions("key")

    def links(*cols: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        key, doc, of, n = (c.to_numpy() for c in cols[:4])
        home, n = cols[4].to_numpy(zero_copy_only=False), n.astype(np.int64)
        for s, size in zip(*groups_of(key)):
            e = s + size
            wide, hashes = (np.frombuffer(b"".join(c.slice(s, size).to_pylist()), np.uint64) for c in cols[5:])
            x, y = apart_in_tile(doc[s:e], of[s:e], n[s:e], wide.reshape(size, -1), home[s:e], hashes, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    found = materialize(in_arrow(sent, by_key(links), "a bigint, b bigint").distinct())
    discard(dealt)
    return found


def only_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (doc, ...) that ``pairs`` (a, b) name."""
    ids = pairs.select("a").distinct().union(pairs.select("b").distinct()).toDF("doc").distinct()
    return rows.join(F.broadcast(ids) if 2 * pairs.count() <= MOST_BROADCAST else ids, "doc", "left_semi")


def similarity_of(pairs: DataFrame, listed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``pairs`` (a, b) with the estimate of their similarity; ``similarity`` itself where a set is SMALL, 0 where sizes rule it out."""
    one = only_of(pairs, listed.select("doc", "n", "print"))
    both = pairs.join(one.toDF("a", "n_a", "p_a"), "a").join(one.toDF("b", "n_b", "p_b"), "b")

    def run(batch: pa.RecordBatch) -> dict:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for c in ("p_a", "p_b"))
        off = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        least, most = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
        alike = np.where(least < SMALL, similarity, jaccard_estimate(off, n_a, n_b))
        return {"a": batch.column("a"), "b": batch.column("b"), "alike": np.where(least >= similarity * most, alike, 0.0)}

    return per_batch(both, run, "a bigint, b bigint, alike double")


def exactly_alike(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets of shingles, of the texts in ``rows`` (doc, text), are at least so similar.

    A text is cut into shingles once, however many pairs it is in; pairs see hashes.
    """
    pairs = materialize(pairs)
    sets = materialize(set_of_each(only_of(pairs, rows)))
    both = pairs.join(sets.toDF("a", "h_a"), "a").join(sets.toDF("b", "h_b"), "b")

    def run(batch: pa.RecordBatch) -> dict:
        keep = []
        for s, t in zip(batch.column("h_a"), batch.column("h_b")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common >= similarity * (len(x) + len(y) - common))
        mask = pa.array(keep, pa.bool_())
        return {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

    found = materialize(per_batch(both, run, "a bigint, b bigint"))
    discard(pairs)
    discard(sets)
    return found


def links_of(compared: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of ``compared`` (a, b, alike) that are clear, and those alike by their shingles of the doubtful ones that others leave apart, the likely ones first."""
    pairs = materialize(compared.where(F.col("alike") >= similarity - BELOW))
    found = materialize(pairs.where(F.col("alike") >= similarity + ABOVE).select("a", "b"))
    end = lambda c: F.coalesce(F.col(f"c_{c}"), F.col(c))
    for low, high in ((similarity, similarity + ABOVE), (similarity - BELOW, similarity)):
        of = connected_components(found, "a", "b")
        open_ = pairs.where((F.col("alike") >= low) & (F.col("alike") < high)).select("a", "b")
        open_ = open_.join(of.toDF("a", "c_a"), "a", "left").join(of.toDF("b", "c_b"), "b", "left").where(end("a") != end("b")).select("a", "b")
        found = found.unionByName(exactly_alike(open_, rows, similarity))
        discard(of)
    discard(pairs)
    return found


def indexed_links(firsts: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: texts (doc) that the Gray-order index links, by fingerprints of ``rows`` (doc, text) within two bits, and that are alike by their shingles.

    Texts of one fingerprint are compared with the first of them, and the first
    texts of linked fingerprints with each other: as many pairs as texts and links.
    """
    fps = materialize(fingerprints(rows.join(firsts.select("doc"), "doc", "left_semi"), key="doc"))
    least = materialize(fps.groupBy("fp").agg(F.min("doc").alias("least")))
    same = fps.join(least, "fp").where("doc > least").select(F.col("least").alias("a"), F.col("doc").alias("b"))
    near = links(least.select("fp")).join(least.toDF("src", "x"), "src").join(least.toDF("dst", "y"), "dst").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = exactly_alike(same.unionByName(near).distinct(), rows, similarity)
    discard(fps)
    discard(least)
    return found


def groups(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """(doc, first): every row that is not the first of its group of near duplicates, and the smallest key of the group.

    Keys are numbers, or texts of numbers. Rows that share a key are one text,
    the smallest; rows without a key take no part. Texts without words are copies
    of each other, and null texts have none. ``leaf``: texts that a key of
    projections may have before they are listed under finer ones.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    temporary = []

    def kept(df: DataFrame) -> DataFrame:
        temporary.append(materialize(df))
        return temporary[-1]

    if not rows.groupBy("doc").count().where("count > 1").isEmpty():
        rows = kept(rows.groupBy("doc").agg(F.min("text").alias("text")))
    listed = kept(profiles(rows, similarity))
    copies = kept(listed.groupBy("same").agg(F.min("doc").alias("first"), F.count("*").alias("size")))
    more = listed.select("doc", "same").join(copies.where("size > 1"), "same").where("doc <> first").select("doc", "first")
    firsts = listed.join(copies.select(F.col("first").alias("doc")), "doc", "left_semi")
    found = kept(candidate_pairs(firsts, similarity, leaf))
    pairs, members, projected = found.where("b is not null"), found.where("b is null and not over"), F.col("key") < F.lit(1 << 62)
    for level in range(1, LEVELS + 1):
        over = found.where("over")
        if over.isEmpty():
            break
        members = members.unionByName(over.where(~projected))
        led = found.where("b is null and not over").join(over.select("key").distinct(), "key", "left_semi")  # their likes may be among the rest
        all_ = over.unionByName(led.select(*over.columns)).where(projected).select("key", F.col("a").alias("doc")).distinct()
        finer = kept(refined(all_, rows, listed, level))
        found = kept(candidate_pairs(finer, similarity, leaf))
        pairs, members = pairs.unionByName(found.where("b is not null")), members.unionByName(found.where("b is null and not over"))
    else:
        members = members.unionByName(found.where("over"))
    near = kept(pairs.select("a", "b").distinct())
    linked = links_of(similarity_of(near, listed, similarity), rows, similarity).unionByName(indexed_links(firsts, rows, similarity))
    of = connected_components(linked, "a", "b")
    linked = linked.unionByName(links_in_dense(members.select("key", F.col("a").alias("doc")), listed, rows, of, similarity))
    joined = connected_components(linked, "a", "b").toDF("first", "least")
    out = more.join(joined, "first", "left").select("doc", F.coalesce("least", "first").alias("first"))
    out = out.unionByName(joined.where("first <> least").toDF("doc", "first"))
    gone = materialize(out)
    for done in (*temporary, linked, of, joined):
        discard(done)
    return gone


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the row of smallest key of each group of near duplicates, and all rows that have none. Rows that repeat a key stay or go together."""
    gone = groups(docs, similarity, text, key).select(F.col("doc").alias(key))
    few = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, key, "left_anti")
