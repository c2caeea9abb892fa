"""Substring deduplication by recompression.

Rounds shorten every text by naming: first maximal runs of equal words, then,
round by round, neighbouring pairs whose first symbol falls into one half of the
symbols and whose second falls into the other. A name is a hash of what it
stands for, so all tasks name equal runs and pairs alike without exchanging a
table of names. Whether two symbols join depends on these two alone, so equal
substrings are cut alike except near their ends: their interior symbols are the
same in every document.

Every window of WINDOW words picks one of its interior symbols, by rules that
see nothing but the window: of the highest round that has any whose cuts the
window determines, the one of most bytes (long words are rare), then the one of
least hash. Two equal windows therefore pick the same symbol. The first shuffle brings equal picked symbols
together and reveals those that several documents have; only windows around
those are named in full (128 bits), and a second shuffle verifies them and finds
the document in which each occurs first.

Whole texts come first: a 128-bit hash (XXH3) of the whole word sequence shows
exact copies, which need no further look; nothing is recompressed for that.

Before the other shuffles each task looks at its own rows: a symbol that several of
its documents share needs no answer and sends one row, a window sends only its
first document, and a text asks once for all its places. However hot a passage is,
its groups have a few rows for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import documents, in_arrow, per_batch
from weftgraph.plans.lineage import discard, materialize

#: Words of a window, and rounds of pairs. Three rounds leave hardly a window without a symbol of the last.
WINDOW, ROUNDS = 13, 3
#: Words parsed at once, about.
BLOCK = 400_000
#: Occurrences of a symbol in the texts of a block beyond which it needs no second text to be looked at.
FREQUENT = 4
#: Rows of the table of exact copies up to which it is broadcast (12 bytes each); beyond, it is joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Documents without an id come last.
LAST = (1 << 63) - 1

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def word_names(words: list[bytes]) -> np.ndarray:
    """A 64-bit name of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


class Symbols:
    """The symbols of one round: names, bytes of their words, and the words [low, high] that determine each.

    Symbols at the ends of a text, which no window determines, have high - low
    beyond any window.
    """

    def __init__(self, name, weight, low, high, doc):
        self.name, self.weight, self.low, self.high, self.doc = name, weight, low, high, doc
        self.edge = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)  # last of its text

    def runs(self) -> Symbols:
        """Maximal runs of equal symbols named by symbol and length. What ends a run is the other symbol beside it."""
        n = len(self.name)
        begin = np.r_[True, (self.name[1:] != self.name[:-1]) | self.edge[:-1]]
        i = np.flatnonzero(begin)
        j = np.r_[i[1:], n] - 1
        name, count = self.name[i], (j - i + 1).astype(np.uint64)
        many = count > 1
        name[many] = scramble(name[many] * _A + count[many])
        low, high = self._before()[i], self._after()[j]
        return Symbols(name, np.add.reduceat(self.weight, i), low, high, self.doc[i])

    def pairs(self, round_: int) -> Symbols:
        """Neighbours of which the first is a left and the second a right symbol of this round become one."""
        right = scramble(self.name + np.uint64(round_)) >> np.uint64(63) != 0
        join = ~right & ~self.edge
        join[:-1] &= right[1:]
        join[-1:] = False
        i = np.flatnonzero(~np.r_[False, join[:-1]])
        both = join[i]
        j = i + both
        name = self.name[i]
        name[both] = scramble(scramble(name[both] + _A) * _B + self.name[j[both]])
        single, is_right = ~both, right[i]
        low = np.where(single & is_right, self._before()[i], self.low[i])
        high = np.where(single & ~is_right, self._after()[i], self.high[j])
        return Symbols(name, np.where(both, self.weight[i] + self.weight[j], self.weight[i]), low, high, self.doc[i])

    def _before(self) -> np.ndarray:
        """Low end of the symbol before each; far away at the start of a text."""
        out = np.r_[np.int32(0), self.low[:-1]]
        out[np.r_[True, self.edge[:-1]]] = -(1 << 29)
        return out

    def _after(self) -> np.ndarray:
        """High end of the symbol after each; far away at the end of a text."""
        out = np.r_[self.high[1:], np.int32(0)]
        out[self.edge] = 1 << 29
        return out


def parse(names: np.ndarray, doc: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """Symbols of the words, of the runs paired once, twice, ..."""
    at = np.arange(len(names), dtype=np.int32)
    level = Symbols(names, weight.astype(np.int32), at, at, doc)
    levels = [level]
    level = level.runs()
    for k in range(rounds):
        level = level.pairs(k)
        levels.append(level)
    return levels


def picked(names: np.ndarray, doc: np.ndarray, weight: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first window, number of windows) of each maximal row of windows that pick the same occurrence.

    ``names``, ``doc``, ``weight``: words of a few texts one after the other, the
    number of each word's text, and its bytes.
    """
    n = len(names)
    whole = np.zeros(n, bool)
    if n >= window:
        whole[: n - window + 1] = doc[window - 1 :] == doc[: n - window + 1]
    best, round_of = np.full(n, _NONE), np.zeros(n, np.int8)
    open_ = whole.copy()
    levels = parse(names, doc, weight, rounds) if n else []
    for k in range(len(levels) - 1, -1, -1):
        s = levels[k]
        ok = np.flatnonzero(s.high - s.low < window)
        if k < rounds:  # only around windows that no higher round has served
            near = np.cumsum(np.r_[0, open_])
            ok = ok[near[np.minimum(s.low[ok] + 1, n)] > near[np.maximum(s.high[ok] - window + 1, 0)]]
        start = np.maximum(s.high[ok] - window + 1, 0)
        count = s.low[ok] - start + 1
        at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]].astype(np.int32), count) + np.arange(count.sum(), dtype=np.int32) if len(ok) else np.zeros(0, np.int32)
        key = (scramble(s.name[ok]) >> np.uint64(40) << np.uint64(32)) | ok.astype(np.uint64) | (np.uint64(255) - np.minimum(s.weight[ok], 255).astype(np.uint64)) << np.uint64(56)
        this = np.full(n, _NONE)
        np.minimum.at(this, at, np.repeat(key, count))
        take = open_ & (this != _NONE)
        best[take], round_of[take] = this[take] & _LOW, k
        open_ &= ~take
    p = np.flatnonzero(whole)
    if not len(p):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, (best[p[1:]] != best[p[:-1]]) | (round_of[p[1:]] != round_of[p[:-1]]) | (p[1:] != p[:-1] + 1)]
    first = p[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(p)])
    symbol = np.zeros(len(first), np.uint64)
    for k, s in enumerate(levels):
        mine = round_of[first] == k
        symbol[mine] = s.name[best[first[mine]].astype(np.int64)]
    return symbol, first, count


def window_names(names: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """96-bit names, as numbers of 64 and of 32 bits, of the windows that start at ``at``."""
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(window):
        w = names[at + k]
        a = a * _A + w
        b = (b ^ w) * _B + (b >> np.uint64(31))
    return scramble(a), (scramble(b + _A) & _LOW).astype(np.uint32)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(place of the first, words of each) for runs of a batch's texts of about BLOCK words."""
    first, held, n = 0, [], 0
    for i, v in enumerate(batch.column("text")):
        held.append((v.as_py() or "").encode().split())
        n += len(held[-1])
        if n >= BLOCK:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; true for the first."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _streamed(grouped: DataFrame, keys: int, answer, settled, schema: str) -> DataFrame:
    """``answer`` of the columns (arrays) of rows that come sorted by the first ``keys`` columns, groups being rows that agree in these.

    The last group of a batch may go on in the next one. ``settled`` gets its
    columns, and says whether they can be answered already, and what of them has to
    be seen again with the rest of the group; so a group is never held whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.flatnonzero(_changes(*cols[:keys]))[-1]
            done, held = settled(*[c[last:] for c in cols])
            stop = len(cols[0]) if done else last
            if stop:
                yield pa.RecordBatch.from_pydict(answer(*[c[:stop] for c in cols]))
        if held is not None:
            yield pa.RecordBatch.from_pydict(answer(*held))

    return in_arrow(grouped, run, schema)


def later_copies(marked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, mark): rows of at least ``window`` words that have all words of a row of smaller id, in order."""
    def roots(batch: pa.RecordBatch) -> dict:
        name, long = [], []
        for v in batch.column("text"):
            words = (v.as_py() or "").encode().split()
            name.append(xxhash.xxh3_128_digest(b" ".join(words)))
            long.append(len(words) >= window)
        return {"doc": batch.column("doc"), "mark": batch.column("mark"), "root": name, "long": long}

    named = materialize(per_batch(marked, roots, "doc bigint, mark int, root binary, long boolean").where("long").drop("long"))
    first = materialize(named.groupBy("root").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    few = first.count() <= MOST_BROADCAST  # else a join that AQE can split where one text has most of the copies
    found = materialize(named.join(F.broadcast(first) if few else first, "root").where("doc > least").select("doc", "mark").distinct())
    discard(named)
    discard(first)
    return found


def revealed(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc, place): rows of windows whose symbol several documents have; place = 16 * first window + number of windows.

    ``docs``: doc (never null) and text.
    """
    def symbols(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc").to_numpy()
        for first, words in _texts(batch):
            size = np.array([*map(len, words)])
            doc = np.repeat(np.arange(len(words), dtype=np.int32), size)
            starts = np.cumsum(size) - size
            flat = [w for ws in words for w in ws]
            symbol, at, count = picked(word_names(flat), doc, np.fromiter(map(len, flat), np.int32, len(flat)), window, rounds)
            d = doc[at] if len(at) else np.zeros(0, np.int32)
            place = (at - starts[d]) << 4 | count
            order = np.argsort(symbol, kind="stable")
            symbol, d, place = symbol[order], ids[first : first + len(words)][d[order]], place[order]
            group = _changes(symbol)
            g = np.cumsum(group) - 1
            low, high = (f.reduceat(d, np.flatnonzero(group)) if len(d) else d for f in (np.minimum, np.maximum))
            # shared here, or so frequent in one text that its windows are looked at anyhow
            sure = (low < high) | (np.bincount(g, minlength=len(low)) > FREQUENT)
            known = sure[g]
            # rows that need no answer go anywhere; one row with place 0 speaks for them
            route = np.where(known, scramble(symbol + place.astype(np.uint64) + d.astype(np.uint64)), symbol)
            some = np.flatnonzero(group)[sure]
            yield {
                "route": np.concatenate([route, symbol[some]]).view(np.int64),
                "doc": np.concatenate([d, low[sure]]),
                "place": np.concatenate([np.where(known, -place, place), np.zeros(len(some), np.int64)]).astype(np.int32),
            }

    def shared(route, doc, place):
        wanted = place >= 0
        r, d, p = route[wanted], doc[wanted], place[wanted]
        if len(r):
            starts = np.flatnonzero(_changes(r))
            several = np.repeat(np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts), np.diff(np.r_[starts, len(r)])) & (p > 0)
            d, p = d[several], p[several]
        return {"doc": np.concatenate([doc[~wanted], d]), "place": np.concatenate([-place[~wanted], p]).astype(np.int32)}

    def settled(route, doc, place):
        mine = doc[place >= 0]
        if not len(mine) or mine.min() == mine.max():
            return False, [route, doc, place]  # of one document: a batch sends no more than FREQUENT of these
        ends = np.array([mine.min(), mine.max()])
        return True, [np.repeat(route[:1], 2), ends, np.zeros(2, place.dtype)]

    rows = per_batch(docs, symbols, "route bigint, doc bigint, place int")
    return _streamed(rows.repartition("route").sortWithinPartitions("route"), 1, shared, settled, "doc bigint, place int")


def repeated(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, mark, at): windows that also start in a document of smaller id. mark: the text's hash.

    at: twice the window's first place, plus one if the text has it in more places.

    ``found``: what ``revealed`` gave for ``docs``; no other windows are looked at.
    """
    places = found.groupBy("doc").agg(F.collect_list("place").alias("places"))

    def windows(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, marks = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
        lists = batch.column("places")
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        for first, words in _texts(batch):
            size = np.array([*map(len, words)])
            starts = np.cumsum(size) - size
            names = word_names([w for ws in words for w in ws])
            part = flat[at[first] : at[first + len(words)]].astype(np.int64)
            d = np.repeat(np.arange(len(words)), np.diff(at[first : first + len(words) + 1]))
            count = part & 15
            p = np.repeat(part >> 4, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            d = np.repeat(d, count)
            fits = p + window <= size[d]  # ids that occur twice bring the other text's places
            p, d = p[fits], d[fits]
            a, b = window_names(names, starts[d] + p, window)
            doc, mark = ids[first : first + len(words)][d], marks[first : first + len(words)][d]
            order = np.lexsort((p, mark, doc, b, a))
            a, b, doc, mark, p = (x[order] for x in (a, b, doc, mark, p))
            # a text asks once for all places of a window
            ask = np.flatnonzero(_changes(a, b, doc, mark))
            more = np.diff(np.r_[ask, len(a)]) > 1
            a, b, doc, mark, p = a[ask], b[ask], doc[ask], mark[ask], p[ask] << 1 | more
            new = _changes(a, b)
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
            later = doc > least  # settled here
            route = np.where(later, scramble(a + p.astype(np.uint64) + doc.astype(np.uint64)), a)
            yield {"a": route.view(np.int64), "b": np.where(later, np.uint32(0), b).view(np.int32), "doc": doc, "mark": mark, "at": np.where(later, -1 - p, p).astype(np.int32)}

    def verified(a, b, doc, mark, at):
        done = at < 0
        ra, rb, rd = a[~done], b[~done], doc[~done]
        if len(ra):
            starts = np.flatnonzero(_changes(ra, rb))
            later = rd > np.repeat(np.minimum.reduceat(rd, starts), np.diff(np.r_[starts, len(ra)]))
        else:
            later = np.zeros(0, bool)
        return {"doc": np.concatenate([doc[done], rd[later]]), "mark": np.concatenate([mark[done], mark[~done][later]]), "at": np.concatenate([-1 - at[done], at[~done][later]]).astype(np.int32)}

    def settled(a, b, doc, mark, at):
        first = np.flatnonzero(at >= 0)[:1]  # the group's smallest document comes first; seen again, it is not later than itself
        return True, [c[first] for c in (a, b, doc, mark, at)] if len(first) else None

    rows = per_batch(docs.join(places, "doc").select("doc", "mark", "text", "places"), windows, "a bigint, b int, doc bigint, mark int, at int")
    return _streamed(rows.repartition("a", "b").sortWithinPartitions("a", "b", "doc"), 2, verified, settled, "doc bigint, mark int, at int")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept): what is left of each text without the words of repeated windows.

    A window of ``window`` words is repeated if its words also start in a row of
    smaller key; all its words go. Windows are judged on the input. Texts of
    fewer words lose none; null texts are empty; a null key counts as the
    largest. Rows of the same key never remove words from each other; they are
    told apart by a 32-bit hash of their texts, so two different texts of one key
    that also share that hash (one pair in four thousand million) are mixed up. Rows
    that repeat are returned each, an empty table gives an empty one. ``kept``
    holds the words left, joined by single spaces. Words end at ASCII white space.
    """
    body = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("doc"), F.col(text).alias("text"))
    marked = body.withColumn("mark", F.hash(F.coalesce("text", F.lit(""))))
    copies = later_copies(marked, window)
    few = copies.count() <= MOST_BROADCAST
    firsts = marked.join(F.broadcast(copies) if few else copies, ["doc", "mark"], "left_anti")
    found = materialize(revealed(firsts.select("doc", "text"), window, rounds))
    gone = materialize(repeated(firsts, found, window))
    discard(found)
    gone = gone.groupBy("doc", "mark").agg(F.collect_set("at").alias("gone")).unionByName(copies.withColumn("gone", F.array(F.lit(-1))))

    def kept(batch: pa.RecordBatch) -> dict:
        n, removed, out = [], [], []
        for t, g in zip(batch.column("text"), batch.column("gone")):
            words = (t.as_py() or "").encode().split()
            n.append(len(words))
            if g.is_valid and len(g.values):
                at, edge = g.values.to_numpy(), np.zeros(len(words) + 1, np.int64)
                if at[0] < 0:  # a later copy
                    edge[0] = 1
                else:
                    first = at >> 1
                    if (at & 1).any():
                        all_, _ = window_names(word_names(words), np.arange(len(words) - window + 1), window)
                        first = np.union1d(first, np.flatnonzero(np.isin(all_, all_[first[(at & 1) > 0]])))
                    edge[first] += 1
                    np.subtract.at(edge, first + window, 1)
                covered = np.cumsum(edge[:-1]) > 0
                removed.append(int(covered.sum()))
                words = [w for w, x in zip(words, covered.tolist()) if not x]
            else:
                removed.append(0)
            out.append(b" ".join(words).decode())
        return {"doc": batch.column("doc"), "n_words": np.array(n, np.int64), "n_removed": np.array(removed, np.int64), "kept": out}

    joined = marked.join(gone, ["doc", "mark"], "left").select("doc", "text", "gone")
    out = per_batch(joined, kept, "doc bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias(key), "n_words", "n_removed", "kept")


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 13 words that an earlier one has, as counts and a digest."""
    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The query by windows spelled out: every word with the twelve after it.
ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM t),
x AS (SELECT doc_id, i, string_agg(w, ' ') OVER f AS s, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM x WHERE n = 13),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM m, range(0, 13) q(j) WHERE least < doc_id),
k AS (SELECT w.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS gone, string_agg(w.w, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS left_ FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY 1)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(left_, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""
