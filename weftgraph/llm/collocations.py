"""Phrase collocations by generalised suffix automata.

Each shard, a run of bounded length of one task's words, gets the suffix
automaton of its pieces up to a depth of three words. Its states are the classes
of phrases that end at the same places; a state knows its longest and shortest
phrase, its suffix link and how many places it has. The automaton is built from
the sorted reversed contexts of all places, whose trie is the tree of suffix
links, in numpy and not word by word; transitions are not kept, since
enumeration needs only lengths, links and counts. A shard's phrases are dealt by
hash to buckets, as many as the input asks for, and sent as one row for a bucket;
Spark brings the rows of a bucket together, and their counts are summed a bucket
at a time. A phrase that is frequent enough then sends its count along its suffix
link and to its prefix, and what it explains well enough is subsumed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import documents, in_arrow
from weftgraph.plans.lineage import materialize

#: Words of the longest phrase; three word numbers of BITS bits make one sort key.
DEPTH, BITS = 3, 21
#: Words of a shard, at most 2^BITS - 1 with the two that are carried over; bytes of a text that are split at once.
SHARD, BLOCK = 1_000_000, 1 << 22
#: Bytes of all texts to a bucket of phrases, which is what a task holds at once; rows that leave a worker together.
BUCKET, ROWS = 2_000_000, 256
#: Groups that a language's phrases are dealt to before the last ranking: no task sees all of them.
GROUPS = 64

#: Characters that end a piece, and what they become, a byte that UTF-8 never has; A-Z become a-z.
ENDS = b".,;:!?\n\x0b\x0c\r"
MARK = b"\xff"
TABLE = bytes.maketrans(ENDS + bytes(range(65, 91)), MARK * len(ENDS) + bytes(range(97, 123)))


def split(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, MARK between pieces, in lists of about BLOCK bytes."""
    at = 0
    while at < len(text):
        to = at + BLOCK
        if to < len(text):
            ends = [i for c in b" \t" + ENDS if (i := text.find(c, to)) >= 0]
            to = min(ends, default=len(text))
        yield text[at:to].translate(TABLE).replace(MARK, b" " + MARK + b" ").split()
        at = to


def states(ids: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The automaton's states over word numbers, of which 0 ends a piece: (words of the longest phrase backwards from its end, 0 beyond it; its length; the shortest's length; places).

    The first ``carried`` numbers are context of places counted before. A node
    of the trie of reversed contexts is a state's longest phrase if no longer
    one has as many places; what lies between it and its suffix link ends at the
    same places and belongs to its state.
    """
    ids = ids.astype(np.int64)
    back = np.zeros((DEPTH, len(ids)), np.int64)
    back[0] = ids
    for d in range(1, DEPTH):
        back[d, d:] = np.where(back[d - 1, d:] > 0, ids[:-d] if d < len(ids) else 0, 0)
    back = back[:, carried:]
    back = back[:, back[0] > 0]
    keys, places = np.unique((back[0] << 2 * BITS) | (back[1] << BITS) | back[2], return_counts=True)
    levels = [(keys, places)]
    for _ in range(DEPTH - 1):  # from the deepest level up to single words
        keys, places = levels[0]
        new = np.flatnonzero(np.diff(keys >> BITS, prepend=-1))
        levels.insert(0, (keys[new] >> BITS, np.add.reduceat(places, new) if len(new) else places))
    out = [(np.empty((DEPTH, 0), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    shortest = np.ones(len(levels[0][0]), np.int64)
    for d, (keys, places) in enumerate(levels, 1):
        real = (keys & ((1 << BITS) - 1)) > 0  # else the place has no more words before it
        if d > 1:
            above, many = levels[d - 2]
            link = np.searchsorted(above, keys >> BITS)
            same = real & (places == many[link])
            shortest = np.where(same, shortest[link], d)
        longest = real
        if d < DEPTH:
            below, fewer = levels[d]
            parent = np.searchsorted(keys, below >> BITS)
            taken = np.zeros(len(keys), bool)
            taken[parent[((below & ((1 << BITS) - 1)) > 0) & (fewer == places[parent])]] = True
            longest = real & ~taken
        k = keys[longest] << BITS * (DEPTH - d)
        out.append((np.stack([(k >> BITS * (DEPTH - 1 - i)) & ((1 << BITS) - 1) for i in range(DEPTH)]), np.full(len(k), d), shortest[longest], places[longest]))
    return tuple(np.concatenate([o[i] for o in out], axis=-1) for i in range(4))


class Numbers(dict):
    """Numbers of a shard's words, from 1, each of one language."""

    def __init__(self, shard: Shard, lang: str) -> None:
        self.shard = shard
        self.place, self.seed = len(shard.langs), xxhash.xxh64_intdigest(lang)
        shard.langs.append(lang)
        self[MARK] = 0

    def __missing__(self, word: bytes) -> int:
        self.shard.words.append(word)
        self.shard.lang_of.append(self.place)
        self.shard.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        self[word] = number = len(self.shard.words) - 1
        return number


class Shard:
    """Words as they come, until there are enough for an automaton."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.numbers: dict[str, Numbers] = {}
        self.langs: list[str] = []
        self.words: list[bytes | None] = [None]
        self.lang_of, self.hashes = [0], [0]
        self.held: list[np.ndarray] = []
        self.size = self.carried = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        of = self.numbers.get(lang) or self.numbers.setdefault(lang, Numbers(self, lang))
        self.held.append(np.fromiter(map(of.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def next(self, lang: str) -> Shard:
        """An empty shard that knows the last words of this one, which it does not count again."""
        ends = np.concatenate(self.held[-DEPTH:])[1 - DEPTH :].tolist()
        new = Shard(self.buckets)
        new.add(lang, [self.words[i] or MARK for i in ends])
        new.carried, new.size = len(ends), 0
        return new

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, last word first and 0 beyond the phrase; places; language) of every phrase of every state, and of the root for each language, whose places are all its words."""
        ids = np.concatenate([np.empty(0, np.int32), *self.held])
        back, longest, shortest, places = states(ids, self.carried)
        each = longest - shortest + 1
        state = np.repeat(np.arange(len(each)), each)
        length = np.arange(len(state)) - np.repeat(np.cumsum(each) - each, each) + shortest[state]
        back = np.where(np.arange(DEPTH)[:, None] < length, back[:, state], 0)
        lang_of = np.array(self.lang_of)
        counted = ids[self.carried :]
        all_words = np.bincount(lang_of[counted[counted > 0]], minlength=len(self.langs))
        root = np.flatnonzero(all_words)
        return np.concatenate([back, np.zeros((DEPTH, len(root)), np.int64)], axis=1), np.r_[places[state], all_words[root]], np.r_[lang_of[back[0]], root]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(bucket, lang, phrases, counts): the phrases of each bucket and language, one to a line, and their counts as 32-bit numbers."""
        back, places, lang = self.phrases()
        if not len(places):
            return
        hashes = np.array(self.hashes, np.uint64)
        seeds = np.array([self.numbers[x].seed for x in self.langs], np.uint64)
        mixed = seeds[lang]
        for numbers in back[::-1]:
            mixed = np.where(numbers > 0, ((mixed << np.uint64(23) | mixed >> np.uint64(41)) ^ hashes[numbers]) * np.uint64(0x9E3779B97F4A7C15), mixed)
        bucket = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(self.buckets)
        group = bucket.astype(np.int64) * len(self.langs) + lang
        order = np.argsort(group, kind="stable")
        group, back = group[order], back[:, order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        offsets = np.r_[starts, len(group)].astype(np.int32)
        words, langs = pa.array(self.words, pa.binary()), pa.array(self.langs, pa.string())
        for at in range(0, len(starts), ROWS):
            first, last = offsets[at], offsets[min(at + ROWS, len(starts))]
            cut = offsets[at : at + ROWS + 1] - first
            named = [words.take(pa.array(numbers[first:last])) for numbers in back[::-1]]
            named[-1] = named[-1].fill_null(b"")  # the root's phrase is empty
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), pc.binary_join_element_wise(*named, b" ", null_handling="skip")), b"\n")
            counts = places[order[first:last]].astype("<i4")
            packed = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * 4).astype(np.int32).tobytes()), pa.py_buffer(counts.tobytes())])
            of = group[starts[at : at + ROWS]]
            yield pa.RecordBatch.from_arrays([pa.array(of // len(self.langs)), langs.take(pa.array(of % len(self.langs))), lines, packed], names=["bucket", "lang", "phrases", "counts"])


def _automata(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    shard = Shard(buckets)
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.binary())):
            lang, text = lang.as_py(), text.as_py()
            for words in split(text):
                while words:
                    now, words = words[: SHARD - shard.size], words[SHARD - shard.size :]
                    shard.add(lang, now)
                    if shard.size >= SHARD:
                        yield from shard.rows()
                        shard = shard.next(lang)
            if text:
                shard.add(lang, [MARK])
    yield from shard.rows()


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of what occurs ``least`` times, and of all roots. Rows come bucket by bucket, of which one is held."""
    held: dict[str, dict[bytes, int]] = {}
    at = None

    def found() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            kept = [(p, n) for p, n in counts.items() if n >= least or not p]
            for i in range(0, len(kept), 1 << 16):
                phrases, n = zip(*kept[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "f"])

    for batch in batches:
        for bucket, lang, phrases, counts in zip(*batch.columns):
            if bucket.as_py() != at:
                yield from found()
                held, at = {}, bucket.as_py()
            own = held.setdefault(lang.as_py(), {})
            get = own.get
            for p, n in zip(phrases.as_py().split(b"\n"), np.frombuffer(counts.as_py(), "<i4").tolist()):
                own[p] = get(p, 0) + n
    yield from found()


def phrase_counts(docs: DataFrame, least: int = 1, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, words, f): the phrases of up to three words within pieces that occur ``least`` times in a language, with all their occurrences; the empty phrase, of 0 words, has all words of its language.

    Null texts and texts without words have no phrases, a null language is
    ``und``. Every row counts, rows that repeat too; an empty table gives an
    empty one. Texts of any length are split in blocks; shards end where they
    are full, and the next one knows the two words before it. Every shard sends a
    phrase once, so a frequent one is summed before it is shuffled; buckets grow
    in number with the texts and not in size.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    read = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), body.alias("text"))
    buckets = 1 + (docs.agg(F.sum(F.octet_length(body).cast("bigint"))).first()[0] or 0) // BUCKET
    sent = in_arrow(read, lambda batches: _automata(batches, buckets), "bucket long, lang string, phrases binary, counts binary")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sent.repartition(max(1, min(width, buckets)), "bucket").sortWithinPartitions("bucket")
    found = in_arrow(met, lambda batches: _summed(batches, least), "lang string, phrase string, f long")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return found.select("lang", "phrase", words.alias("words"), "f")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words by their lowest-scoring cut.

    ``a`` is how often a phrase occurs, at least ``least``; ``l`` and ``r`` are
    the parts' counts at the cut after its first k words that has the lowest
    floor(1000000 a a / (l r)), ties to the smaller k; ``n`` is all words of the
    language. A phrase that lies within a longer frequent one goes if the longer
    one has at least ``share`` percent of its occurrences. Products are decimals
    of 38 digits, exact up to 10^16 occurrences. Phrases are ranked by score and
    count, larger first, then by the bytes of the phrase. Rows are counted as in
    ``phrase_counts``; an empty table has no phrases. What is frequent is written
    to the shared folder, ``discard`` the result when it is no longer read.
    """
    kept = materialize(phrase_counts(docs, least, text, lang))
    parts = kept.where("words > 0").select("lang", "phrase", "f")
    many = kept.where((F.col("words") > 1) & (F.col("f") >= least)).select("lang", "phrase", "words", F.col("f").alias("a"))

    def part(k: str) -> Column:
        return F.expr(f"substring_index(phrase, ' ', {k})")

    longer = many.where("words > 2").select("lang", "a", F.explode(F.array(part("1 - words"), part("words - 1"))).alias("phrase"))
    within = longer.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    free = many.join(within, ["lang", "phrase"], "left").where(F.col("above").isNull() | (100 * F.col("above") < share * F.col("a")))
    cuts = free.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part("k").alias("left"), part("k - words").alias("right"))
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    exact = F.expr("(cast(1000000 as decimal(38,0)) * a * a) div (cast(l as decimal(38,0)) * r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))
    few = scored.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).withColumn("rank", first).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = kept.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in SQL: every place of a word starts a phrase of one, two and three words where the piece goes on.
ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
o AS (SELECT lang, w[i] AS phrase, 1 AS words FROM i UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], 2 FROM i WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM i WHERE i + 2 <= len(w)),
f AS (SELECT lang, phrase, words, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY 1),
g AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
h AS (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM g WHERE words = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM g WHERE words = 3),
b AS (SELECT lang, phrase, max(a) AS above FROM h GROUP BY ALL),
c AS (SELECT g.* FROM g LEFT JOIN b USING (lang, phrase) WHERE above IS NULL OR 100 * above < 50 * a),
k AS (SELECT lang, phrase, a, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE words = 3),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS z FROM s) WHERE z = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents."""
    return collocations(documents(spark, sf_dir))
