"""Quality classifier from weak labels.

Overlapping heuristic labellers, native expressions, vote good, bad or nothing
on every document. Their votes are counted by pattern over the whole corpus;
expectation-maximisation over the counts estimates how often each labeller is
right, for sound documents and for each kind of fault, and gives every pattern a
posterior. The posteriors of a bounded sample of documents are the labels that
train a linear scorer over hashed features (words, shapes of words, and a few
classes for the document as a whole), in a task on an executor. The scorer then
judges every document by its whole text.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import documents, in_arrow, per_batch, texts
from weftgraph.llm.quality_rules import BLANKS, SYMBOLS, let, without, word_array
from weftgraph.llm.weak_supervision import fault_classes

#: Buckets of the linear scorer, documents that train it at most, and words a worker keeps.
BUCKETS, TRAIN_ROWS, CACHE = 1 << 18, 4000, 300_000
#: Score from which a document is kept.
ACCEPT = 0.5

#: Prior of how often a labeller votes bad on a sound document.
FALSE_ALARM = 0.0005

#: Frequent function words of four languages.
FUNCTION_WORDS = ("the", "and", "of", "to", "in", "is", "that", "for", "der", "die", "und", "das", "ist", "von", "den", "mit", "le", "la", "les", "de", "des", "et", "est", "que", "el", "los", "en", "y", "las", "por", "un", "a")


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` (k, text without nulls) with what the labellers look at, each computed once."""
    text = F.col("text")
    without_class = lambda c: F.length(text) - F.length(F.regexp_replace(text, c, ""))
    words = let(word_array(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).alias("same"), F.size(F.filter(w, lambda x: F.lower(x).isin(*FUNCTION_WORDS))).alias("frequent")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds")))
    return rows.select(
        "k", "text", without(text, BLANKS).alias("body"), (F.length(text) - without(text, SYMBOLS)).alias("symbols"), (F.length(text) - without(text, "!?")).alias("marks"),
        without_class(r"\p{Lu}+").alias("capitals"), without_class(r"\p{L}+").alias("letters"), words.alias("w"), lines.alias("l"),
    )


def votes() -> dict[str, Column]:
    """-1 (bad), 1 (good) or 0 (no vote) of each labeller, over the columns of ``measured``. Texts without words get no votes."""
    def vote(bad: Column, good: Column) -> Column:
        return F.when(body == 0, 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")

    body, n, frequent, same, lines, kinds = (F.col(c) for c in ("body", "w.n", "w.frequent", "w.same", "l.n", "l.kinds"))
    symbols, capitals, marks, letters = (F.col(c) for c in ("symbols", "capitals", "marks", "letters"))
    return {
        "symbols": vote(symbols > 0.05 * body, symbols < 0.01 * body),
        "capitals": vote(capitals > 0.5 * body, capitals < 0.2 * body),
        "marks": vote(marks > 0.1 * body, marks < 0.03 * body),
        "letters": vote(letters < 0.6 * body, letters > 0.85 * body),
        "function_words": vote((n >= 50) & (frequent < 0.03 * n), frequent > 0.1 * n),
        "stutter": vote((n >= 20) & (same > 0.2 * n), same < 0.05 * n),
        "lines": vote((lines >= 4) & (kinds < 0.5 * lines), (lines >= 4) & (kinds > 0.9 * lines)),
    }


LABELLERS = ("symbols", "capitals", "marks", "letters", "function_words", "stutter", "lines")


def labelled(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, one column of votes for each labeller); a null text is empty."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return measured(rows).select("k", "text", *[v.alias(n) for n, v in votes().items()])


def pattern_counts(votes_of: DataFrame) -> list[tuple[tuple[int, ...], float]]:
    """(votes of all labellers, rows) over all rows, at most 3 to the number of labellers of them, in order."""
    return sorted((tuple(r[n] for n in LABELLERS), float(r["n"])) for r in votes_of.groupBy(*LABELLERS).agg(F.count("*").alias("n")).collect())


def accuracies(counts: list[tuple[tuple[int, ...], float]]) -> dict[str, tuple[float, float, float]]:
    """For each labeller: how often it votes bad on sound documents and on those of its fault, and their share."""
    shares, table, _ = fault_classes(counts, FALSE_ALARM)
    return {n: (float(table[0, j, 0]), float(table[j + 1, j, 0]), float(shares[j + 1])) for j, n in enumerate(LABELLERS)} if counts else {}


# ---- the scorer

_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))


def shape(word: str) -> str:
    """Classes of a word's characters in a row: A capitals, a other letters, 0 digits, the rest as it is, at most 12 of them."""
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word[:12]


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode()) % BUCKETS


def whole_features(n: int, distinct: int, same: int, text: str) -> list[str]:
    """Features of the document as a whole: classes of length, variety, repetition (``same``: words equal to the one before) and lines."""
    if not n:
        return ["empty"]
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return [f"variety {min(n.bit_length(), 12)} {int(10 * distinct / n)}", f"distinct {int(10 * distinct / n)}", f"same {int(10 * same / n)}", f"lines {int(4 * (1 - len(set(lines)) / len(lines)))}" if len(lines) > 3 else "few lines"]


def split_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


class Numbers(dict):
    """A number for each word, from 0, and what it weighs, which is computed once."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.values = weights, np.zeros(1024)

    def __missing__(self, word: bytes) -> int:
        n, text = len(self), word.decode()
        if n == len(self.values):
            self.values = np.concatenate([self.values, np.zeros(n)])
        self.values[n] = self.weights[bucket("w " + text.lower())] + self.weights[bucket("s " + shape(text))]
        self[word] = n
        return n


class Scorer:
    """A linear scorer over hashed features: the mean weight of the words and of their shapes, and the weights of the whole."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, Numbers(weights)

    def forget(self) -> None:
        self.known = Numbers(self.weights)

    def scores(self, texts: Iterator[str]) -> np.ndarray:
        """The probability that each text is good. Words are looked up once a text and weighed all at once; few texts are held."""
        out = []
        for text in texts:
            if len(self.known) >= CACHE:
                self.forget()
            words = text.encode().split()  # the same places as split_words: bytes know no other blanks
            ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            whole = whole_features(len(ids), len(np.unique(ids)), int((ids[1:] == ids[:-1]).sum()), text)
            z = self.bias + sum(float(self.weights[bucket(f)]) for f in whole)
            if len(ids):
                z += 10 * float(self.known.values[ids].sum()) / len(ids)
            out.append(z)
        return 1 / (1 + np.exp(-np.clip(np.array(out, float), -50.0, 50.0)))


def train(texts: list[str], goodness: list[float], epochs: int = 12, rate: float = 0.2, decay: float = 1e-5, seed: int = 1) -> Scorer:
    """Fits the scorer to texts and probabilities of being good."""
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    rows = []
    for t in texts:
        words = split_words(t)
        found: dict[int, float] = {}
        for w in words:
            for f in ("w " + w.lower(), "s " + shape(w)):
                b = bucket(f)
                found[b] = found.get(b, 0.0) + 10 / len(words)
        for f in whole_features(len(words), len(set(words)), sum(a == b for a, b in zip(words, words[1:])), t):
            found[bucket(f)] = found.get(bucket(f), 0.0) + 1
        rows.append((np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), float, len(found))))
    y = np.array(goodness)
    bias, bias_square = 0.0, 1e-6
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            z = bias + weights[at] @ x
            slope = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[i]
            g = slope * x + decay * weights[at]
            squares[at] += g * g
            weights[at] -= rate * g / np.sqrt(squares[at])
            bias_square += slope * slope
            bias -= rate * slope / np.sqrt(bias_square)
    return Scorer(weights, bias)


def fit(rows: DataFrame, post: dict[tuple[int, ...], float]) -> Scorer:
    """The scorer for labelled ``rows`` with the posteriors of their patterns, trained in one task on an executor: the driver gets the finished weights only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, goodness = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            goodness += [post[v] for v in zip(*(batch.column(n).to_pylist() for n in LABELLERS))]
        if texts:
            yield pa.RecordBatch.from_pydict({"scorer": [pickle.dumps(train(texts, goodness))]})

    found = in_arrow(rows.coalesce(1), run, "scorer binary").collect()
    return pickle.loads(bytes(found[0]["scorer"])) if found else train([], [])


def classify(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS, accept: float = ACCEPT) -> DataFrame:
    """(key, score, kept) of every row: the scorer's probability that the whole text is good.

    Null texts are empty, texts without words are judged by that alone; rows that
    repeat a text get the same score, and each counts in the estimation. The
    corpus gives the labellers' accuracies; the scorer is trained on at most
    ``rows`` documents, those of least hash of the key. An empty table gives an
    empty result.
    """
    post = fault_classes(pattern_counts(labelled(docs, text, key).select(*LABELLERS)), FALSE_ALARM)[2]
    chosen = docs.select(F.col(key).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(rows)
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")
    scorer = fit(labelled(some, "text", "k").orderBy(F.xxhash64("k"), "k", "text").limit(rows), post)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batch: pa.RecordBatch) -> dict:
        return {"k": batch.column("k"), "score": sent.value.scores(texts(batch))}

    body = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    out = per_batch(body, run, f"k {body.schema['k'].dataType.simpleString()}, score double", lambda: sent.value.forget())
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= accept).alias("kept"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and whether it is kept."""
    return classify(documents(spark, sf_dir))
