"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input joins an embedding of the word with the embeddings of its
character n-grams, so that inflected and unknown words still have a meaning. Two
gated recurrent layers read a window of words forwards and backwards, attention
pools their states, and a linear unit gives the window's logit. A text is scored
over all its overlapping windows; a small logistic unit turns the largest window
logits and the text's length into the probability.

Only documents are labelled, not windows. Training therefore starts with all
windows of toxic documents as toxic, then keeps those that the network itself
finds most toxic. Everything is numpy; the model has some three million bytes,
whatever the data, and is fitted to a bounded sample of labelled rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import documents, in_arrow, per_batch

#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 32, 16
#: Embeddings: buckets for words and for character n-grams, and numbers in each. States of each direction; attention units.
WORDS, GRAMS, DIM, STATES, UNITS = 1 << 14, 1 << 15, 8, 8, 8
#: Bytes of the n-grams, borders of the word included.
SIZES = (3, 5, 7)
#: Largest window logits that the last unit sees.
TOP = 4
#: Labelled rows that training uses at most.
TRAIN_ROWS = 4000
#: Windows that an epoch of training draws, from all windows of the labelled rows, anew each time: of toxic texts at least
#: and at most (fewer are repeated), and of clean ones at most, half of them at random and half the worst of each text.
LEAST_TOXIC, MOST_TOXIC, MOST_CLEAN = 3000, 8000, 16_000
#: Words whose inputs a worker keeps, and windows scored at once.
CACHE, BATCH = 120_000, 1024
#: Words read at once, about.
BLOCK = 60_000

TRIM = b".,!?;:\"'()[]{}#*$%&|<>-_"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, n-gram buckets, where each word's n-grams end), borders and case removed."""
    plain = [w.lower().strip(TRIM) or w for w in words]
    bucket = np.frombuffer(b"".join(map(xxhash.xxh64_digest, plain)), ">u8").astype(np.uint64) % np.uint64(WORDS)
    text = np.frombuffer(b"".join([b"^%b$" % p for p in plain]), np.uint8).astype(np.uint64)
    size = np.array([len(p) + 2 for p in plain])
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(text))
    word = np.repeat(np.arange(len(words)), size)
    grams, owner = [], []
    for n in SIZES:
        h = np.zeros(len(text), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (np.r_[text[k:], np.zeros(min(k, len(text)), np.uint64)] + np.uint64(1))
        ok = np.flatnonzero(at + n <= end)
        grams.append((h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 15))
        owner.append(word[ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    stops = np.searchsorted(owner[order], np.arange(len(words)), side="right")
    return bucket.astype(np.int32), np.concatenate(grams)[order].astype(np.int32), stops


def many_features(words: list[bytes], some: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_features`` of many words, ``some`` at a time."""
    parts = [word_features(words[a : a + some]) for a in range(0, len(words), some)]
    shift = np.cumsum([0] + [len(g) for _, g, _ in parts])
    return np.concatenate([b for b, _, _ in parts]), np.concatenate([g for _, g, _ in parts]), np.concatenate([e + s for (_, _, e), s in zip(parts, shift)])


@dataclass
class Network:
    """The parameters, by name, and what they compute."""

    p: dict[str, np.ndarray]
    last: np.ndarray = field(default_factory=lambda: np.r_[-1.0, 1.0, np.zeros(TOP)])  # bias, weights of the TOP logits, of the length

    @classmethod
    def random(cls, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        n = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        d, s = DIM, STATES
        return cls({
            "words": n(0.1, WORDS, d), "grams": n(0.1, GRAMS, d),
            "inp": n(0.4, 2, 2 * d, 3 * s), "inp_b": np.zeros((2, 1, 3 * s), np.float32), "rec": n(0.3, 2, s, 3 * s),
            "att": n(0.3, 2 * s, UNITS), "att_b": np.zeros(UNITS, np.float32), "att_v": n(0.3, UNITS),
            "out": n(0.3, 2 * s), "out_b": np.full(1, -1.0, np.float32),
        })

    # ---- inputs

    def embed(self, feats: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """One row of 2 DIM numbers for each word."""
        bucket, grams, stops = feats
        starts = np.r_[0, stops[:-1]] if len(stops) else stops
        total = np.zeros((len(bucket), DIM), np.float32)
        has = stops > starts
        if has.any():
            total[has] = np.add.reduceat(self.p["grams"][grams], starts[has]) / np.sqrt(stops - starts)[has, None]
        return np.concatenate([self.p["words"][bucket], total], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What the input adds to the gates of both directions: (2, words, 3 STATES)."""
        return x @ self.p["inp"] + self.p["inp_b"]

    def all_gates(self, feats: tuple[np.ndarray, np.ndarray, np.ndarray], some: int = 20_000) -> np.ndarray:
        """``gates`` of many words, ``some`` at a time."""
        bucket, grams, stops = feats
        starts = np.r_[0, stops[:-1]]
        out = np.zeros((2, len(bucket), 3 * STATES), np.float32)
        for a in range(0, len(bucket), some):
            b = min(a + some, len(bucket))
            out[:, a:b] = self.gates(self.embed((bucket[a:b], grams[starts[a] : stops[b - 1]], stops[a:b] - starts[a])))
        return out

    # ---- one batch of windows

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. ``g``: (2, T, B, 3 STATES), the second direction in reverse time; ``mask``: (T, B), 0 past the end."""
        T, B = mask.shape
        s, rec = STATES, self.p["rec"]
        h = np.zeros((2, B, s), np.float32)
        states = np.zeros((2, T, B, s), np.float32)
        trace = []
        both = np.stack([mask, mask[::-1]])[..., None].astype(np.float32)
        for t in range(T):
            u = h @ rec
            zr = sigmoid(g[:, t, :, : 2 * s] + u[..., : 2 * s])
            z, r = zr[..., :s], zr[..., s:]
            n = np.tanh(g[:, t, :, 2 * s :] + r * u[..., 2 * s :])
            m = both[:, t]
            new = h + m * (1 - z) * (n - h)
            if keep:
                trace.append((h, z, r, n, u[..., 2 * s :], m))
            states[:, t] = h = new
        out = np.concatenate([states[0], states[1, ::-1]], 2)  # (T, B, 2s)
        a = np.tanh(out @ self.p["att"] + self.p["att_b"])
        e = a @ self.p["att_v"] + (mask - 1.0).astype(np.float32) * 1e4
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[..., None] * out).sum(0)
        logit = pooled @ self.p["out"] + self.p["out_b"]
        return (logit, (g, mask, trace, out, a, w, pooled)) if keep else logit

    def backward(self, kept, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Slopes of the parameters behind the gates, and of the gates' inputs."""
        g, mask, trace, out, a, w, pooled = kept
        s, rec, p = STATES, self.p["rec"], self.p
        T = len(mask)
        d = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_out = w[..., None] * d_pooled
        d_w = (out * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        d["att_v"] = np.tensordot(d_e, a, ((0, 1), (0, 1)))
        d_a = d_e[..., None] * p["att_v"] * (1 - a * a)
        d["att"] = np.tensordot(out, d_a, ((0, 1), (0, 1)))
        d["att_b"] = d_a.sum((0, 1))
        d_out = d_out + d_a @ p["att"].T
        d_states = np.stack([d_out[..., :s], d_out[::-1, :, s:]])
        d_g, d_rec = np.zeros_like(g), np.zeros_like(rec)
        d_h = np.zeros_like(trace[0][0])
        for t in range(T - 1, -1, -1):
            h, z, r, n, un, m = trace[t]
            d_h = d_h + d_states[:, t]
            d_n = d_h * m * (1 - z)
            d_z = -d_h * m * (n - h)
            d_h = d_h * (1 - m * (1 - z))
            d_pre = d_n * (1 - n * n)
            d_un, d_r = d_pre * r, d_pre * un
            d_zr = np.concatenate([d_z * z * (1 - z), d_r * r * (1 - r)], 2)
            d_u = np.concatenate([d_zr, d_un], 2)
            d_g[:, t] = np.concatenate([d_zr, d_pre], 2)
            d_rec += h.transpose(0, 2, 1) @ d_u
            d_h = d_h + d_u @ rec.transpose(0, 2, 1)
        d["rec"] = d_rec
        return d, d_g

    # ---- texts

    def logits(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """Logit of each window: ``ids`` are rows of ``gates`` in reading order, a window is (start, size)."""
        out = np.zeros(len(starts), np.float32)
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            at, mask = window_ids(ids, starts[part], sizes[part])
            out[part] = self.forward(np.stack([gates[0][at], gates[1][at[::-1]]]), mask)
        return out

    def document_features(self, logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows (1, TOP largest logits, logarithm of the number of windows) from the windows' logits, text after text."""
        out = np.zeros((len(counts), TOP + 2))
        out[:, 0], out[:, -1] = 1, np.log1p(counts)
        out[:, 1:-1] = -6.0
        at = 0
        for i, n in enumerate(counts.tolist()):
            top = np.sort(logits[at : at + n])[::-1][:TOP]
            out[i, 1 : 1 + len(top)] = np.maximum(top, -6.0)
            at += n
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.last, -50, 50)))


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, number in each text) of overlapping windows over texts that follow one another."""
    counts = np.where(sizes <= 0, 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)))
    first = np.cumsum(sizes) - sizes
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first, counts) + k * STRIDE, np.minimum(WINDOW, np.repeat(sizes, counts) - k * STRIDE), counts


def window_ids(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word rows, mask), both time x windows."""
    t = np.arange(sizes.max(initial=1))[:, None]
    mask = t < sizes[None, :]
    return ids[np.minimum(starts[None, :] + t, max(len(ids) - 1, 0))] * mask, mask.astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 3, epochs: int = 5, batch: int = 256, rate: float = 0.02) -> Network:
    """A network for labelled texts. The same for the same texts in the same order. Without texts of both classes, an untrained one that says 0."""
    net = Network.random(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.last = np.r_[-6.0, np.zeros(TOP + 1)] if not y.any() else np.r_[6.0, np.zeros(TOP + 1)]
        return net
    r = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    read = [np.array([vocab.setdefault(w, len(vocab)) for w in t.encode().split()], np.int32) for t in texts]
    lengths = np.array([*map(len, read)])
    ids = np.concatenate(read)
    del read
    feats = many_features(list(vocab)) if vocab else word_features([b"-"])
    del vocab
    gram_starts = np.r_[0, feats[2][:-1]]
    starts, sizes, counts = windows_of(lengths)
    doc = np.repeat(np.arange(len(lengths)), counts)
    toxic = y[doc] > 0
    squares = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}

    def step(part: np.ndarray) -> None:
        at, mask = window_ids(ids, starts[part], sizes[part])
        used, back = np.unique(at, return_inverse=True)
        back = back.reshape(at.shape)
        n_grams = feats[2][used] - gram_starts[used]
        stops = np.cumsum(n_grams)
        grams = feats[1][np.repeat(gram_starts[used] - (stops - n_grams), n_grams) + np.arange(n_grams.sum())]
        mine = (feats[0][used], grams, stops)
        x = net.embed(mine)
        g = net.gates(x)
        logit, kept = net.forward(np.stack([g[0][back], g[1][back[::-1]]]), mask, True)
        slope = ((1 / (1 + np.exp(-logit)) - toxic[part]) / len(part)).astype(np.float32)
        d, d_g = net.backward(kept, slope)
        d_rows = np.zeros_like(g)
        np.add.at(d_rows[0], back, d_g[0])
        np.add.at(d_rows[1], back[::-1], d_g[1])
        d["inp"] = x.T[None] @ d_rows
        d["inp_b"] = d_rows.sum(1, keepdims=True)
        d_x = (d_rows @ net.p["inp"].transpose(0, 2, 1)).sum(0)
        for k, v in d.items():
            squares[k] += v * v
            net.p[k] -= rate * v / np.sqrt(squares[k])
        scale = d_x[:, DIM:] / np.sqrt(np.maximum(n_grams, 1))[:, None]
        for k, rows, v in (("words", mine[0], d_x[:, :DIM]), ("grams", grams, np.repeat(scale, n_grams, 0))):
            some, where = np.unique(rows, return_inverse=True)
            total = np.zeros((len(some), DIM), np.float32)
            np.add.at(total, where, v)
            squares[k][some] += total * total
            net.p[k][some] -= 3 * rate * total / np.sqrt(squares[k][some])

    def all_logits() -> np.ndarray:
        return net.logits(ids, starts, sizes, net.all_gates(feats))

    chosen_yes = np.flatnonzero(toxic)
    no = np.flatnonzero(~toxic)
    for epoch in range(epochs):
        if epoch:
            scores = all_logits()
            order = np.lexsort((-scores, doc))
            place = np.arange(len(order)) - (np.cumsum(counts) - counts)[doc[order]]
            take = np.maximum(2, counts // (4 if epoch < 3 else 8))
            best = order[place < take[doc[order]]]
            chosen_yes = best[toxic[best]]
            hard = order[(place < 1) & ~toxic[order]]
        else:
            hard = no[:0]
        yes = np.resize(r.permutation(chosen_yes), min(max(len(chosen_yes), LEAST_TOXIC), MOST_TOXIC))
        hard = r.permutation(hard)[: MOST_CLEAN // 2]
        some = r.choice(no, min(len(no), max(2 * len(yes), MOST_CLEAN // 2), MOST_CLEAN - len(hard)), replace=False)
        mixed = r.permutation(np.concatenate([yes, some, hard]))
        for a in range(0, len(mixed), batch):
            step(mixed[a : a + batch])
    features = net.document_features(all_logits(), counts)
    net.last = fit_logistic(features, y)
    return net


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is the bias and not held back."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], decay * len(x))
    hold[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + hold * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """Scores texts with a network; keeps the gate inputs of the words it met."""

    def __init__(self, net: Network):
        self.net, self.rows, self.gates = net, {}, np.zeros((2, CACHE, 3 * STATES), np.float32)

    def score(self, words: list[list[bytes]]) -> np.ndarray:
        new = set().union(*words) - self.rows.keys() if words else set()
        if len(self.rows) + len(new) > len(self.gates[0]):
            self.rows.clear()
            new = set().union(*words)
            if len(new) > len(self.gates[0]):
                self.gates = np.zeros((2, len(new), 3 * STATES), np.float32)
        fresh = list(new)
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            at = len(self.rows)
            self.gates[:, at : at + len(part)] = self.net.gates(self.net.embed(word_features(part)))
            self.rows.update(zip(part, range(at, at + len(part))))
        ids = np.array([self.rows[w] for ws in words for w in ws], np.int64)
        starts, sizes, counts = windows_of(np.array([*map(len, words)], np.int64))
        logits = self.net.logits(ids, starts, sizes, self.gates)
        return self.net.score(self.net.document_features(logits, counts))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id", label: str = "toxic", held_out: bool = True) -> DataFrame:
    """(k, text, y): at most ``rows`` labelled texts, those of least hash of the key, in that order, in one partition. ``held_out``: not those that ``is_held_out`` names."""
    named = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    if held_out:
        named = named.where(~is_held_out(F.col("k")))
    named = named.orderBy(F.xxhash64("k"), "k").limit(rows)
    some = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(named), "k")
    return some.select("k", "text", "y").orderBy(F.xxhash64("k"), "k", "text").limit(rows)


def fit(rows: DataFrame) -> Network:
    """The network for ``training_rows``, trained in one task on an executor: the driver gets the finished model only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += [v.as_py() for v in batch.column("text")]
            labels += batch.column("y").to_pylist()
        if texts:
            yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(train(texts, labels))]})

    found = in_arrow(rows.coalesce(1), run, "net binary").collect()
    return pickle.loads(bytes(found[0]["net"])) if found else train([], [])


def is_held_out(key):
    """Whether a row is kept for testing: CRC-32 of its key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_scores(docs: DataFrame, net: Network, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in column ``to``.

    Null is the empty text, whose score is that of no windows. Texts of any length
    are scored over all their windows. Rows that repeat a text have the same
    score; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rest = [c for c in docs.columns if c != to]
    body = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(sent)
        scores, held, n = [], [], 0
        for v in batch.column("text"):
            held.append((v.as_py() or "").encode().split())
            n += len(held[-1])
            if n >= BLOCK:
                scores.append(scorer.score(held))
                held, n = [], 0
        if held:
            scores.append(scorer.score(held))
        return {f"c{i}": batch.column(f"c{i}") for i in range(len(rest))} | {"score": np.concatenate(scores) if scores else np.zeros(0)}

    kind = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(rest)] + [T.StructField("score", T.DoubleType())])
    out = per_batch(body, run, kind, forget)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("score").alias(to))


_SCORERS: dict[int, Scorer] = {}


def forget() -> None:
    _SCORERS.clear()


def _scorer(sent) -> Scorer:
    """A worker's scorer for a broadcast network, kept from batch to batch."""
    net = sent.value
    if id(net) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(net)] = Scorer(net)
    return _SCORERS[id(net)]


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a network trained on labels that are not held out."""
    docs = documents(spark, sf_dir)
    net = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = with_scores(docs.select("doc_id", "text"), net)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
