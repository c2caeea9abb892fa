"""The network's scoring path against plain loops: word features, windows, recurrent layers, attention, the last unit; and passages across window borders."""

import math
import random

import numpy as np
import pytest
import xxhash

from weftgraph.llm import toxicity
from weftgraph.llm.toxicity import DIM, GRAMS, SIZES, STATES, STRIDE, TOP, WINDOW, WORDS, Network, Scorer


def sig(x):
    return 1 / (1 + math.exp(-x))


def plain_features(word):
    """(word bucket, n-gram buckets) of one word, byte by byte."""
    w = word.lower().strip(toxicity.TRIM) or word
    text = b"^" + w + b"$"
    grams = []
    for n in SIZES:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
            grams.append(((h ^ h >> 29) * 0xD6E8FEB86659FD93 % 2**64) >> 49)
    return xxhash.xxh64_intdigest(w) % WORDS, grams


def plain_logit(net, words):
    """The logit of one window, a word and a number at a time."""
    p, rows = net.p, []
    for w in words:
        bucket, grams = plain_features(w)
        rows.append([*p["words"][bucket].astype(float), *(sum(p["grams"][g].astype(float) for g in grams) / math.sqrt(len(grams)) if grams else np.zeros(DIM))])
    states = []
    for way in (0, 1):
        h, own = [0.0] * STATES, [None] * len(words)
        for t in range(len(words)) if way == 0 else reversed(range(len(words))):
            g = [sum(rows[t][i] * float(p["inp"][way, i, j]) for i in range(2 * DIM)) + float(p["inp_b"][way, 0, j]) for j in range(3 * STATES)]
            u = [sum(h[i] * float(p["rec"][way, i, j]) for i in range(STATES)) for j in range(3 * STATES)]
            z = [sig(g[j] + u[j]) for j in range(STATES)]
            r = [sig(g[STATES + j] + u[STATES + j]) for j in range(STATES)]
            n = [math.tanh(g[2 * STATES + j] + r[j] * u[2 * STATES + j]) for j in range(STATES)]
            h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in range(STATES)]
            own[t] = h
        states.append(own)
    both = [a + b for a, b in zip(*states)]
    e = [sum(math.tanh(sum(x * float(p["att"][i, k]) for i, x in enumerate(s)) + float(p["att_b"][k])) * float(p["att_v"][k]) for k in range(len(p["att_v"]))) for s in both]
    weight = [math.exp(x - max(e)) for x in e]
    pooled = [sum(w * s[i] for w, s in zip(weight, both)) / sum(weight) for i in range(2 * STATES)]
    return sum(x * float(o) for x, o in zip(pooled, p["out"])) + float(p["out_b"][0])


def plain_windows(n):
    """(start, size) over a text of n words: one starts every STRIDE words until one reaches the end."""
    out, at = [], 0
    while n > 0:
        out.append((at, min(WINDOW, n - at)))
        if at + WINDOW >= n:
            break
        at += STRIDE
    return out


def plain_score(net, words):
    logits = [plain_logit(net, words[a : a + n]) for a, n in plain_windows(len(words))]
    top = [max(x, -6.0) for x in sorted(logits, reverse=True)[:TOP]]
    features = [1.0, *top, *[-6.0] * (TOP - len(top)), math.log1p(len(logits))]
    return sig(sum(f * float(w) for f, w in zip(features, net.last)))


@pytest.fixture(scope="module")
def net():
    made = Network.random(5)
    r = np.random.default_rng(6)
    for k in ("inp_b", "att_b", "out_b"):
        made.p[k] = made.p[k] + r.standard_normal(made.p[k].shape).astype(np.float32) * 0.3
    made.last = r.standard_normal(TOP + 2)
    return made


LETTERS = ["a", "b", "Zu", "é", "ß", "!", "x-y", "0", "中"]


def text_of(r, n):
    return [("".join(r.choices(LETTERS, k=r.randint(1, 6)))).encode() for _ in range(n)]


def test_word_features():
    r = random.Random(1)
    words = [*text_of(r, 60), b"!", b"...", b"A", b"a", b"abcdefgh" * 40]
    bucket, grams, stops = toxicity.word_features(words)
    starts = [0, *stops[:-1].tolist()]
    for i, w in enumerate(words):
        want = plain_features(w)
        assert bucket[i] == want[0] and sorted(grams[starts[i] : stops[i]].tolist()) == sorted(want[1]) and max(want[1], default=0) < GRAMS
    some = toxicity.many_features(words, 7)
    assert all((a == b).all() for a, b in zip(some, (bucket, grams, stops)))


def test_windows_cover_every_place_and_short_passages_whole():
    sizes = np.array([0, 1, STRIDE, WINDOW - 1, WINDOW, WINDOW + 1, 3 * WINDOW, 0, 500])
    starts, lengths, counts = toxicity.windows_of(sizes)
    first, at = np.cumsum(sizes) - sizes, 0
    for f, n, c in zip(first, sizes, counts):
        got = [(int(s - f), int(m)) for s, m in zip(starts[at : at + c], lengths[at : at + c])]
        at += c
        assert got == plain_windows(int(n))
        assert {x for s, m in got for x in range(s, s + m)} == set(range(n))
        for k in (1, WINDOW - STRIDE + 1):  # a passage of up to 17 words is whole in one
            assert all(any(s <= x and x + k <= s + m for s, m in got) for x in range(n - k + 1))


def test_scores_equal_plain_loops(net):
    r = random.Random(2)
    texts = [text_of(r, n) for n in (0, 1, 2, 17, 32, 33, 70, 0, 130)]
    scorer = Scorer(net)
    want = [plain_score(net, t) for t in texts]
    assert scorer.score(texts) == pytest.approx(want, abs=2e-4)
    assert scorer.score(texts[::-1])[::-1] == pytest.approx(want, abs=2e-4)  # words met before, another order
    assert [float(scorer.score([t])[0]) for t in texts] == pytest.approx(want, abs=2e-4)  # and alone


def test_document_features(net):
    got = net.document_features(np.array([3.0, -9.0, 1.0, 2.0, 5.0, 0.5]), np.array([0, 5, 1]))
    assert got.tolist() == [[1, *[-6.0] * 4, 0], [1, 5.0, 3.0, 2.0, 1.0, pytest.approx(math.log(6))], [1, 0.5, *[-6.0] * 3, pytest.approx(math.log(2))]]


def test_passages_are_found_wherever_they_begin():
    """Trained on texts with a passage of 6 or 24 toxic words, the network finds such passages at every place of a long clean text, those across a border of windows as well."""
    r = random.Random(3)
    clean, toxic = [f"w{i}" for i in range(300)], [f"bad{i}" for i in range(25)]
    some = lambda n: [r.choice(clean) for _ in range(n)]
    passage = lambda n: [r.choice(toxic) if r.random() < 0.7 else r.choice(clean) for _ in range(n)]

    def made(bad):
        t = some(r.randint(40, 160))
        if bad:
            k = r.randint(0, len(t))
            t[k:k] = passage(r.choice([6, 24]))
        return " ".join(t)

    labels = [i % 4 == 0 for i in range(600)]
    net = toxicity.train([made(y) for y in labels], [int(y) for y in labels])
    scorer = Scorer(net)
    as_bytes = lambda ws: [w.encode() for w in ws]
    for n in (6, 24):
        places = []
        for k in range(64):
            t = some(200)
            t[k + 60 : k + 60] = passage(n)
            places.append(as_bytes(t))
        found = scorer.score(places) >= 0.5
        assert found.mean() >= 0.9
        across = [(k + 60) // STRIDE != (k + 60 + n - 1) // STRIDE for k in range(64)]
        assert found[np.array(across)].mean() >= 0.9
    assert (scorer.score([as_bytes(some(200)) for _ in range(64)]) >= 0.5).mean() <= 0.05
