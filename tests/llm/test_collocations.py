"""Phrase collocations against counting and scoring by hand."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def counts_by_force(rows):
    f = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            f[lang, ""] += len(w)
            for k in (1, 2, 3):
                f.update((lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return +f


def by_force(rows, least=10, share=50, top=2000):
    f = counts_by_force(rows)
    many = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    out = []
    for (lang, phrase), a in many.items():
        w = phrase.split(" ")
        if len(w) == 2 and any(100 * b >= share * a for (x, q), b in many.items() if x == lang and q.count(" ") == 2 and phrase in (q.rsplit(" ", 1)[0], q.split(" ", 1)[1])):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w)))
        out.append((lang, phrase, a, l, r, f[lang, ""], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own[:top], 1)]
    return sorted(ranked)


def made_up(seed, n=120):
    r = random.Random(seed)
    words = ["a", "b", "The", "the", "ÉA", "x\x00y", "z", "𝔸", "c"]
    seps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " \r "]
    return [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(words) + r.choice(seps) for _ in range(r.randint(0, 60)))) for _ in range(n)] + [("en", None), (None, ""), ("en", "..,\n"), ("en", "   "), ("en", "a b " * 3000)]


@pytest.fixture
def short(monkeypatch):
    """Shards and blocks of a few words in this process; tasks use the library's own."""
    monkeypatch.setattr(collocations, "SHARD", 37)
    monkeypatch.setattr(collocations, "BLOCK", 50)


def test_split_in_blocks_equals_split_at_once(short):
    for _, text in made_up(5):
        whole = [w for p in pieces(text) for w in [*(x.encode() for x in p), b"\xff"]][:-1]
        assert [w for part in collocations.split((text or "").encode()) for w in part] == whole


@pytest.mark.parametrize("seed", range(4))
def test_states_enumerate_every_phrase_once(seed):
    r = random.Random(seed)
    ids = np.array([r.choice([0, 1, 1, 2, 3, 4]) for _ in range(r.choice([0, 1, 2, 3, 200]))], np.int32)
    carried = min(seed, len(ids), 2)
    back, longest, shortest, places = collocations.states(ids, carried)
    got = Counter()
    for j in range(len(longest)):
        word = [int(x) for x in back[::-1, j] if x]
        assert len(word) == longest[j] and 1 <= shortest[j] <= longest[j]
        for k in range(shortest[j], longest[j] + 1):
            assert tuple(word[-k:]) not in got
            got[tuple(word[-k:])] = int(places[j])
    want = Counter(tuple(ids[i - k + 1 : i + 1].tolist()) for i in range(carried, len(ids)) for k in (1, 2, 3) if i - k + 1 >= 0 and (ids[i - k + 1 : i + 1] > 0).all())
    assert got == want
    ends = {}  # phrases of one state end at the same places, phrases of two states don't
    for i in range(carried, len(ids)):
        for k in (1, 2, 3):
            if i - k + 1 >= 0 and (ids[i - k + 1 : i + 1] > 0).all():
                ends.setdefault(tuple(ids[i - k + 1 : i + 1].tolist()), []).append(i)
    assert len({tuple(x) for x in ends.values()}) == len(longest)


@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_shards_of_few_words_count_the_same(short, buckets):
    import pyarrow as pa

    rows = made_up(7)
    batch = pa.RecordBatch.from_pydict({"lang": ["und" if x is None else x for x, _ in rows], "text": [t or "" for _, t in rows]})
    sent = [x for out in collocations._automata(iter([batch.slice(0, 50), batch.slice(50)]), buckets) for x in out.to_pylist()]
    assert len({x["bucket"] for x in sent}) > buckets / 4
    schema = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])
    sent.sort(key=lambda x: x["bucket"])
    whole = [pa.RecordBatch.from_pylist(sent[i : i + 10], schema) for i in range(0, len(sent), 10)]
    got = [x for out in collocations._summed(iter(whole), 1) for x in out.to_pylist()]
    assert len({(x["lang"], x["phrase"]) for x in got}) == len(got)
    assert {(x["lang"], x["phrase"]): x["f"] for x in got} == counts_by_force(rows)


def test_collocations(spark):
    rows = made_up(1) + made_up(1)[:40]
    df = spark.createDataFrame([(x, t, "1", 2, 3) for x, t in rows], "lang string, text string, phrase string, f int, n int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df).collect())
    assert got == by_force(rows) and len(got) > 40
    few = sorted(tuple(r) for r in collocations.collocations(df, least=2, share=80, top=7).collect())
    assert few == by_force(rows, 2, 80, 7)


def test_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0 and collocations.phrase_counts(none).count() == 0
    assert collocations.phrase_counts(spark.createDataFrame([("en", None), (None, ". ,")], "lang string, text string")).count() == 0
