"""Each operator against brute force, and on odd tables: nulls, empty and very long texts, repeated rows, clashing names, nothing at all."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import mixing, near_duplicates, pii, quality_classifier, quality_rules, rabitq, recompression, secrets, sentencepiece_codec, simhash, toxicity, weak_supervision
from weftgraph.llm.sentencepiece_codec import Codec, public_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, n_copies string, k string, k0 string, doc string, mark string, gone string, keys string, fp string, ids string, spans string, score string, kept string, same string, base string, mixed_source string, mixed_rate string, n int"


def words_like(r, n, size=300):
    return " ".join("".join(r.choice(["an", "to", "re", "li", "mo", "sta", "ver", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n)) if size else ""


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(1)
    base = words_like(r, 400)
    passage = words_like(r, 70)
    texts = [None, "", "   \n\t ", "word", base, base, base.replace("an", "on", 1), passage + " x " + words_like(r, 60), words_like(r, 60) + " " + passage, "a" * 100_000, "ab " * 20_000,
             "token = \"0123456789abcdef0123456789abcdef01234567\" mail a.b@c.example.com or 10.0.0.1, 4111 1111 1111 1111, +1 (212) 555-0100", "Line\nLine\nLine\n" * 30, "𝔸é中 \x00 \x0b\x0c \x1f a b c", "▁ ▁▁ <s> <0x0A>", passage.upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, base), (None, base), (None, None)]
    return [(i, t, "en", None if i == 3 else "s" if i is None or i % 2 else "t", None, *["x"] * 17, 1) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


# ---- 1


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_codec_equals_the_library(library):
    codec, r = Codec(public_model()), random.Random(2)
    letters = "ab e ▁\n\té①𝔸中tionhe  \x00"
    for i in range(1500):
        s = "".join(r.choices(letters, k=r.randint(0, 60))) if i else "the" * 5000
        ids, begins, ends = codec.encode(s)
        assert ids.tolist() == library.encode(s)
        assert codec.decode(ids) == library.decode(ids.tolist())
        if s:
            assert [*zip(begins.tolist(), ends.tolist())] == [(p.begin, p.end) for p in library.encode(s, return_type="proto").pieces]
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(262), r.randrange(3, 259), 259, 1]) for _ in range(r.randint(0, 8))]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_normalisation_by_the_compiled_map():
    """A model with a compiled character map: the longest mapped string wins, and every byte knows its source."""
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    spec = dict(sentencepiece_codec.fields(norm.serialized_normalizer_spec()))
    codec = Codec(public_model())
    codec.charmap, codec.prefix, codec.squeeze = sentencepiece_codec.CharMap(spec[2]), True, True
    r = random.Random(3)
    letters = ["a", " ", "  ", "ﬁ", "①", "é", "é", "ａ", "　", "㌔", "\t", "中", "𝔸", "▁"]
    for _ in range(800):
        s = "".join(r.choices(letters, k=r.randint(0, 20)))
        got, at = codec.normalise(s)
        assert got == norm.normalize(s), s
        assert len(at) == len(got.encode()) + 1 and (np.diff(at) >= 0).all() and at[-1] <= len(s.encode())


def test_encoding_of_odd_rows(odd, nothing, library):
    out = sentencepiece_codec.with_digests(sentencepiece_codec.encode(odd, public_model(), decoded=True))
    assert out.count() == odd.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for i, r in by_id(out).items():
        ids = library.encode(texts[i])
        assert r["n_tokens"] == len(ids) and r["n_bytes"] == len(texts[i].encode())
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    apart = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, public_model()), public_model())
    assert sorted(map(str, sentencepiece_codec.with_digests(apart).collect())) == sorted(map(str, out.collect()))
    assert sentencepiece_codec.encode(nothing, public_model()).count() == 0


# ---- 2


def nearest_by_force(rows, k=5, every=50):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    m = np.array([ok[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        s = rabitq.cosines(np.broadcast_to(ok[i], m.shape), m)
        o = np.lexsort((ids, -s))
        out[i] = [ids[x] for x in o if ids[x] != i][:k]
    return out


def test_nearest(spark):
    r = np.random.default_rng(0)
    centers = r.standard_normal((12, 8))
    rows = [(i, (centers[i % 12] + 0.4 * r.standard_normal(8)).tolist()) for i in range(1500)]
    rows += [(i, rows[0][1]) for i in range(1500, 1900)] + [(2000, None), (2050, [0.0] * 8), (2100, [1.0, None] + [0.0] * 6), (2150, [float("nan")] * 8), (2200, [float("inf")] + [0.0] * 7), (2250, [1.0]), (None, rows[1][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x", "y", 0) for i, v in rows], "vec_id long, embedding array<float>, rep string, ids string, score int").repartition(5)
    got = collections.defaultdict(list)
    for q in rabitq.nearest(df, query_block=10, seed_rows=50).orderBy("query_id", "rank").collect():
        got[q["query_id"]].append(q["vec_id"])
        assert q["query_id"] != q["vec_id"]
    want = nearest_by_force([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    assert set(got) == set(want) and all(len(got[i]) == 5 for i in got)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.95
    assert got[1500] == want[1500]


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in rabitq.nearest(df).collect()] == [(0, 1, 1, 0.0)]
    assert rabitq.nearest(df.limit(0)).count() == 0
    assert rabitq.nearest(df.where("vec_id = 1")).count() == 0


# ---- 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(t):
    s = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(s, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_patterns():
    r, model = random.Random(3), secrets.default_model()
    parts = ["token", "=", ":", " ", '"', "password", "api_key", "ApiKey", "AKIA", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "K", "ſ", "deadbeef", "é", ".", "-", "x", "Z9", "\n"]
    for _ in range(5000):
        t = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert [s for s in secrets.find_spans(t, model) if s[0] != "markov"] == base_secrets(t)


def test_markov_models_tell_keys_from_identifiers():
    model = secrets.default_model()
    unseen = secrets.labelled_samples(3000, seed=77)
    hits = [model.ratio(s) >= secrets.MIN_RATIO for s, y in unseen if y and len(s) >= 16]
    alarms = [model.ratio(s) >= secrets.MIN_RATIO for s, y in unseen if not y and len(s) >= 16]
    assert np.mean(hits) > 0.97 and np.mean(alarms) < 0.005
    found = secrets.find_spans("key Zx81kQp0Lm2vT7yBs9RwE4 and international_university_names here", model)
    assert [s[0] for s in found] == ["markov"]


def test_secrets_behind_ordinary_text():
    r, model = random.Random(51), secrets.default_model()
    for before in ("com/services/", "com/api/v1/users/", "reset_link=", "sk_live_"):
        hits = 0
        for _ in range(300):
            key = "".join(r.choices(secrets.ALPHABET[:62], k=24))
            at = 4 + len(before)
            hits += any(s <= at and e >= at + 24 for _, s, e in secrets.find_spans(f"see {before}{key}/list now", model))
        assert hits >= 291, before
    plain = [s for s, y in secrets.labelled_samples(3000, seed=78) if not y]
    assert sum(bool(secrets.find_spans("/".join(plain[i : i + 3]), model)) for i in range(0, len(plain), 3)) <= 0.005 * len(plain) / 3
    text = "AKIA" + "Z9" * 8 + "/wJalrXUtnFEMIk7MDENGbPxRfiCYq3kd"  # the second half of a token that a pattern touches
    found = secrets.find_spans(text, model)
    assert [s[0] for s in found] == ["access", "markov"] and found[1][2] == len(text)


def test_scan_and_redaction_of_odd_rows(odd, nothing):
    out = secrets.scan(odd)
    assert out.count() == odd.count() and secrets.scan(nothing).count() == 0
    spans = {i: [tuple(s) for s in r["spans"]] for i, r in by_id(out).items()}
    assert [s[0] for s in spans[11]] == ["assign", "hex"] and spans[1] == []
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns
    assert "0123456789abcdef" not in by_id(clean)[11]["text"] and by_id(clean)[0]["text"] is None and by_id(clean)[4]["text"] == by_id(odd)[4]["text"]


def test_secrets_of_other_origin():
    """Keys and names that no rule of ours made: encoded digests in running text, and what Python's own library calls its things. No pattern catches the keys."""
    import base64
    import importlib

    ways = [
        lambda d: base64.b64encode(d[:24]).decode(), lambda d: base64.urlsafe_b64encode(d[:18]).decode(), lambda d: base64.b32encode(d[:20]).decode(),
        lambda d: "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[x % 62] for x in d[:28]), lambda d: "".join("0123456789abcdefghijklmnopqrstuvwxyz"[x % 36] for x in d[:32]),
    ]
    model, found = secrets.default_model(), []
    for i in range(1000):
        key = ways[i % 5](hashlib.sha512(f"seed {i}".encode()).digest())
        before = ("Bitte ", "see https://example.org/services/", "la clave es ")[i % 3]
        spans = secrets.find_spans(f"{before}{key} verwenden, the rest stays.", model)
        assert not any(k in ("assign", "access") for k, _, _ in spans)
        a, b = len(before), len(before) + len(key)
        found.append(sum(max(0, min(b, e) - max(a, s)) for _, s, e in spans) >= 0.8 * len(key))
    assert np.mean(found) >= 0.97
    names = set()
    for module in "os sys json logging argparse subprocess threading unittest.mock http.client urllib.parse email.message asyncio multiprocessing ssl socket ast inspect decimal datetime typing sqlite3 zipfile tarfile".split():
        of = importlib.import_module(module)
        names |= {x for n in dir(of) for x in (n, f"{module.replace('.', '/')}/{n}", *dir(getattr(of, n)))}
    long = sorted(n for n in names if secrets.TOKEN.fullmatch(n))
    assert len(long) > 1500 and np.mean([bool(secrets.find_spans(f"call {n} here", model)) for n in long]) <= 0.01


# ---- 4

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_pii(t):
    def ok(k, s):
        d = re.sub("[^0-9]", "", s)
        if k == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if k == "card":
            return 13 <= len(d) <= 19 and sum((lambda y: y - 9 if y > 9 else y)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0
        return k != "phone" or 9 <= len(d) <= 15

    return [(k, *m.span()) for k in PII for m in re.finditer(PII[k], t) if ok(k, m[0])]


def test_personal_data(spark, odd, nothing):
    r = random.Random(2)
    parts = ["a", "@", "b", ".", "1", "12", "255", "+", " ", "(", ")", "-", "4", "_", "x@y.z", "4111111111111111", "00", "\n", "é", "𝔸", "my name is Ann Lee ", "078-05-1120", "call (212) 555-0100 "]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(3000)] + ["a" * 50_000, "a.b@" * 2000, "1" * 50_000, "a@b" + ".c" * 5000]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for i, row in by_id(pii.find_personal_data(df)).items():
        assert [tuple(s) for s in row["base"]] == base_pii(texts[i])
        assert [tuple(s) for s in row["spans"]][: len(row["base"])] == base_pii(texts[i])
    out = pii.find_personal_data(odd)
    assert out.count() == odd.count() and pii.find_personal_data(nothing).count() == 0
    assert [s["kind"] for s in by_id(out)[11]["base"]] == ["email", "ip", "card", "phone"]


def test_personal_data_in_texts_full_of_it(spark):
    """Many thousand matches of several kinds in one text: the same spans as brute force, in seconds."""
    r = random.Random(12)
    kinds = [lambda: f"u{r.randrange(99)}@h{r.randrange(9)}.org", lambda: f"10.0.{r.randrange(300)}.{r.randrange(300)}", lambda: f"+44 20 {r.randrange(10**7, 10**8)}", lambda: f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", lambda: "Mr John Smith", lambda: "word"]
    text = " ; ".join(r.choice(kinds)() for _ in range(20_000))
    df = spark.createDataFrame([(1, text), (2, text[:2000])], "doc_id long, text string")
    began = time.perf_counter()
    found = {x["doc_id"]: x for x in pii.candidates(df).collect()}
    assert time.perf_counter() - began < 60
    for i, t in ((1, text), (2, text[:2000])):
        base = [(x["kind"], x["start"], x["end"]) for x in found[i]["base"]]
        assert base == base_pii(t) and all(t[x["start"] : x["end"]] == x["value"] for x in found[i]["base"] + found[i]["more"])
        covered = set()
        for _, a, e in base:
            covered.update(range(a, e))
        assert not any(covered.intersection(range(x["start"], x["end"])) for x in found[i]["more"])
        named = [m.span() for m in re.finditer("John Smith", t)]
        assert [(x["start"], x["end"]) for x in found[i]["more"] if x["kind"] == "name"] == named


def test_estimation_finds_the_good_labeller():
    r = random.Random(5)
    counts = collections.Counter()
    for _ in range(4000):
        y = 1 if r.random() < 0.4 else -1
        counts[tuple(y if r.random() < p else -y for p in (0.95, 0.8, 0.7))] += 1
    share, table, post = weak_supervision.reliabilities(sorted(counts.items()))
    assert abs(share - 0.4) < 0.05 and table[0][1, 1] > table[1][1, 1] > table[2][1, 1] > 0.6
    assert post[1, 1, 1] > 0.95 > 0.05 > post[-1, -1, -1]
    assert weak_supervision.reliabilities([]) == (0.5, [], {})


def brute_fault_step(rows, post, alarm):
    """One round of the estimation, row by row: posteriors of the classes for each row."""
    n, labellers = len(rows), len(rows[0])
    mass = [sum(p[c] for p in post) for c in range(labellers + 1)]
    shares = [(m + 1e-6 * n) / (n * (1 + 1e-6 * (labellers + 1))) for m in mass]
    table = {}
    for c in range(labellers + 1):
        for j in range(labellers):
            got = {x: sum(p[c] for v, p in zip(rows, post) if v[j] == x) + 1e-6 * n for x in (-1, 0, 1)}
            share = {x: got[x] / sum(got.values()) for x in got}
            if c == 0:
                bad = (sum(p[0] for v, p in zip(rows, post) if v[j] == -1) + alarm * 0.01 * n) / (mass[0] + 0.01 * n)
                share = {-1: bad} | {x: share[x] * (1 - bad) / (share[0] + share[1]) for x in (0, 1)}
            table[c, j] = share
    out = []
    for v in rows:
        p = [shares[c] * math.prod(table[c, j][v[j]] for j in range(labellers)) for c in range(labellers + 1)]
        out.append([x / sum(p) for x in p])
    return out


def test_fault_classes():
    """Two labellers see one fault, a third another one, a fourth only errs, on one sound row in two thousand."""
    r, rows, sound = random.Random(9), [], []
    for _ in range(6000):
        kind = r.choices(["sound", "noise", "stutter"], [0.85, 0.1, 0.05])[0]
        see = lambda fault, p, q: -1 if r.random() < (p if kind == fault else q) else r.choice([0, 1, 1, 1])
        rows.append((see("noise", 0.95, 0.001), see("noise", 0.6, 0.01), see("stutter", 0.9, 0.001), see("none", 0, 0.0005)))
        sound.append(kind == "sound")
    counts = sorted(collections.Counter(rows).items())
    shares, table, post = weak_supervision.fault_classes(counts)
    assert sum((post[v] > 0.5) == s for v, s in zip(rows, sound)) >= 0.98 * len(rows)
    assert table[0, :, 0].max() < 0.02 and table[1, 0, 0] > 0.8 and table[3, 2, 0] > 0.8 and 0.8 < shares[0] < 0.9
    assert post[1, 1, 1, -1] > 0.5 > post[1, 1, -1, 1]  # who hardly ever votes against, and alone, errs
    assert all(abs(post[v] - p) < 1e-6 for v, p in weak_supervision.fault_classes([(v, 100.0 * n) for v, n in counts])[2].items())
    for worth in (0.002, 0.1, 1.0):  # the prior's weight hardly matters
        other = weak_supervision.fault_classes(counts, worth=worth)[2]
        assert sum(n for v, n in counts if (other[v] > 0.5) == (post[v] > 0.5)) >= 0.995 * len(rows)
    assert weak_supervision.fault_classes([])[2] == {}
    few = rows[:300]
    want = [[1 / (1 + v.count(-1)), *((x == -1) / (1 + v.count(-1)) for x in v)] for v in few]
    for _ in range(5):
        want = brute_fault_step(few, want, 0.0005)
    got = weak_supervision.fault_classes(sorted(collections.Counter(few).items()), rounds=5)
    fault = [j + 1 for j in range(4) if got[1][j + 1, j, 0] > 0.5]
    assert all(abs(got[2][v] - (1 - sum(p[c] for c in fault))) < 1e-9 for v, p in zip(few, want))


# ---- 5


def brute_fingerprint(t, k=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    n = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(s))


def brute_components(fps, ids):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    u = sorted(root)
    for i, x in enumerate(u):
        for y in u[i + 1 :]:
            if (x ^ y).bit_count() <= 2 and find(x) != find(y):
                root[find(y)] = find(x)
    least = {}
    for f, i in zip(fps, ids):
        least[find(f)] = min(least.get(find(f), i), i)
    return [least[find(f)] for f in fps]


def test_fingerprints_of_odd_rows(odd, nothing):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    fps = simhash.fingerprints(odd)
    assert fps.count() == odd.count()
    for i, r in by_id(fps).items():
        assert r["fp"] & (1 << 64) - 1 == brute_fingerprint(texts[i])
    out = simhash.components(fps)
    assert out.count() == odd.count()
    assert {by_id(out)[i]["component_id"] for i in (0, 1, 2)} == {0} and by_id(out)[5]["component_id"] == 4
    assert simhash.components(simhash.fingerprints(nothing)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 17, 300, 1500])
def test_gray_index(n):
    r = np.random.default_rng(n)
    x = r.integers(0, 1 << 64, size=max(1, n // 20), dtype=np.uint64)[r.integers(0, max(1, n // 20), n)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) * r.integers(0, 2, n).astype(np.uint64)
    x = np.unique(x)
    index = simhash.GrayIndex(x)
    q, p = index.within(x, 2)
    assert {*zip(x[q].tolist(), index.fps[p].tolist())} == {(int(a), int(b)) for a in x for b in x[np.bitwise_count(x ^ a) <= 2]}


def test_components_with_refined_nodes(spark):
    r = np.random.default_rng(4)
    x = np.unique(np.concatenate([(np.uint64(12345) << np.uint64(32)) + r.integers(0, 1 << 12, 400).astype(np.uint64), r.integers(0, 1 << 64, 300, dtype=np.uint64)]))
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x.view(np.int64))], "doc_id long, fp long")
    got = {i: r["component_id"] for i, r in by_id(simhash.components(df, refine=30)).items()}
    assert [got[i] for i in range(len(x))] == brute_components([int(v) for v in x], range(len(x)))


def brute_groups(rows, similarity=0.8):
    sets = {i: set(simhash.shingles(t or "", 5)) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids if find(i) != i}


def test_near_duplicates(spark, odd, nothing):
    r = random.Random(6)
    rows = []
    for g in range(40):
        t = words_like(r, r.randint(20, 300)).split()
        for _ in range(r.choice([1, 1, 2, 3, 30 if g < 2 else 4])):
            s = list(t)
            for _ in range(int(len(t) * r.choice([0, 0.004, 0.01, 0.02, 0.05]))):
                s[r.randrange(len(s))] = words_like(r, 1)
            rows.append((len(rows), " ".join(s)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_groups(rows)
    got = dict(near_duplicates.groups(df).collect())
    assert len(set(got) ^ set(want)) <= 0.02 * len(want) and not set(got) - set(want)
    kept = near_duplicates.drop_near_duplicates(odd)
    ids = sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None)
    assert 5 not in ids and 1 not in ids and {0, 4, 7, 8} <= set(ids) and kept.where("doc_id is null").count() == 2
    assert near_duplicates.drop_near_duplicates(nothing).count() == 0


def test_small_sets_are_decided_by_their_shingles(spark):
    r, rows = random.Random(21), []
    for g in range(60):
        t = [f"w{r.randrange(10**9)}" for _ in range(8)]
        rows += [(2 * g, " ".join(t)), (2 * g + 1, " ".join([*t, "more"]))]  # 4 shingles in 5
    for g in range(60, 120):
        t = [f"w{r.randrange(10**9)}" for _ in range(12)]
        rows += [(2 * g, " ".join(t)), (2 * g + 1, " ".join([*t[:11], "other"]))]  # 7 common of 9
    pairs = spark.createDataFrame([(2 * g, 2 * g + 1) for g in range(120)], "a long, b long")
    df = spark.createDataFrame(rows, "doc long, text string")
    found = near_duplicates.similarity_of(pairs, near_duplicates.profiles(df)).collect()
    assert len(found) == 120 and all(abs(x["alike"] - 0.8) < near_duplicates.BELOW for x in found)
    same = near_duplicates.exactly_alike(pairs, df, 0.8)
    assert sorted(x["a"] for x in same.collect()) == list(range(0, 120, 2))


@pytest.mark.parametrize("n", [64, 180, 900])
def test_near_copies_share_a_key_whatever_the_size_of_the_table(n):
    """Keys and fingerprints know nothing of the table: 0.8 is found as often among a billion texts as here."""
    r = np.random.default_rng(31)
    few = lambda k: r.integers(0, 1 << 64, k, dtype=np.uint64)
    sets = []
    for _ in range(400):
        common = few(n - n // 9)  # 8 of 9 in both: 8 of 10 in all
        sets += [np.unique(np.concatenate([common, few(n // 9)])) for _ in range(2)]
    x = near_duplicates.sketches(sets)
    keys = np.concatenate([near_duplicates.keys_of(x[i : i + 100]) for i in range(0, 800, 100)])
    assert keys.shape == (800, near_duplicates.TABLES * near_duplicates.PROBES)
    assert sum(np.intersect1d(keys[i], keys[i + 1]).size > 0 for i in range(0, 800, 2)) >= 397
    assert np.mean([np.intersect1d(keys[i], keys[i + 3]).size for i in range(0, 796, 2)]) < 0.02  # others hardly meet
    bits = np.packbits(near_duplicates.rotated(x) > 0, axis=1).view(np.uint64)
    size = np.array([len(s) for s in sets])
    alike = near_duplicates.jaccard_estimate(np.bitwise_count(bits[::2] ^ bits[1::2]).sum(1), size[::2], size[1::2])
    common = np.array([len(np.intersect1d(sets[i], sets[i + 1])) for i in range(0, 800, 2)])
    off = alike - common / (size[::2] + size[1::2] - common)
    assert off.max() < near_duplicates.ABOVE + 0.01 and (off > -near_duplicates.BELOW).mean() >= 0.99 and abs(off.mean()) < 0.005


def test_sketches_do_not_depend_on_their_neighbours():
    r = np.random.default_rng(33)
    sets = [np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (0, 1, 70, 5000, 90_000)]
    x = near_duplicates.sketches(sets)
    for i, s in enumerate(sets):
        one = near_duplicates.sketches([s])
        assert (near_duplicates.rotated(one)[0] == near_duplicates.rotated(x)[i]).all()
        assert (near_duplicates.keys_of(one)[0] == near_duplicates.keys_of(x)[i]).all()


def test_small_sets_share_a_lowest_hash():
    r = np.random.default_rng(32)
    for n in range(1, 90):
        for m in range(n, n * 5 // 4 + 1):
            need = -(-4 * (n + m) // 9)  # common >= 0.8 of the union
            if need <= n and (n, m) != (need, need):
                x = r.integers(0, 1 << 63, n + m - need, dtype=np.uint64) * np.uint64(2)
                a, b = (near_duplicates.prefix_keys(np.unique(v), 0.8) for v in (x[:n], x[n - need :]))
                assert np.intersect1d(a, b).size, (n, m)


def test_large_groups_of_a_template(spark):
    """Texts of one template are 0.5 to 0.7 alike, too near for keys to tell apart; a few have a near copy."""
    r, rows = random.Random(41), []
    word = lambda: f"w{r.randrange(10**9)}"
    shared = [word() for _ in range(120)]
    for g in range(250):
        own = [word() for _ in range(r.randint(20, 40))]
        rows.append((len(rows), " ".join(shared + own)))
        if g % 5 == 0:
            copy = list(shared)
            copy[60:63] = [word(), word(), word()]
            rows.append((len(rows), " ".join(copy + own)))
    want = brute_groups(rows)
    listed = near_duplicates.profiles(spark.createDataFrame(rows, "doc long, text string"))
    sets = listed.selectExpr("doc", "same", "n", "print", "near", "more", "array(1L) as keys")  # one key: the group has all texts
    found = near_duplicates.candidate_pairs(sets).cache()
    members = found.where("b is null").selectExpr("key", "a as doc").cache()
    none = spark.createDataFrame([], "v long, component long")
    text_of = spark.createDataFrame(rows, "doc long, text string")
    apart = near_duplicates.links_in_dense(members, sets, text_of, none)
    ids = {i for i, _ in rows}
    assert want and {(x["a"], x["b"]) for x in apart.collect()} == {(b, a) for a, b in want.items()}  # pairs, so the forest has all
    of = spark.createDataFrame([(i, 0) for i in range(0, 200, 2)], "v long, component long")
    tiles, near_duplicates.TILE = near_duplicates.TILE, 32
    try:
        dealt = near_duplicates.in_tiles(members, of, sets).collect()
    finally:
        near_duplicates.TILE = tiles
    homes, visits = collections.defaultdict(set), collections.defaultdict(set)
    for x in dealt:
        (homes if x["home"] else visits)[x["key"]].add(x["doc"])
    assert len(homes) > 10
    met = {frozenset((a, b)) for k in homes for a in homes[k] for b in visits[k]}
    one = set(range(0, 200, 2))
    assert max(len(homes[k]) for k in homes) <= 64 and max(len(visits[k]) for k in homes) <= 64
    assert all(frozenset((a, b)) in met for a in ids for b in range(a) if not {a, b} <= one)
    assert dict(near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


@pytest.mark.parametrize("n", [64, 180, 900])
def test_near_copies_share_a_finer_key(n):
    """However often keys are refined: 0.8 alike still share one of their keys in 99 %, and texts that share none before share none after."""
    r = np.random.default_rng(35)
    few = lambda k: r.integers(0, 1 << 64, k, dtype=np.uint64)
    sets = []
    for _ in range(400):
        common = few(n - n // 9)
        sets += [np.unique(np.concatenate([common, few(n // 9)])) for _ in range(2)]
    x = near_duplicates.sketches(sets)
    keys = [*np.concatenate([near_duplicates.keys_of(x[i : i + 100]) for i in range(0, 800, 100)])]
    for level in range(1, near_duplicates.LEVELS + 1):
        at = np.repeat(np.arange(800), [len(k) for k in keys])
        finer = near_duplicates.finer_keys(x, at, np.concatenate(keys), level)
        assert (finer > 0).all() and (finer < 1 << 62).all()
        keys = [np.unique(finer[at == i]) for i in range(800)]
        if level == 1:
            assert sum(np.intersect1d(keys[i], keys[i + 1]).size > 0 for i in range(0, 800, 2)) >= 396
    assert sum(np.intersect1d(keys[i], keys[i + 1]).size > 0 for i in range(0, 800, 2)) >= 370
    assert np.mean([np.intersect1d(keys[i], keys[i + 3]).size for i in range(0, 796, 2)]) < 0.02


@pytest.mark.parametrize("leaf", [1, 4, 30])
def test_keys_that_too_many_texts_have(spark, leaf):
    """With far lower limits than the library's, keys are refined up to the last level and what is left goes to tiles: the groups are brute force's."""
    r, rows = random.Random(47), []
    word = lambda: f"w{r.randrange(10**9)}"
    shared = [word() for _ in range(100)]
    for g in range(60):
        own = shared + [word() for _ in range(25)] if g % 2 else [word() for _ in range(120)]
        rows.append((len(rows), " ".join(own)))
        if g % 6 < 2:
            own[60] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + i, " ".join([*shared[:12], word()])) for i in range(12)]  # short ones, by their lowest hashes
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert dict(near_duplicates.groups(df, leaf=leaf).collect()) == brute_groups(rows)


def test_a_key_over_the_limit_is_never_put_together():
    import pyarrow as pa

    r = np.random.default_rng(9)
    key = np.sort(np.r_[np.full(500, 7), np.full(90, 3), r.integers(10, 40, 200)])
    table = pa.table({"key": key, "row": np.arange(len(key))})
    whole, rest, most = [], [], [0]

    def fn(k, row):
        assert len(set(k.to_pylist())) >= 1
        whole.append(row.to_pylist())
        return iter(())

    def beyond(k, row):
        most.append(len(k))
        rest.append((set(k.to_pylist()), row.to_pylist()))
        return iter(())

    for size in (1, 7, 64, 1000):
        whole.clear(), rest.clear()
        list(near_duplicates.by_key(fn, 100, beyond)(iter(table.to_batches(max_chunksize=size))))
        assert sorted(x for w in whole for x in w) + sorted(x for _, w in rest for x in w) and sorted([*(x for w in whole for x in w), *(x for _, w in rest for x in w)]) == list(range(len(key)))
        assert {k for ks, _ in rest for k in ks} == ({7} if size < 500 else set())
        assert all(len({int(key[x]) for x in w}) == len(set(map(int, key[w]))) for w in whole)
        for k in {3, *range(10, 40)}:  # every other key is in one piece
            assert sum(any(key[x] == k for x in w) for w in whole) == (1 if (key == k).any() else 0)


def test_many_near_copies_in_one_partition(spark):
    """Of texts copied with changes very often, those which come first in a partition stand for the others; chains off them are still found."""
    r = random.Random(43)
    word = lambda: f"w{r.randrange(10**9)}"
    first = [word() for _ in range(200)]
    rows = [(i, " ".join([*first[: (k := r.randrange(190))], word(), *first[k + 1 :]])) for i in range(300)]
    far = first
    for i in range(300, 312):  # each 0.8 like the one before, the last ones far from the first
        far = [*far[10:], *(word() for _ in range(10))]
        rows.append((i, " ".join(far)))
    rows += [(400 + i, words_like(r, 150)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    listed = near_duplicates.profiles(df.toDF("doc", "text"))
    sent = near_duplicates.forwarded(listed.select("doc", "near", "more", "keys"), 0.8).cache()
    assert sent.count() == listed.selectExpr("sum(size(keys))").first()[0]
    hot = sent.groupBy("key").count().where(f"count >= {near_duplicates.HOT}").select("key")
    among = sent.join(hot, "key").where("doc < 300")
    assert among.where("first is null").count() <= 0.05 * among.count() > 0 and sent.where("doc >= 400 and first is not null").count() == 0
    assert dict(near_duplicates.groups(df).collect()) == brute_groups(rows)


def test_rows_that_share_an_id(spark):
    r = random.Random(44)
    a, b, c = (words_like(r, 80) for _ in range(3))
    a, b = sorted([a, b])
    rows = [(1, a), (1, b), (2, b), (3, a), (4, c), (4, c), (5, None), (6, ""), (7, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(near_duplicates.groups(df).collect()) == {3: 1, 6: 5, 7: 5}
    assert sorted(x["doc_id"] for x in near_duplicates.drop_near_duplicates(df).collect()) == [1, 1, 2, 4, 4, 5]


# ---- 6


def brute_measures(t):
    w = WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cov = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), dup, len(cov)


def test_measures(spark, odd, nothing):
    r = random.Random(7)
    texts = ["".join(r.choices(["a", "b", " ", "\n", "#", "é", "𝔸", "\x0b", " "], k=r.randint(0, 60))) for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for d, of in ((df, dict(enumerate(texts))), (odd, {x["doc_id"]: x["text"] or "" for x in odd.collect()})):
        for i, x in by_id(quality_rules.measures(d)).items():
            assert tuple(x)[2:] == brute_measures(of[i])
    assert quality_rules.measures(nothing).count() == 0


def test_cascade_order_does_not_change_verdicts(odd, nothing):
    m = quality_rules.measures(odd)
    rules = quality_rules.default_rules()
    want = {i: x["r"] for i, x in by_id(m.withColumn("r", ~F.greatest(*[F.coalesce(r.rejects, F.lit(False)) for r in rules]))).items()}
    assert {i: x["kept"] for i, x in by_id(quality_rules.cascade(m)).items()} == want
    assert want[4] and not want[12]
    cheap = {"a": (1.0, 0.5), "b": (0.1, 0.4), "c": (0.1, 0.0)}
    assert [r.name for r in quality_rules.order([quality_rules.Rule(n, F.lit(True)) for n in "abc"], cheap)] == ["b", "a", "c"]
    assert quality_rules.cascade(quality_rules.measures(nothing)).count() == 0


# ---- 7


def test_mixing(spark, odd, nothing):
    rows = [(i, "abc"[0 if i < 2000 else 1 + i % 2]) for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mix(df, {"a": 1, "b": 1, "c": 2, "": 40}, size=4000).cache()
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for s, share in (("a", 1), ("b", 1), ("c", 2), (None, 40)):
        assert abs(n[s] - 4000 * share / 44) < 5 * (4000 * share / 44) ** 0.5
    again = mixing.mix(df.repartition(7), {"a": 1, "b": 1, "c": 2, "": 40}, size=4000, max_broadcast_rows=1)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, again.collect()))
    by = collections.defaultdict(list)
    for r in out.collect():
        by[r["doc_id"]].append((r["copy"], r["n_copies"]))
    assert all(sorted(c for c, _ in v) == [*range(1, v[0][1] + 1)] for v in by.values())
    assert mixing.mix(df, {}).count() == 0 and mixing.mix(nothing).count() == 0
    assert "copy" in mixing.mix(odd).columns
    out = mixing.mix(odd, copy="time", n_copies="times").collect()
    assert out and all(r[c] == "x" for r in out for c in ("copy", "n_copies", "mixed_source", "mixed_rate", "score")) and all(1 <= r["time"] <= r["times"] for r in out)


def test_poisson_inversion(spark):
    for mean in (0.1, 1.0, 15.9):
        df = spark.range(20_000).select(mixing.poisson(F.lit(mean), mixing.uniform(F.lit("s"), F.col("id").cast("string"))).alias("n"))
        m, v = df.agg(F.avg("n"), F.variance("n")).first()
        assert abs(m - mean) < 5 * (mean / 20_000) ** 0.5 and abs(v / mean - 1) < 0.1


# ---- 8


def brute_dedup(rows, n=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in sorted(words):
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p : p + n]), i)
    out = {}
    for i, w in words:
        gone = [0] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [1] * n
        out[i] = len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()
    return out


def test_substring_dedup_with_a_passage_over_many_batches(spark):
    """A passage that most texts have: its groups go on over many batches and are not held."""
    r = random.Random(52)
    passage = words_like(r, 20)
    rows = [(i, " ".join([words_like(r, r.randint(3, 9)), passage, words_like(r, r.randint(3, 9))]) if i % 4 else words_like(r, 30)) for i in range(3000)]
    r.shuffle(rows)
    records = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {x["doc_id"]: (x["n_removed"], x["kept"]) for x in recompression.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    want = brute_dedup(rows)
    assert got == {i: x[1:] for i, x in want.items()} and sum(x[1] >= 20 for x in want.values()) > 2000


def test_substring_dedup(spark, odd, nothing):
    r = random.Random(4)
    ps = [[r.choice("abcde") for _ in range(r.randint(5, 60))] for _ in range(20)]
    rows = [(i, " ".join(sum([r.choice(ps) if r.random() < 0.5 else [r.choice("ab")] * r.randint(1, 20) for _ in range(r.randint(0, 6))], []))) for i in range(400)]
    r2 = random.Random(5)
    long = words_like(r2, 80)
    rows += [(1000 + i, words_like(r2, r2.randint(0, 50)) + " " + long[r2.randrange(200) :] + " " + words_like(r2, 20)) for i in range(100)]
    got = by_id(recompression.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)))
    assert {i: tuple(x)[1:] for i, x in got.items()} == brute_dedup(rows)
    apart = [(i, t) for t, i in {t: i for i, t in rows}.items()]  # without whole copies, which a digest finds: symbols alone
    alone = by_id(recompression.dedup_substrings(spark.createDataFrame(apart, "doc_id long, text string").repartition(7)))
    want = brute_dedup(apart)
    assert {i: tuple(x)[1:] for i, x in alone.items()} == want and sum(x[1] > 0 for x in want.values()) > 100
    out = recompression.dedup_substrings(odd)
    assert out.count() == odd.count()
    known = [(x["doc_id"], x["text"]) for x in odd.collect() if x["doc_id"] is not None]
    assert {i: tuple(x)[1:] for i, x in by_id(out).items()} == brute_dedup(dict(known).items())
    assert {x["n_removed"] for x in out.where("doc_id is null").collect()} == {0, 400}
    assert recompression.dedup_substrings(nothing).count() == 0


# ---- 9


def labelled_texts(n, seed):
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        w = words_like(r, r.randint(5, 120)).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w) + 1), r.choice(["grumble", "snarkly", "Blargh!"]))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_network_slopes():
    net = toxicity.Network.random(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    g = r.standard_normal((2, 5, 3, 3 * toxicity.STATES))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    d_logit = r.standard_normal(3)
    _, kept = net.forward(g, mask, True)
    slopes, d_g = net.backward(kept, d_logit)
    value = lambda: float((net.forward(g, mask) * d_logit).sum())
    for name, at in [("rec", (0, 1, 2)), ("rec", (1, 3, 20)), ("att", (3, 2)), ("att_v", (1,)), ("att_b", (0,)), ("out", (5,)), ("out_b", (0,))]:
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = value()
        net.p[name][at] = old - 1e-3
        down = value()
        net.p[name][at] = old
        assert slopes[name][at] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=2e-4)
    for at in [(0, 1, 0, 3), (1, 4, 2, 17), (0, 0, 1, 10)]:
        old = g[at]
        g[at] = old + 1e-3
        up = value()
        g[at] = old - 1e-3
        down = value()
        g[at] = old
        assert d_g[at] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=2e-4)


def test_toxicity_learns(spark, odd, nothing):
    net = toxicity.train(*labelled_texts(600, 1))
    texts, labels = labelled_texts(200, 2)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = by_id(toxicity.with_scores(df, net))
    assert np.mean([(got[i]["score"] >= 0.5) == labels[i] for i in range(200)]) > 0.95
    out = toxicity.with_scores(odd, net)
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns)
    assert all(0 <= x["score"] <= 1 for x in out.collect()) and toxicity.with_scores(nothing, net).count() == 0
    scores = {x["doc_id"]: x["score"] for x in out.collect()}
    assert scores[0] == scores[1] == scores[2]
    assert toxicity.train([], []).score(np.zeros((1, toxicity.TOP + 2)))[0] <= 0.5


def test_held_out_rows_are_not_learnt(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    ids, y = [int(r["text"].split()[1]) for r in rows], [r["y"] for r in rows]
    assert sorted(ids) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 5] and y == [i % 2 for i in ids]
    few = toxicity.training_rows(docs, labels, rows=10)
    assert few.count() == 10
    net, again = toxicity.fit(few), toxicity.train([r["text"] for r in few.collect()], [r["y"] for r in few.collect()])
    assert np.allclose(net.last, again.last, atol=1e-4)
    assert toxicity.fit(few.limit(0)).p.keys() == again.p.keys()


# ---- 10


def test_scores_equal_a_plain_loop(odd_rows):
    r = random.Random(12)
    made = [t or "" for _, t, *_ in odd_rows] + [words_like(r, n).replace(" ", r.choice([" ", "\n", " \t "])) for n in (1, 2, 5, 40, 400)] + ["a a a b\nA A\n\nb!\nb!\n b! \nc", "Ünter 12ab ABC 3.5%"]
    scorer = quality_classifier.train(made, [i % 2 for i in range(len(made))])

    def plain(text):
        weight = lambda f: float(scorer.weights[xxhash.xxh64_intdigest(f.encode()) % quality_classifier.BUCKETS])
        words, z = WORD.findall(text), scorer.bias
        if not words:
            return 1 / (1 + math.exp(-(z + weight("empty"))))
        n, distinct, same = len(words), len(set(words)), sum(a == b for a, b in zip(words, words[1:]))
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        whole = [f"variety {min(len(bin(n)) - 2, 12)} {int(10 * distinct / n)}", f"distinct {int(10 * distinct / n)}", f"same {int(10 * same / n)}"]
        whole.append(f"lines {int(4 * (1 - len(set(lines)) / len(lines)))}" if len(lines) > 3 else "few lines")
        for w in words:
            z += 10 / n * (weight("w " + w.lower()) + weight("s " + quality_classifier.shape(w)))
        z += sum(map(weight, whole))
        return 1 / (1 + math.exp(-max(-50, min(50, z))))

    want = [plain(t) for t in made]
    assert scorer.scores(iter(made)) == pytest.approx(want, abs=1e-9)
    cache, quality_classifier.CACHE = quality_classifier.CACHE, 3  # forgetting changes nothing
    try:
        assert scorer.scores(iter(made)) == pytest.approx(want, abs=1e-9)
    finally:
        quality_classifier.CACHE = cache
    assert len(scorer.scores(iter([]))) == 0


def test_quality_classifier(spark, odd, nothing):
    r = random.Random(8)
    good = [" ".join(r.choice(["the", "of", "and", "to"]) if r.random() < 0.3 else w for w in words_like(r, 120).split()) for _ in range(300)]
    bad = [" ".join(w + "###" for w in g.split()) for g in good[:30]] + [g.upper().replace(" ", "!! ") for g in good[30:60]]
    df = spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")
    got = by_id(quality_classifier.classify(df))
    assert all(got[i]["kept"] for i in range(300)) and not any(got[i]["kept"] for i in range(300, 360))
    counts = quality_classifier.pattern_counts(quality_classifier.labelled(df).select(*quality_classifier.LABELLERS))
    told = quality_classifier.accuracies(counts)
    assert told["symbols"][1] > 0.9 and max(x[0] for x in told.values()) < 0.05
    twice = by_id(quality_classifier.classify(df.union(df)).dropDuplicates())
    assert all(twice[i]["kept"] == got[i]["kept"] for i in got)  # repeated rows count as often, and fare alike
    out = quality_classifier.classify(odd)
    assert out.count() == odd.count() and quality_classifier.classify(nothing).count() == 0
    assert all(0 <= x["score"] <= 1 for x in out.collect())
