"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two Markov chains over characters, one fitted to labelled random strings and one
to labelled ordinary words and identifiers, score every long enough token. A
token whose log-likelihood ratio per character passes a threshold is a span of
kind ``markov``; of other tokens, the best runs of segments between / = _ - +
are, so that ordinary text in the same token hides nothing. What a pattern's span
covers is left out, the rest of its token is judged. The models are a
few tables of 66 by 66 numbers; scoring needs one pass over the text and no
shuffle.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import documents, per_batch, texts

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Shortest token that the models judge, and the least ratio, in nats a character.
MIN_TOKEN, MIN_RATIO = 16, 0.6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Any match of ASSIGN holds one of these, in lower case.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CUT = re.compile(r"[/=_+-]+")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "markov")

#: Ordinary words, the stuff of the labelled identifiers.
WORDS = """
the and that with this from have are for not but was his her they which would there their what when your said will
about other into than then them these some could time only over new also after first well year work three such must
because through long little people between house before state again place part small number system world against
information government development international education management university experience technology organization
account address array base begin block body buffer build byte cache call char check child class client close code
column command common compare config connect content context control copy count create current data date default
delete device direct display document domain download driver element empty encode enable error event example exec
export factory field file filter find flag font format frame function get global graph group handle hash head height
host image import index init input insert instance integer item iterator join key label last layer layout length level
library line link list listener load local lock log login loop main manager map mask match matrix max memory menu
message method min mode model module mouse name network next node null number object offset option order output
package page panel parent parse password path pattern pixel play point policy pool port position post print process
profile project property proxy query queue random range read record ref region register release remove render reply
report request reset resource response result return root route row rule run sample save scale schema scope screen
script scroll search select send sequence server service session set shape shift size socket sort source space split
stack start state status step stop store stream string style submit sum super switch sync table tag target task test
text thread time title token tool top total trace track transform tree trigger type undo unit update upload url user
util valid value variable vector version view visible void wait width window word wrap write zone
der die und das ist nicht ein eine mit auf sich auch werden keit heit lich ung schaft verschiedenen gesellschaft
entwicklung wissenschaft arbeit zwischen menschen geschichte regierung bedeutung verwaltung moeglichkeiten
les des une dans pour qui sur pas avec sont leur cette aussi mais tout comme elle ment tion eau ique entre gouvernement
developpement connaissance evenement universite naturellement toujours
los las una con por para como pero sus este esta entre cuando muy sin sobre mente ado ciones gobierno desarrollo
conocimiento universidad generalmente siempre trabajo
""".split()


def labelled_samples(n: int = 6000, seed: int = 11) -> list[tuple[str, int]]:
    """``n`` labelled strings, half random (1) and half ordinary (0). The same for the same arguments.

    Random ones are drawn over the usual alphabets of keys; ordinary ones join
    words and pieces of words in the usual ways of writing identifiers.
    """
    r = random.Random(seed)
    letters, digits = ALPHABET[:52], ALPHABET[52:62]
    kinds = ("0123456789abcdef", letters + digits, letters + digits + "+/", letters + digits + "_-", ALPHABET[:26] + digits, ALPHABET[26:52] + digits)
    out = []
    for i in range(n // 2):
        out.append(("".join(r.choices(kinds[i % len(kinds)], k=r.randint(16, 64))), 1))
        parts = [r.choice(WORDS) for _ in range(r.randint(2, 6))]
        if i % 3 == 0:  # pieces of words in a row, as compound words and their plurals have
            parts = [p[: r.randint(2, 7)] for p in parts]
        form = i % 6
        word = ("_".join(parts), "-".join(parts), "".join(parts), parts[0] + "".join(p.capitalize() for p in parts[1:]), "/".join(parts), "_".join(parts).upper())[form]
        out.append((word + (str(r.randint(0, 9999)) if r.random() < 0.15 else ""), 0))
    return out


class MarkovRatio:
    """First-order chains of both classes, as a table of log-likelihood ratios."""

    def __init__(self, samples: list[tuple[str, int]], smooth: float = 0.5):
        """Fitted to (string, label) pairs; label 1 is random. Characters outside ALPHABET are one further symbol."""
        self.code = np.full(65536, len(ALPHABET), np.uint8)
        self.code[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))
        n = len(ALPHABET) + 1
        counts = np.full((2, n + 1, n), smooth)  # row n: the first character
        for text, label in samples:
            c = self._codes(text)
            if len(c):
                counts[label, n, c[0]] += 1
                np.add.at(counts[label], (c[:-1], c[1:]), 1)
        logs = np.log(counts / counts.sum(2, keepdims=True))
        self.table = logs[1] - logs[0]

    def _codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)]

    def ratio(self, text: str) -> float:
        """Mean log-likelihood ratio a character; 0 for the empty string."""
        c = self._codes(text)
        return float(self.table[-1, c[0]] + self.table[c[:-1], c[1:]].sum()) / len(c) if len(c) else 0.0


    def spans(self, word: str, min_ratio: float) -> list[tuple[int, int]]:
        """Places of what is random in a token: all of it, or else the run of whole segments that is most so, and what is left and right of it likewise."""
        out, todo = [], [(0, len(word))]
        while todo:
            a, b = todo.pop()
            part = word[a:b]
            if b - a < MIN_TOKEN or part.isdigit():
                continue
            if self.ratio(part) >= min_ratio:
                out.append((a, b))
                continue
            cuts = [m.span() for m in CUT.finditer(part)]
            if not cuts:
                continue
            starts = np.array([0] + [e for _, e in cuts])
            ends = np.array([s for s, _ in cuts] + [b - a])
            c = self._codes(part)
            total = np.r_[0.0, np.cumsum(np.r_[self.table[-1, c[0]], self.table[c[:-1], c[1:]]] - min_ratio)]
            below, at = total[starts], np.searchsorted(starts, ends - MIN_TOKEN, side="right") - 1
            least = np.minimum.accumulate(below)
            gain = np.where(at >= 0, total[ends] - least[at], -1.0)
            j = int(gain.argmax())
            if gain[j] < 0:
                continue
            s, e = int(starts[: at[j] + 1][below[: at[j] + 1].argmin()]), int(ends[j])
            todo += [(a, a + s), (a + e, b)]
            if any(ch.isalpha() for ch in part[s:e]):
                out.append((a + s, a + e))
        return sorted(out)


@lru_cache(1)
def default_model() -> MarkovRatio:
    return MarkovRatio(labelled_samples())


def find_spans(text: str, model: MarkovRatio, min_ratio: float = MIN_RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind. Code points; end exclusive.

    Patterns match leftmost and do not overlap within a kind; matches that are
    too short are dropped and not retried.
    """
    spans = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    tokens = [m.span() for m in TOKEN.finditer(text)]
    for a, b in tokens:  # runs of the other kinds lie within long tokens
        if b - a >= 20:
            spans += [("access", *m.span()) for m in ACCESS.finditer(text, a, b)]
            spans += [("hex", *m.span()) for m in HEX.finditer(text, a, b)]
    taken = [(s, e) for _, s, e in spans]
    for a, b in tokens:
        at = a
        for s, e in [*sorted((s, e) for s, e in taken if s < b and a < e), (b, b)]:
            if s - at >= MIN_TOKEN:
                spans += [("markov", at + x, at + y) for x, y in model.spans(text[at:s], min_ratio)]
            at = max(at, e)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", model: MarkovRatio | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(key, spans array<struct<kind,start,end>>) of every row; null and empty texts have no spans.

    Texts are searched whole, however long. Rows that repeat are scanned each; an
    empty table gives an empty one.

    ``model``: fitted elsewhere with labelled samples, by default on ``labelled_samples()``.
    """
    def run(batch: pa.RecordBatch) -> dict:
        m = model or default_model()
        found = [find_spans(t, m, min_ratio) for t in texts(batch)]
        return {"k": batch.column("k"), "spans": [[dict(zip(("kind", "start", "end"), s)) for s in f] for f in found]}

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    out = per_batch(rows, run, f"k {rows.schema['k'].dataType.simpleString()}, spans array<struct<kind: string, start: int, end: int>>")
    return out.select(F.col("k").alias(key), "spans")


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", model: MarkovRatio | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``df`` with every span in ``text`` replaced by ``mask``; overlapping spans are replaced once. Null stays null."""
    others = [c for c in df.columns if c != text]
    body = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        m, out = model or default_model(), []
        for v in batch.column("text"):
            if (t := v.as_py()) is not None:
                parts, at = [], 0
                for _, s, e in find_spans(t, m, min_ratio):
                    if s >= at:
                        parts += [t[at:s], mask]
                    at = max(at, e)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return {f"c{i}": batch.column(f"c{i}") for i in range(len(others))} | {"text": out}

    out = per_batch(body, run, body.schema)
    named = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(others)} | {text: F.col("text").alias(text)}
    return out.select(*[named[c] for c in df.columns])


def joined(spans: str) -> "F.Column":
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the patterns' spans, and all spans."""
    found = scan(documents(spark, sf_dir)).withColumn("base", F.filter("spans", lambda s: s["kind"] != "markov"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
