"""Personal data by weak supervision.

Patterns find candidate spans. Labellers of three sorts vote on each candidate:
shape (regular expressions and check sums), gazetteers (short fixed lists) and
context (words just before the span). Votes of all candidates of all documents
are counted by pattern of votes; expectation-maximisation over these counts
estimates how reliable each labeller is, and gives every pattern of votes a
probability. A logistic classifier over features of the span itself, fitted to
those probabilities, makes the final decision. Everything that touches a row is
native; the driver sees only the table of counts, whose number of rows is
bounded by the number of patterns (votes times features), not by the data.

Base spans (e-mail, IP address, card and phone number that pass their checks)
are always kept; the classifier decides on the further candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import documents
from weftgraph.llm.quality_rules import let
from weftgraph.llm.weak_supervision import reliabilities

KINDS = ("email", "ip", "card", "phone")
#: Further candidates: long numbers, social security numbers, local phone numbers, account numbers, and capitalised names.
MORE = ("number", "ssn", "local", "iban", "name")
ALL = KINDS + MORE
#: Probability from which a further candidate becomes a span.
ACCEPT = 0.9

#: Java expressions, written so that no text makes them backtrack far: possessive repeats, and starts only where a run
#: of the first class starts or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![A-Za-z0-9.+-])[0-9]{13,19}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local": r"(?<![0-9A-Za-z+(.-])\(?+[0-9]{3}\)?+[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){3,7}(?:\x20?+[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": r"(?<=\b(?:name is|Mr|Mrs|Ms|Dr|Herr|Frau|Señora?|Monsieur|Madame)\.?\x20)\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20}){0,2}",
}
#: What a text must hold for a pattern to be tried.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "number": lambda t: t.rlike(r"[0-9]{13}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]"),
    "local": lambda t: t.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "name": lambda t: t.rlike(r"name is|\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señora?|Monsieur|Madame)\b"),
}

#: Gazetteers, and words that announce personal data, by kind.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz", "us", "ca", "ch", "at", "it", "nl", "be")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "971")
FIRST_NAMES = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth", "David", "Barbara", "Thomas", "Sarah", "Daniel", "Anna", "Peter", "Paul", "Maria", "Hans", "Klaus", "Ursula", "Jean", "Pierre", "Marie", "Sophie", "Juan", "Carlos", "Carmen", "Luis", "Ana", "José")
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write to|reach|correo)\W{0,3}\s*\w{0,8}\W{0,3}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|adresse)\W{0,3}\s*\w{0,8}\W{0,3}$",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta)\W{0,3}\s*\w{0,8}\W{0,3}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|teléfono)\W{0,3}\s*\w{0,8}\W{0,3}$",
    "number": r"(?i)(?:card|visa|credit|account|konto|compte|cuenta)\W{0,3}\s*\w{0,8}\W{0,3}$",
    "ssn": r"(?i)(?:ssn|social security|security number)\W{0,3}\s*\w{0,8}\W{0,3}$",
    "local": r"(?i)(?:phone|tel|call|mobile|fax|telefon|teléfono)\W{0,3}\s*\w{0,8}\W{0,3}$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta)\W{0,3}\s*\w{0,8}\W{0,3}$",
    "name": r"(?i)(?:my|her|his|name is|mein|mon)\b.{0,20}$",
}
#: Characters before a span that context labellers read.
CONTEXT = 40
LABELLERS = ("shape", "check", "gazetteer", "context")
#: Matches of a text that are handled together, so that the work grows with their number and not with its square.
CHUNK = 128


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        y = F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return total + y

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """Whether a match counts as a base span (or, for the further kinds, passes what check there is)."""
    n = F.length(digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: F.when(F.length(q) > 3, F.lit(False)).otherwise(q.cast("int") <= 255)))
    if kind in ("card", "number"):
        return F.when(n.between(13, 19), luhn(digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34)
    return F.lit(True)


SPANS = "array<struct<kind: string, start: int, end: int, value: string, before: string>>"


def chunks(items: Column) -> Column:
    """An array in parts of CHUNK items, in order; one empty part of an empty array."""
    last = F.greatest(F.ceil(F.size(items) / CHUNK).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))


def matches(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value, before>> of all matches in ``text``, leftmost and not overlapping."""
    empty = F.array().cast(SPANS)
    pattern = F.lit(PATTERNS[kind])

    def placed(x: Column) -> Column:
        # the text between matches, and the matches: their lengths give the places
        gap = lambda i: F.get(x["gaps"], i)

        def add(s: Column, v: Column) -> Column:
            a = s["at"] + F.length(gap(v["i"]))
            e = a + F.length(v["m"])
            before = F.right(gap(v["i"]), F.lit(CONTEXT))
            return F.struct(e.alias("at"), F.concat(s["found"], F.array(F.struct(F.lit(kind).alias("kind"), a.alias("start"), e.alias("end"), v["m"].alias("value"), before.alias("before")))).alias("found"))

        def add_chunk(s: Column, part: Column) -> Column:
            own = F.aggregate(part, F.struct(s["at"].alias("at"), empty.alias("found")), add)
            return let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(s["found"], F.array(o["found"])).alias("found")))

        numbered = F.transform(x["hits"], lambda m, i: F.struct(m.alias("m"), i.alias("i")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("found"))
        return let(numbered, lambda n: F.aggregate(chunks(n), start, add_chunk, lambda s: F.flatten(s["found"])))

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, PATTERNS[kind], -1).alias("gaps"))
    return F.when(HINTS[kind](text), let(both, placed)).otherwise(empty)


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans): base spans that pass their checks, and further candidates that overlap none of them."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")

    def sound(kind: str) -> Column:
        return F.filter(matches(t, kind), lambda s: valid(kind, s["value"]))

    base = rows.select(key, "text", F.concat(*map(sound, KINDS)).alias("base"))
    more = F.concat(*[matches(t, k) for k in MORE])
    meets = lambda x, s: F.coalesce((x["start"] < s["end"]) & (s["start"] < x["end"]), F.lit(False))

    def bounded(b: Column) -> Column:
        return F.struct(F.array_min(F.transform(b, lambda x: x["start"])).alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("spans"))

    parts = F.transform(chunks(F.col("base")), bounded)
    free = let(parts, lambda p: F.filter(more, lambda s: ~F.exists(p, lambda b: meets(b, s) & F.exists(b["spans"], lambda x: meets(x, s)))))
    return base.select(key, "base", free.alias("more"))


def votes(kind: Column, value: Column, before: Column) -> dict[str, Column]:
    """1 (personal), -1 (not) or 0 (no vote) of each labeller."""
    d, n = digits(value), F.length(digits(value))
    by = lambda cases: F.coalesce(*[F.when(kind == k, v) for k, v in cases.items()], F.lit(0))
    sign = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    shape = by({
        "email": sign(value.rlike(r"^[A-Za-z0-9]")), "ip": sign(~value.rlike(r"(?:^|\.)0[0-9]")), "card": sign(n.isin(13, 14, 15, 16, 19)), "phone": F.lit(1),
        "number": F.lit(0), "ssn": F.lit(1), "local": sign(value.rlike(r"^\(?[2-9]")), "iban": sign(value.rlike("[0-9]{4}")), "name": sign(value.contains(" ")),
    })
    check = by({k: sign(valid(k, value)) for k in ("ip", "card", "number", "ssn", "iban")} | {"phone": sign(n >= 10)})
    gazetteer = by({
        "email": sign(F.lower(F.substring_index(value, ".", -1)).isin(*DOMAINS)),
        "ip": sign(~value.rlike(r"^(?:0|127|255)\.")),
        "card": sign(d.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "number": sign(d.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "phone": sign(d.rlike("^(?:" + "|".join(COUNTRY_CODES) + ")")),
        "iban": sign(F.substring(value, 1, 2).isin("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH")),
        "name": sign(F.substring_index(value, " ", 1).isin(*FIRST_NAMES)),
    })
    # a cue is rare, so its absence says little
    context = by({k: F.when(before.rlike(p), F.lit(1)).otherwise(F.lit(0 if k in KINDS else -1)) for k, p in CUES.items()})
    return {"shape": shape, "check": check, "gazetteer": gazetteer, "context": context}


def features(kind: Column, value: Column, before: Column) -> Column:
    """The features that the final classifier sees, as one short string: kind, length class, digits, separators, what stands before."""
    size = F.when(F.length(value) < 12, "s").when(F.length(value) < 20, "m").otherwise("l")
    digit = F.when(F.length(digits(value)) * 2 > F.length(value), "d").otherwise("-")
    parted = F.when(value.rlike(r"[\x20()-]"), "p").otherwise("-")
    lead = F.when(before.rlike(r"[:=]\s*$"), "c").when(before.rlike(r"\w\s$"), "w").otherwise("-")
    known = F.when(votes(kind, value, before)["gazetteer"] > 0, "g").otherwise("-")
    good = F.when(votes(kind, value, before)["check"] > 0, "k").otherwise("-")
    return F.concat_ws(" ", kind, size, digit, parted, lead, known, good)


def vote_counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(votes of each labeller, features, n): candidates of all documents by pattern, counted before the shuffle."""
    rows = found.select(F.explode(F.concat("base", "more")).alias("s")).select("s.*")
    v = votes(F.col("kind"), F.col("value"), F.col("before"))
    rows = rows.select(*[v[name].alias(name) for name in LABELLERS], features(F.col("kind"), F.col("value"), F.col("before")).alias("f"))
    return rows.groupBy(*LABELLERS, "f").agg(F.count("*").alias("n"))


def fit_classifier(rows: list[tuple[str, float, float]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier over the tokens of the feature strings; ``rows``: (features, probability, number)."""
    total = sum(n for _, _, n in rows) or 1.0
    tokens = sorted({f"{i}{t}" for f, _, _ in rows for i, t in enumerate(f.split(" "))}) + ["bias"]
    weights, squares = dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 1e-8)
    parts = [([*(f"{i}{t}" for i, t in enumerate(f.split(" "))), "bias"], p, n) for f, p, n in rows]
    for _ in range(rounds):
        slope = {t: decay * weights[t] for t in tokens}
        for ts, p, n in parts:
            z = sum(weights[t] for t in ts)
            off = n / total * (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p)
            for t in ts:
                slope[t] += off
        for t in tokens:
            squares[t] += slope[t] ** 2
            weights[t] -= rate * slope[t] / math.sqrt(squares[t])
    return weights


def train(found: DataFrame) -> dict[str, float]:
    """The final classifier of ``candidates``, by labellers' votes on all of them."""
    rows = [(tuple(r[j] for j in LABELLERS), r["f"], float(r["n"])) for r in vote_counts(found).collect()]
    patterns: dict[tuple[int, ...], float] = {}
    for v, _, n in rows:
        patterns[v] = patterns.get(v, 0.0) + n
    _, _, post = reliabilities(sorted(patterns.items()))
    return fit_classifier([(f, post[v], n) for v, f, n in sorted(rows)])


def probability(weights: dict[str, float], f: Column) -> Column:
    """The classifier's probability for a feature string, natively; unknown tokens weigh nothing."""
    table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else F.create_map(F.lit("bias"), F.lit(0.0))
    z = F.aggregate(F.transform(F.split(f, " "), lambda t, i: F.coalesce(F.element_at(table, F.concat(i.cast("string"), t)), F.lit(0.0))), F.lit(weights.get("bias", 0.0)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-z))


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", accept: float = ACCEPT, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, base, spans) of every row: the base spans, and all spans, each by kind as listed in ALL, then start.

    A null text is empty, and rows that repeat a text get the same spans; an empty
    table gives an empty result. Whole texts are read, the work grows with a text
    and its matches. ``weights``: a classifier trained elsewhere; by default
    it is trained on the candidates of ``docs`` themselves, all of them.
    """
    found = candidates(docs, text, key)
    weights = train(found) if weights is None else weights
    sure = F.filter("more", lambda s: probability(weights, features(s["kind"], s["value"], s["before"])) >= accept)
    named = found.select(key, "base", sure.alias("sure"))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in ALL]), s["kind"])
    more = F.array_sort(F.transform("sure", lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    short = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return named.select(key, short("base").alias("base"), F.concat(short("base"), short(more)).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    found = find_personal_data(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
