"""Quality rules as a short-circuit cascade.

Rules are native column expressions. Their cost and their selectivity are
estimated on a sample, and the cascade asks them in the order of rejections per
cost, stopping at the first that rejects. The order changes how much work is
done, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import documents

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which rules are timed.
SAMPLE = 2000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words of a text without nulls."""
    core = F.btrim(text, F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def without(text: Column, chars: str) -> Column:
    """How many of the text's characters are not among ``chars``."""
    return F.length(F.regexp_replace(text, "[" + "".join(f"\\x{ord(c):02x}" for c in chars) + "]+", ""))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return F.when(~F.contains(text, F.lit("\n")), F.lit(0)).otherwise(let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x))))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the text has more than once.

    Windows are compared by 64-bit hashes. Where all are distinct, that settles
    it; only other texts sort their windows.
    """
    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, counted)

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, twice), covered))

    def covered(found: Column) -> Column:
        at = F.array_sort(F.transform(found, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(of(w)))


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row, repeated ones too.

    A null text is empty, and like texts without words has none of these. Texts
    are measured whole, however long; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    counts = let(word_array(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    found = rows.withColumn("c", counts)
    return found.select(
        key, "text",
        F.col("c.n").cast("bigint").alias("n_words"),
        without(t, BLANKS).cast("bigint").alias("word_chars"),
        (F.length(t) - without(t, SYMBOLS)).cast("bigint").alias("n_symbols"),
        duplicate_lines(t).cast("bigint").alias("n_dup_lines"),
        F.col("c.r").cast("bigint").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """A named rule over the columns of ``measures``; ``rejects`` is true for rows it rejects."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Rules for running prose, over the columns of ``measures``. A text without words passes them all; the base's length rule is for those."""
    t, n, body = F.col("text"), F.col("n_words"), F.col("word_chars")
    letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))
    capitals = F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))
    marks = F.length(t) - without(t, "!?")
    lines = F.split(t, "\n")
    return [
        Rule("few_letters", letters < 0.6 * body),
        Rule("symbols", F.col("n_symbols") > 0.05 * body),
        Rule("capitals", capitals > 0.5 * body),
        Rule("exclamations", marks > 0.1 * body),
        Rule("word_length", (body < 2 * n) | (body > 15 * n)),
        Rule("same_lines", F.when(F.col("n_dup_lines") > 0, F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")) < 2 * F.col("n_dup_lines")).otherwise(False)),
        Rule("ellipses", F.when(F.contains(t, F.lit("...")) | F.contains(t, F.lit("…")), let(lines, lambda x: F.size(F.filter(x, lambda y: y.endswith("...") | y.endswith("…"))) > 0.3 * F.size(x))).otherwise(False)),
    ]


def profile(sample: DataFrame, rules: list[Rule], repeats: int = 3) -> dict[str, tuple[float, float]]:
    """{rule: (seconds on the sample, share of it rejected)}, each as the best of a few runs, less the time of a run without a rule."""
    sample = sample.cache()
    try:
        n = sample.count()

        def run(what: Column) -> tuple[float, float]:
            took, got = [], 0
            for _ in range(repeats):
                began = time.perf_counter()
                got = sample.agg(F.sum(what)).first()[0] or 0
                took.append(time.perf_counter() - began)
            return min(took), got

        idle = run(F.octet_length("text"))[0]
        out = {}
        for r in rules:
            seconds, hits = run(F.coalesce(r.rejects, F.lit(False)).cast("int"))
            out[r.name] = max(seconds - idle, 1e-4), hits / n if n else 0.0
        return out
    finally:
        sample.unpersist()


def order(rules: list[Rule], found: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per cost, the most first."""
    return sorted(rules, key=lambda r: (-found[r.name][1] / found[r.name][0], found[r.name][0], r.name))


def rejected_by(rules: list[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects the text; null if none does. Later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample: DataFrame | None = None, first: Column | None = None) -> DataFrame:
    """``docs`` (what ``measures`` gives) with ``kept``: false where ``first`` holds or a rule rejects, in the order found on ``sample``.

    ``sample``: rows like those of ``docs``, by default its first SAMPLE rows.
    ``first``: a condition asked before all rules. The sample decides the order
    of the rules and never the verdict, so rows that repeat get the same one; an
    empty sample leaves the order to their costs, an empty table stays empty.
    """
    rules = default_rules() if rules is None else rules
    sample = docs.limit(SAMPLE) if sample is None else sample
    ranked = order(rules, profile(sample, rules))
    ask = rejected_by(ranked).isNull()
    return docs.withColumn("kept", ask if first is None else F.when(first, F.lit(False)).otherwise(ask))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of every document, and the verdict of base rules and cascade."""
    docs = documents(spark, sf_dir)
    files = sorted(docs.inputFiles())
    sample = spark.read.schema(docs.schema).parquet(files[len(files) // 2]).limit(SAMPLE) if files else docs.limit(SAMPLE)
    base = measures(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = cascade(base, sample=measures(sample), first=F.col("base_failed"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Measures and verdict of the query in SQL; the order of the rules does not matter there.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM t),
x AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER f || ' ' || lead(w, 2) OVER f AS s FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM x WHERE s IS NOT NULL) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM y, range(0, 3) q(j) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines, count(DISTINCT line) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS kinds,
        count(*) AS all_lines, count(*) FILTER (WHERE line LIKE '%...' OR line LIKE '%…') AS dots FROM l GROUP BY 1),
m AS (SELECT t.doc_id, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, (lines - kinds)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, lines, all_lines, dots,
        length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) AS capitals, length(text) - length(regexp_replace(text, '[!?]+', '', 'g')) AS marks
      FROM t JOIN d ON d.doc_id = t.doc_id LEFT JOIN r ON r.doc_id = t.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR letters < 0.6 * word_chars OR n_symbols > 0.05 * word_chars OR capitals > 0.5 * word_chars OR marks > 0.1 * word_chars OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_dup_lines > 0 AND lines < 2 * n_dup_lines) OR dots > 0.3 * all_lines) AS kept FROM b
"""
