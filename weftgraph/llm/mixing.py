"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: how often one of its documents should
appear on average so that the sources reach their target weights. A hash of the
seed and the document gives a uniform number, the inverted Poisson distribution
of that mean turns it into a count, and the document is emitted that many times.
A global shuffle by another hash ends the operator. All of it is native: the
count needs no neighbour, so nothing but the final shuffle moves a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import documents, free_name

#: Hexadecimal digits of an MD5 that make a uniform number: 52 bits are exact in a double.
DIGITS = 13
#: Means above this are drawn as a sum of several equal parts, so that exp(-mean) keeps its precision.
PART = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the text of ``parts``."""
    key = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(key, 1, DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(float(16**DIGITS))


def poisson(mean: Column, u: Column) -> Column:
    """The smallest k whose cumulative Poisson probability of ``mean`` (at most PART) exceeds ``u``.

    The sum is carried on term by term until it passes ``u`` or the terms vanish
    (k = 100, beyond which no double differs from 1 for means up to PART).
    """
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        more = s["c"] <= u
        return F.struct(F.when(more, p).otherwise(s["p"]).alias("p"), F.when(more, s["c"] + p).otherwise(s["c"]).alias("c"), F.when(more, i).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, source: str = "source") -> DataFrame:
    """(source, n_docs, rate): the mean repetition of each source's documents.

    ``weights``: target shares by source (any positive scale); sources not named
    have weight 0 and vanish. None: equal shares for all sources. ``size``: the
    expected number of documents of the mixture, by default as many as the input
    has. Null is a source of its own, named by the empty string in ``weights``.
    Counting combines rows before the shuffle, so a hot source costs no more.
    """
    found = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))
    name = F.coalesce("source", F.lit(""))
    if weights is None:
        weight = F.lit(1.0)
    elif weights:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), name), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    weighed = found.withColumn("w", weight)
    total = weighed.agg(F.sum("w").alias("w_all"), F.sum("n_docs").alias("n_all"))
    wanted = F.col("n_all") if size is None else F.lit(size)
    rate = F.when(F.col("w_all") > 0, F.col("w") / F.col("w_all") * wanted / F.col("n_docs")).otherwise(0.0)
    return weighed.join(F.broadcast(total), F.lit(True)).select("source", "n_docs", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, seed: int = 7, source: str = "source", key: str = "doc_id", max_broadcast_rows: int = 100_000, copy: str = "copy", n_copies: str = "n_copies") -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a global random order, plus columns ``copy`` and ``n_copies``.

    ``copy`` counts a document's appearances from 1. Rows that share a key get
    the same count; a null key is the key ''. A rate of 0 drops the source; an
    empty input gives an empty result. Columns of ``docs`` that have
    the names of these two are replaced, all others stay, whatever their names.
    Repeated rows are repeated alike; null and very long texts are as any other. The table of rates has one row per source: it is
    broadcast only if it has at most ``max_broadcast_rows`` rows, and joined by a
    shuffle, with hot sources split by AQE, beyond that.
    """
    mixed, order = replicas(docs, weights, size, seed, source, key, max_broadcast_rows, copy, n_copies)
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mixed.repartition(width, order).sortWithinPartitions(order)


def replicas(docs: DataFrame, weights: dict[str, float] | None, size: int | None, seed: int, source: str, key: str, max_broadcast_rows: int, copy: str, n_copies: str) -> tuple[DataFrame, Column]:
    """The repeated rows before the shuffle, and the column that orders them."""
    kept = [c for c in docs.columns if c not in (copy, n_copies)]
    name_of, rate_of = (free_name([*kept, copy, n_copies], x) for x in ("mixed_source", "mixed_rate"))
    by = rates(docs, weights, size, source).groupBy(F.coalesce("source", F.lit("")).alias(name_of)).agg(F.max("rate").alias(rate_of))
    few = by.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    body = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(source), F.lit("")).alias(name_of))
    body = body.join(F.broadcast(by) if few else by, name_of)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rate = F.col(rate_of)
    parts = F.ceil(rate / PART).cast("int")
    part = rate / F.greatest(parts, F.lit(1))
    one = lambda i: poisson(part, uniform(F.lit(str(seed)), name, i.cast("string")))
    count = F.when(rate <= 0, F.lit(0)).when(parts == 1, one(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), F.lit(0), lambda a, i: a + one(i)))
    kept_ = [F.col(f"`{c}`") for c in kept]
    body = body.withColumn(n_copies, count).where(F.col(n_copies) > 0)
    body = body.select(*kept_, n_copies, F.explode(F.sequence(F.lit(1), F.col(n_copies))).alias(copy))
    return body.select(*kept_, copy, n_copies), F.md5(F.concat_ws("|", F.lit(f"order{seed}"), name, F.col(copy).cast("string")).cast("binary"))


#: Expected rows of the query for equal weights: the counts again, from tables of cumulative probabilities.
ORACLE = """
WITH s AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM s) * (SELECT sum(n) FROM s)::DOUBLE / n AS rate FROM s),
q AS (SELECT source, rate, greatest(1, ceil(rate / 16.0))::INT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS m FROM r),
c AS (SELECT source, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM q, range(0, 100) z(k)),
u AS (SELECT d.doc_id, d.text, coalesce(d.source, '') AS s, d.source AS source, i,
        ('0x' || substr(md5('7|' || d.doc_id::VARCHAR || '|' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM documents d JOIN q ON q.source = coalesce(d.source, ''), range(1, 101) y(i) WHERE i <= q.parts),
n AS (SELECT u.doc_id, u.i, any_value(u.text) AS text, any_value(u.source) AS source, count(*) FILTER (WHERE c.cdf <= u.u) AS n FROM u JOIN c ON c.source = u.s GROUP BY u.doc_id, u.i),
t AS (SELECT doc_id, any_value(text) AS text, any_value(source) AS source, sum(n)::BIGINT AS n_copies FROM n GROUP BY doc_id)
SELECT doc_id, text, source, n_copies, copy::BIGINT AS copy FROM t, range(1, 200) x(copy) WHERE copy <= n_copies
"""


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to equal shares of their sources: one row per appearance."""
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "text", "source", F.col("n_copies").cast("bigint").alias("n_copies"), F.col("copy").cast("bigint").alias("copy"))
