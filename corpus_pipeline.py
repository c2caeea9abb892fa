"""A corpus from documents: toxic texts go, one of each group of near duplicates stays, secrets are masked, sources are mixed, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import mixing, near_duplicates, secrets, sentencepiece_codec, toxicity
from weftgraph.llm.common import free_name
from weftgraph.plans.lineage import discard, materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below 0.5. It learns from all labels of documents that are here.

    A null text is empty and scored as such; rows that repeat a text have the
    same score; without labels of both kinds nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.fit(toxicity.training_rows(docs, labels, held_out=False))
    score = free_name(docs.columns, "score")
    return toxicity.with_scores(docs, net, to=score).where(F.col(score) < 0.5).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates: five-word shingles, similarity 0.8.

    Candidates come from the Gray-order index over 64-bit fingerprints and, for
    what differs in more bits, from wide fingerprints; shingles decide.
    Null and empty texts are copies of each other. Rows without an id stay, and
    rows that share one stay or go together.
    """
    return near_duplicates.drop_near_duplicates(docs).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced by a mark and n_chars counted anew. Null texts stay null, with 0 characters."""
    return secrets.redact(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal shares on average, in a global random order.

    Null is a source of its own. Rows that share an id are repeated as often.
    """
    copy, n_copies = (free_name(docs.columns, c) for c in ("copy", "n_copies"))
    return mixing.mix(docs, copy=copy, n_copies=n_copies).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: the ids of its pieces, where each begins and ends in the text (UTF-8 bytes), and digests of ids and decoded text. Null is the empty text."""
    pieces = sentencepiece_codec.encode(docs, sentencepiece_codec.public_model(), decoded=True)
    return sentencepiece_codec.with_digests(pieces, ("ids", "begins", "ends"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL can express neither the network nor the fingerprints' groups; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, and what it was made from goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = materialize(out)
        discard(out)
    return STAGES[-1][1](spark, docs, sf_dir)
