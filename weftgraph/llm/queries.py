"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import collocations, mixing, pii, quality_classifier, quality_rules, rabitq, recompression, secrets, sentencepiece_codec, sharding, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
        "op2_rabitq_nearest": rabitq.op2_rabitq_nearest,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_personal_data": pii.op4_personal_data,
        "op5_simhash_components": simhash.op5_simhash_components,
        "op6_quality_cascade": quality_rules.op6_quality_cascade,
        "op7_poisson_mix": mixing.op7_poisson_mix,
        "op8_recompression_dedup": recompression.op8_recompression_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_phrase_collocations": collocations.op11_phrase_collocations,
        "op12_best_fit_shards": sharding.op12_best_fit_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_cascade": quality_rules.ORACLE,
        "op7_poisson_mix": mixing.ORACLE,
        "op8_recompression_dedup": recompression.ORACLE,
        "op11_phrase_collocations": collocations.ORACLE,
    }
