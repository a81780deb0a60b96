"""Queries of the corpus operators and the pipeline, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, mixing, packing, pii, quality_classifier, quality_rules, simhash, url_filter, wavelet

Query = Callable[[SparkSession, str], DataFrame]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline.py``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_pii": pii.op4_pii,
        "op5_wavelet": wavelet.op5_wavelet,
        "op6_chat": chat.op6_chat,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_packing": packing.op9_packing,
        "op10_simhash": simhash.op10_simhash,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are tested against plain versions."""
    return {
        "op3_quality_rules": quality_rules.OP3_SQL,
        "op6_chat": chat.OP6_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
    }
