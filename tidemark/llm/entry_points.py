"""Queries of this subpackage, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, license_scan, line_crf, near_dedup, oracles, packing, quality_rules, substring_dedup, suffix_dedup, token_store, url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_substring_dedup": substring_dedup.query,
        "op2_near_dedup": near_dedup.query,
        "op3_url_filter": url_filter.query,
        "op4_token_store": token_store.query,
        "op5_line_crf": line_crf.query,
        "op6_decontamination": decontamination.query,
        "op7_quality_rules": quality_rules.query,
        "op8_packing": packing.query,
        "op9_license_scan": license_scan.query,
        "op10_suffix_dedup": suffix_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    """Tokens, trained models, trees of templates and distances are not for SQL; those queries are tested against plain versions."""
    return dict(oracles.SQL)
