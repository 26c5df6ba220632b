"""Queries of this subpackage, by the names the driver calls, and SQL with the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodegrid.llm import bpe, html_text, license_scan, mixing, mpeg_audio, near_dedup, quality_classifier, quality_rules, sql, token_orc, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.query,
    "op2_license_scan": license_scan.query,
    "op3_html_main_text": html_text.query,
    "op4_quality_pu": quality_classifier.query,
    "op5_bpe_encode_decode": bpe.query,
    "op6_mpeg_audio": mpeg_audio.query,
    "op7_temperature_mixing": mixing.query,
    "op8_minhash_near_dedup": near_dedup.query,
    "op9_token_orc": token_orc.query,
    "op10_toxicity_trees": toxicity.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY_RULES,
    "op2_license_scan": sql.LICENSES,
    "op8_minhash_near_dedup": sql.NEAR_DUPLICATES,
}
