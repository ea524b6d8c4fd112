"""Queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_text, license_scan, pii_pseudonyms, quality_classifier, quality_rules, simhash_dedup, source_mixing, substring_dedup, token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        decontamination.op1_benchmark_decontamination,
        pii_pseudonyms.op2_pii_pseudonyms,
        quality_rules.op3_adaptive_quality_rules,
        html_text.op4_html_main_text,
        license_scan.op5_license_scan,
        token_output.op6_token_output,
        simhash_dedup.op7_simhash_near_dedup,
        substring_dedup.op8_substring_dedup,
        source_mixing.op9_source_mixing,
        quality_classifier.op10_quality_classifier,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_adaptive_quality_rules": quality_rules.SQL,
        "op5_license_scan": license_scan.SQL,
        "op9_source_mixing": source_mixing.SQL,
    }
